"""Text and scalar functions as Column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and \s see it; Java's and DuckDB's \s are narrower.
WS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = "[^" + WS[1:]
#: A sentence piece: text with the run of stop marks or line breaks that ends it. An ASCII full stop ends none.
SENTENCE_PIECE = r"[^。．！？!?\n]*(?:[。．！？!?]+|\n+)|[^。．！？!?\n]+"
SPAN = "array<struct<char_start:int,char_end:int>>"

# Old characters and the new ones they are read as; marks of repetition are dropped.
OLD_CHARACTERS: dict[str, str] = {
    "國": "国", "學": "学", "體": "体", "廣": "広", "觀": "観", "假": "仮", "聲": "声", "會": "会", "豐": "豊", "鐵": "鉄", "號": "号", "圓": "円",
    "藝": "芸", "缺": "欠", "辭": "辞", "舊": "旧", "寶": "宝", "獨": "独", "當": "当", "經": "経", "惠": "恵", "醫": "医", "齋": "斎", "櫻": "桜",
    "氣": "気", "澤": "沢", "驛": "駅", "萬": "万", "與": "与", "亂": "乱", "佛": "仏", "戰": "戦", "禮": "礼", "勳": "勲", "獻": "献", "歸": "帰",
    "ゐ": "い", "ゑ": "え", "ヰ": "イ", "ヱ": "エ", "ゝ": "", "ゞ": "", "ヽ": "", "ヾ": "",
}


def strip(c: Column) -> Column:
    """Without white space at both ends, as Python strips."""
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | ~c.rlike(NON_WS)


def ascii_fold(c: Column) -> Column:
    """ASCII letters in lower case; all others untouched."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas in it ask for it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Lengths that are added up in one go by :func:`running_ends`.
_BLOCK = 64


def running_ends(sizes: Column) -> Column:
    """Running sums of an array of ints, in two levels so that no long array is grown element by element."""
    none = F.expr("cast(array() as array<int>)")
    add = lambda x, y: (x + y).cast("int")
    grow = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))

    def two_levels(n: Column) -> Column:
        part = lambda b: F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))
        blocks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int"))
        begin = F.aggregate(F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), add)), F.array(F.lit(0)), grow)
        within = lambda b, at: F.slice(F.aggregate(part(b), F.array(at), grow), 2, _BLOCK)
        return F.flatten(F.zip_with(blocks, F.slice(begin, 1, F.size(blocks)), within))

    one_level = lambda n: F.slice(F.aggregate(n, F.array(F.lit(0)), grow), 2, _BLOCK)
    return let(sizes, lambda n: F.when(F.size(n) == 0, none).when(F.size(n) <= _BLOCK, one_level(n)).otherwise(two_levels(n)))


def _spans_of(pieces: Column, gaps: Callable[[Column], Column] | None = None) -> Column:
    """Half-open spans of consecutive pieces, blank ones left out; ``gaps``: of the pieces, the lengths of what stands
    behind each."""

    def spans(p: Column) -> Column:
        size = F.transform(p, lambda x: F.length(x))
        full = size if gaps is None else F.zip_with(size, gaps(p), lambda x, y: x + F.coalesce(y, F.lit(0)))
        starts = let(full, lambda f: F.zip_with(running_ends(f), f, lambda e, n: (e - n).cast("int")))
        found = F.zip_with(starts, p, lambda at, x: F.when(x.rlike(NON_WS), F.struct(at.alias("char_start"), (at + F.length(x)).cast("int").alias("char_end"))))
        return F.filter(found, lambda x: x.isNotNull())

    return let(pieces, spans)


def char_spans(text: Column) -> Column:
    """One span for each code point; none for an empty or null text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.expr(f"cast(array() as {SPAN})")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("int").alias("char_start"), (i + 1).cast("int").alias("char_end")))
    )


def sentence_spans(text: Column) -> Column:
    """Sentences with the marks that end them; blank ones left out; none for null."""
    return _spans_of(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE_PIECE), F.lit(0)))


def paragraph_spans(text: Column) -> Column:
    """Paragraphs between blank lines, without these; blank ones left out; none for null."""
    parts, seps = _paragraphs(text)
    return _spans_of(parts, lambda p: let(seps, lambda q: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.length(F.get(q, i)))))


def _paragraphs(text: Column) -> tuple[Column, Column]:
    """What stands between blank lines, and these."""
    t = F.coalesce(text, F.lit(""))
    sep = rf"\n{WS}*\n"
    return F.split(t, sep, -1), F.regexp_extract_all(t, F.lit(f"({sep})"), F.lit(1))


def paragraph_starts(text: Column) -> Column:
    """Where each separator between paragraphs starts."""
    parts, seps = _paragraphs(text)

    def starts(q: Column) -> Column:
        full = F.zip_with(F.slice(parts, 1, F.size(q)), q, lambda x, y: F.length(x) + F.length(y))
        return F.zip_with(running_ends(full), q, lambda e, y: (e - F.length(y)).cast("int"))

    return let(seps, lambda q: F.when(F.size(q) > 0, starts(q)).otherwise(F.expr("cast(array() as array<int>)")))


def paragraph_index(starts: Column, pos: Column) -> Column:
    """Number of separators that start at or before ``pos``; 0 for a text without any."""
    return F.size(F.filter(starts, lambda s: s <= pos))


def atomic_spans(bounds: Column, length: Column) -> Column:
    """The text cut at all given offsets (clamped to it): spans between neighbours."""
    clamped = F.transform(bounds, lambda b: F.greatest(F.lit(0), F.least(b, length)).cast("int"))
    points = F.array_sort(F.array_distinct(F.concat(clamped, F.array(F.lit(0), length.cast("int")))))
    pairs = F.zip_with(points, F.slice(points, 2, F.size(points)), lambda a, b: F.struct(a.alias("char_start"), b.alias("char_end")))
    return F.filter(pairs, lambda s: s["char_end"].isNotNull())


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Characters between two spans; 0 where they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def normalize_old(text: Column, extra: Mapping[str, str] | None = None) -> Column:
    """Old characters replaced; targets may have any length."""
    table = OLD_CHARACTERS | dict(extra or {})
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if v == ""]
    out = F.translate(text, "".join(single) + "".join(gone), "".join(single.values()))
    for k, v in table.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def wikilinks(text: Column) -> Column:
    """Targets of [[target]], [[target|alias]] and [[target#heading]], trimmed, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\[([^\]\|#]+)[^\]]*\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def year_of(value: Column) -> Column:
    """The first run of four digits as a number; null without one."""
    return F.nullif(F.regexp_extract(value, r"(\d{4})", 1), F.lit("")).try_cast("int")


def ngrams(text: Column, n: int = 2) -> Column:
    """Character n-grams of a text without white space; a shorter text is its own gram; none for blank ones."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", "")
    size = F.length(t)
    empty = F.expr("cast(array() as array<string>)")
    return (
        F.when(size == 0, empty)
        .when(size < n, F.array(t))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))
    )


def detect_language(text: Column) -> Column:
    """'ja' if Han and kana are at least as many as Latin letters, 'en' if fewer, 'und' without either."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"))
    latin = F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when((cjk == 0) & (latin == 0), "und").when(cjk >= latin, "ja").otherwise("en")


# Notations of the languages that have a reader of their own.
EN_LABELS = ("en", "eng", "english", "英語")
JA_LABELS = ("ja", "jpn", "jp", "japanese", "日本語")


def language_of(label: Column, text: Column) -> Column:
    """'en', 'ja' or 'other' of a label in any notation; a missing or blank label is made up for by the text's script."""
    low = F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([^-_\s]*)", 1))
    found = F.when(low == "", detect_language(text)).when(low.isin(*EN_LABELS), "en").when(low.isin(*JA_LABELS), "ja")
    return F.when(found.isin("en", "ja"), found).otherwise("other")


# Fixed values in the next three: hues, lightness, saturation; weights and limit of luminance; ends of the scale.
def auto_color(i: Column) -> Column:
    """Twelve hues in turn at lightness .62 and saturation .55."""
    import colorsys

    hues = []
    for k in range(12):
        hues.append("#" + "".join(f"{int(v * 255):02X}" for v in colorsys.hls_to_rgb(k / 12, 0.62, 0.55)))
    return F.get(F.array(*map(F.lit, hues)), F.pmod(i, F.lit(12)).cast("int"))


def text_color(color: Column) -> Column:
    """Black on light colours and on anything that is no #RRGGBB, white on dark ones."""
    ok = color.rlike("^#[0-9A-Fa-f]{6}$")
    part = lambda at: F.conv(F.substring(F.when(ok, color).otherwise("#000000"), at, 2), 16, 10).cast("int")
    lum = (0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6)) / 255
    return F.when(~F.coalesce(ok, F.lit(False)), "#000000").when(lum > 0.55, "#000000").otherwise("#ffffff")


def color_scale(value: Column, peak: Column) -> Column:
    """White at 0 to red at the peak; white if there is no peak."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value.cast("double"), peak.cast("double"))))
    shade = lambda n: F.floor(F.lit(n) * (1 - t)).cast("int")
    return F.when(peak <= 0, "#ffffff").otherwise(F.lower(F.format_string("#%02x%02x%02x", F.lit(255), shade(255), shade(220))))


# The order and marks of the three forms.
def citation(author: Column, title: Column, year: Column, source: Column, style: str = "sist02", quote: Column | None = None, locator: Column | None = None) -> Column:
    """A reference in apa, chicago or sist02 form; an unknown style is an error.

    Null fields count as empty, a null or zero year as "n.d."; ``locator`` has no place in apa.
    """
    a, t, s = (strip(F.coalesce(x, F.lit(""))) for x in (author, title, source))
    y = F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("n.d."))
    where = F.lit("") if locator is None else F.when(F.coalesce(locator, F.lit("")) == "", "").otherwise(F.concat(F.lit(", "), locator))
    src = F.when(s == "", "").otherwise(F.concat(s, F.lit(", ")))
    if style == "apa":
        out = F.concat(a, F.lit(" ("), y, F.lit("). "), t, F.lit("."), F.when(s == "", "").otherwise(F.concat(F.lit(" "), s, F.lit("."))))
    elif style == "chicago":
        out = F.concat(a, F.lit('. "'), t, F.lit('." '), src, y, where, F.lit("."))
    elif style == "sist02":
        out = F.concat(a, F.lit(". "), t, F.lit(". "), src, y, where, F.lit("."))
    else:
        raise ValueError(f"unknown citation style: {style}")
    out = strip(out)
    if quote is not None:
        out = F.when(F.coalesce(quote, F.lit("")) == "", out).otherwise(F.concat(F.lit("「"), quote, F.lit("」（"), out, F.lit("）")))
    return out


def safe_name(name: Column) -> Column:
    """A name fit for a file; blank ones are "untitled"."""
    t = strip(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|]+', "_"))
    return F.when(t == "", "untitled").otherwise(t)


def tag(name: Column) -> Column:
    """A vault tag: # and the name with _ for spaces."""
    return F.concat(F.lit("#"), F.regexp_replace(strip(name), f"{WS}+", "_"))


def html_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fill_blank(old: Column, new: Column) -> Column:
    """The old value unless it is null or empty."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def contains_phrase(text: Column, query: str) -> Column:
    """Whether the words of ``query`` stand in a row in ``text``, accents and punctuation apart."""
    words = token_string(F.lit(query))
    return (words != " ") & F.contains(token_string(text), words)


#: Accented Latin letters and their bases, for word search.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēėęěğīįłńňōőŕřśşšţťūůűźżž"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeeegiilnnoorrsssttuuuzzz"


def token_string(text: Column) -> Column:
    """Lower-case words without accents, parted and surrounded by single spaces."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _BASE)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def like_ascii(c: Column, query: str) -> Column:
    """LIKE %query% that folds ASCII letters only and has no escape; % and _ of the query are wild, a blank query matches all."""
    if not query.strip():
        return F.lit(True)
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in query)
    return F.like(ascii_fold(c), F.lit(f"%{low}%"), F.lit("\x01"))


def layout_label(language: Column, vertical: Column) -> Column:
    """Label of a page's layout: language and direction of writing; an undetermined language has no direction."""
    name = F.when(language == "ja", "Japanese").when(language == "en", "English").otherwise("Unknown")
    return F.when(F.coalesce(language, F.lit("")) == "und", name).otherwise(F.concat(name, F.when(vertical, " vertical").otherwise(" horizontal")))


def any_contains(haystack: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(haystack, F.lit(n))
    return out
