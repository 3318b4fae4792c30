"""Repair of text from scanned pages.

Lines are labelled header, page_number, body or break (the last line of a paragraph) by a linear-chain conditional
random field over layout and text features. It is fitted by forward-backward passes on pages of whose lines some are
plain (titles that recur at page edges, bare numbers, indents); the others take part with their features and
neighbours. Within the body, words broken over lines and pages are joined, marks that are
no text are dropped, and words unknown to the lexicon of typed texts are corrected by common false readings.

A page is the unit of work; what a page needs from its successor, its first words, comes by a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.chain import Chain, fit_chain
from corpusloom.session import cut, lookup, spread

#: Pages the line model is fitted on; lexicon entries with this share of all tokens, at most 1/share, are held in memory.
FIT_PAGES, LEAST_SHARE = 800, 5e-6
#: Bits of the filter that tells candidate readings of rarer entries apart before they are looked up.
FILTER_BITS = 1 << 25
#: Pages that make a recurring line a title, and the share of trigrams (Dice) that a misread one has in common with it.
TITLE_PAGES, ALIKE = 4, 0.7
STATES = ("header", "page_number", "body", "break")

_NUMBER = r"(?:[-—–(\[·]\s*)?(?:(?:p|pp|S|s|pág|стр|с|f|fol)\.\s*(?=\d))?(?:\d{1,4}|[IVXLCDM]{1,9}|[ivxl]{1,9}|[０-９]{1,4}|[〇一二三四五六七八九十百]{1,5})(?:\s*[-—–)\]·.頁页])*"
NUMBER = regex.compile(_NUMBER)
_TITLE_PARTS = regex.compile(rf"^(?:{_NUMBER}\s+)?(.*?)(?:\s+{_NUMBER})?$")
EDGES = regex.compile(r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$")
#: The same, but for an exclamation mark before, which may be a misread letter.
EDGES_BUT_MARK = regex.compile(r"^[^\p{L}\p{N}\p{M}!]+|[^\p{L}\p{N}\p{M}]+$")
FIGURED = regex.compile(r"\p{L}*[0-9!]\p{L}+|\p{L}+[0-9!]\p{L}*")
STOP = regex.compile(r"[.!?。！？।…．][”’\"')\]』」）»]*$")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
LETTER = regex.compile(r"[\p{L}\p{M}]")
ROMAN = regex.compile(r"[ivxlcdm]+", regex.IGNORECASE)
BROKEN = regex.compile(r"[\p{L}\p{M}'’][-‐‑­¬=]$")
# Marks that a scanner reads from dirt.
SPECKS = frozenset("^|¦~¬_·•`´*°'\\/<>={}#¨˙,.;")

# True characters and what scanners commonly read for them.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("o", "c"), ("r", "t"), ("t", "f"), ("f", "t"), ("s", "f"), ("f", "s"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "!"), ("l", "!"), ("i", "l"), ("l", "i"), ("b", "6"), ("é", "6"), ("g", "q"), ("q", "g"), ("g", "9"), ("d", "cl"), ("cl", "d"),
    ("m", "rn"), ("rn", "m"), ("w", "vv"), ("in", "m"), ("ni", "m"), ("a", "o"), ("o", "a"), ("s", "5"), ("b", "8"), ("y", "v"), ("v", "y"), ("ü", "ii"), ("ü", "u"),
    ("ä", "a"), ("ö", "o"), ("é", "e"), ("è", "e"), ("ê", "e"), ("à", "a"), ("â", "a"), ("ç", "c"), ("ô", "o"), ("û", "u"), ("ñ", "n"), ("á", "a"), ("í", "i"), ("ó", "o"), ("ú", "u"),
    ("ã", "a"), ("õ", "o"), ("ß", "B"), ("ß", "ss"), ("li", "h"), ("h", "li"), ("fi", "h"), ("ll", "11"), ("nn", "m"), ("z", "2"), ("k", "lc"), ("n", "ri"), ("u", "ii"), ("h", "l1"), ("fl", "fi"), ("fi", "fl"), ("r", "v"), ("w", "w"),
)
# Han and kana characters that look alike.
LOOKALIKES = (
    "人入八", "土士", "未末", "大犬太", "田由甲申", "書晝昼画", "水氷永", "長艮", "日目曰白", "己已巳", "千干于", "刀力刃", "王玉主", "牛午", "石右", "木本", "天夫", "鳥烏", "間問聞", "待侍持",
    "官宮", "西酉", "名各", "若苦", "島鳥", "村材", "手毛", "薬楽", "衣依", "約的", "記紀", "古吉", "台合", "前削", "后後", "今令", "又叉", "万方", "卯卵", "微徴", "遣遺", "績積", "網綱", "治冶", "母毋", "束東", "候侯",
    "ソン", "シツ", "ニ二", "カ力", "ロ口", "エ工", "ト卜", "ハ八", "夕タ", "へヘ", "りリ", "はほ", "ぬめ", "わね", "るろ", "さき",
)
_LOOKS = {frozenset((a, b)) for g in LOOKALIKES for a, b in combinations(g, 2)}


@lru_cache(maxsize=200_000)
def core(word: str) -> str:
    return EDGES.sub("", word)


def title_keys(line: str) -> list[str]:
    """Forms under which a running title recurs: without its number, and without a name before a comma."""
    m = _TITLE_PARTS.match(line.strip())
    t = (m.group(1) if m else line).strip(" -—–()[]·.")
    t = regex.sub(r"\s+", " ", t).casefold()
    out = [t] if sum(map(str.isalpha, t)) >= 3 else []
    if ", " in t and sum(map(str.isalpha, t.split(", ", 1)[1])) >= 3:
        out.append(t.split(", ", 1)[1])
    return out


@dataclass(slots=True)
class Word:
    index: int
    line: int
    text: str
    x: float
    w: float
    conf: float


def lines_of(words: list[Word]) -> list[list[Word]]:
    out: list[list[Word]] = []
    for w in words:
        if not out or out[-1][-1].line != w.line:
            out.append([])
        out[-1].append(w)
    return out


def line_features(lines: list[list[Word]], repeats: dict[int, int]) -> list[list[str]]:
    """Layout and text features of each line of a page; ``repeats``: line -> pages with that title at an edge."""
    n = len(lines)
    widths = [max(w.x + w.w for w in ws) - min(w.x for w in ws) for ws in lines]
    usual = max(1.0, float(np.percentile(widths, 75))) if widths else 1.0
    margin = float(np.median([min(w.x for w in ws) for ws in lines])) if lines else 0.0
    out = []
    for i, ws in enumerate(lines):
        t = " ".join(w.text for w in ws)
        letters = [c for c in t if c.isalpha()]
        upper = sum(c.isupper() for c in letters) / max(1, len(letters))
        r = repeats.get(ws[0].line, 0)
        number = bool(NUMBER.fullmatch(t.strip()))
        nxt = lines[i + 1] if i + 1 < n else None
        f = [
            f"top={min(i, 3)}", f"end={min(n - 1 - i, 3)}", f"edge={i < 2 or i >= n - 2}", f"num={number}", f"stop={bool(STOP.search(t))}", f"wide={min(4, int(5 * widths[i] / usual))}",
            f"up={upper > 0.8 and len(letters) > 3}", f"rep={0 if r < 2 else 1 if r < TITLE_PAGES else 2}", f"low={t[:1].islower()}", f"tail={bool(BROKEN.search(t) or t[-1:] in ',;、，')}",
            f"numend={_has_number(t)}", f"indent={min(w.x for w in ws) > margin + 8}", f"nextin={nxt is not None and min(w.x for w in nxt) > margin + 8}", f"cjk={bool(CJK.search(t))}",
        ]
        f += [f"{f[2]}&{f[7]}&{f[4]}", f"{f[2]}&{f[3]}", f"{f[4]}&{f[5]}&{f[12]}"]
        out.append(f)
    return out


def _has_number(t: str) -> bool:
    p = t.split(" ")
    return len(p) > 1 and bool(NUMBER.fullmatch(p[0]) or NUMBER.fullmatch(p[-1]) or NUMBER.fullmatch(" ".join(p[-3:])) or NUMBER.fullmatch(" ".join(p[:3])))


HEADER, NUMBER_, BODY, BREAK = range(4)


def may_be(f: list[str]) -> set[int]:
    """The kinds a line may be of by what is plain; of many lines nothing is.

    A bare number at a page's edge is a page number, a line there that recurs on many pages and ends like no sentence is a
    running title, a line inside a page is text; what ends with a stop before an indent, or short, ends a paragraph,
    and a full line that goes on does not.
    """
    s = set(f)
    edge, stop = "edge=True" in s, "stop=True" in s
    full = bool(s & {"wide=3", "wide=4"})
    if "num=True" in s:
        return {NUMBER_} if edge else {NUMBER_, BODY, BREAK}
    if edge and "rep=2" in s and not stop and not s & {"tail=True", "low=True"}:
        return {HEADER}
    if edge and not stop and not s & {"tail=True", "low=True"} and not (full and "rep=0" in s):
        return {HEADER, BODY, BREAK}
    if stop and ("nextin=True" in s or not full):
        return {BREAK}
    if not stop and full and "nextin=False" in s:
        return {BODY}
    return {BODY, BREAK}


@dataclass
class LineModel:
    chain: Chain

    def label(self, lines: list[list[Word]], repeats: dict[int, int]) -> list[str]:
        return [STATES[k] for k in self.chain.best(line_features(lines, repeats))] if lines else []


def fit_lines(pages: list[tuple[list[list[Word]], dict[int, int]]]) -> LineModel:
    """Fit a linear chain on pages, by what is plain of their lines; all weights start from nothing."""
    rows = [line_features(lines, repeats) for lines, repeats in pages]
    return LineModel(fit_chain(rows, [[may_be(f) for f in page] for page in rows], len(STATES)))


def confusions() -> dict[str, list[str]]:
    """What is read -> what may truly stand there."""
    back: dict[str, list[str]] = {}
    for true, read in CONFUSIONS:
        if true != read:
            back.setdefault(read.lower(), []).append(true)
    return back


def false_readings(low: str, back: dict[str, list[str]], begins: Callable[[str], bool], known: Callable[[str], bool]) -> dict[str, int]:
    """Known words that at most three false readings turn into ``low``, with the least number of those.

    One reading for every three letters is allowed. Only what begins a known word is followed, so the cost does
    not grow with the number of places where a false reading may stand.
    """
    most = max(1, min(3, len(low) // 3))
    out: dict[str, int] = {}
    todo = [(0, "", 0)]
    while todo:
        i, s, n = todo.pop()
        if i == len(low):
            if n and n < out.get(s, 9) and known(s):
                out[s] = n
            continue
        steps = [(1, low[i], n)]
        if n < most:
            steps += [(k, t, n + 1) for k in (1, 2) if i + k <= len(low) for t in back.get(low[i : i + k], ())]
        todo += [(i + k, s + t, m) for k, t, m in steps if begins(s + t)]
    return out


@dataclass
class Lexicon:
    """Words and character trigrams of typed texts with their counts.

    ``letters`` and ``total`` are those of all words where ``words`` are not all of them; ``extend`` lends it the
    rarer entries that a page may need.
    """

    words: dict[str, tuple[int, str]]
    trigrams: dict[str, int]
    letters: list[tuple[str, int]] | None = None
    total: int = 0
    known: dict[tuple[str, bool], str | None] = field(default_factory=dict)
    thirds: dict[str, list[str]] = field(default_factory=dict)
    alphabet: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for t in self.trigrams:
            self.thirds.setdefault(t[:2], []).append(t[2])
        letters = Counter(c for w in self.words for c in w) if self.letters is None else Counter(dict(self.letters))
        seen: dict[str, Counter] = {}
        for c, n in sorted(letters.items(), key=lambda x: (-x[1], x[0])):
            seen.setdefault(script(c), Counter())[c] += n
        self.alphabet = {k: "".join(c for c, _ in v.most_common()) for k, v in seen.items()}
        self.total = self.total or sum(n for n, _ in self.words.values()) or 1
        self.back = confusions()
        self.begins = {w[:i] for w in self.words for i in range(1, len(w) + 1)}
        self.more: set[str] = set()

    @contextmanager
    def extend(self, words: dict[str, tuple[int, str]], trigrams: dict[str, int]) -> Iterator[None]:
        """Within, the lexicon has these entries too; none of them is in it already."""
        self.words.update(words)
        self.trigrams.update(trigrams)
        self.more = {w[:i] for w in words for i in range(1, len(w) + 1)}
        for t in trigrams:
            self.thirds.setdefault(t[:2], []).append(t[2])
        yield
        for w in words:
            del self.words[w]
        for t in trigrams:
            del self.trigrams[t]
            self.thirds[t[:2]].remove(t[2])
        self.more = set()

    def count(self, w: str) -> int:
        return self.words.get(w.lower(), (0, ""))[0]

    def dress(self, low: str, like: str) -> str:
        """``low`` in the case of the word it was read as."""
        if like.isupper() and len(like) > 1:
            return low.upper()
        usual = self.words.get(low, (0, low))[1]
        if like[:1].isupper():
            return low[:1].upper() + low[1:]
        return low if like[:1].islower() else usual

    def readings(self, low: str) -> list[tuple[float, str]]:
        """Known words that common false readings turn into ``low``."""
        found = false_readings(low, self.back, lambda p: p in self.begins or p in self.more, lambda s: s in self.words)
        least = min(found.values(), default=0)
        return [(math.log10(self.words[s][0]) - 1.5 * n, s) for s, n in found.items() if n == least]

    def changed(self, low: str, begins: Callable[[str], bool]) -> Iterator[str]:
        """``low`` with one change of any letter, as far as what stands up to the change begins a known word."""
        letters = self.alphabet.get(script(next((c for c in low if c.isalpha()), low[0])), "")
        for i in range(len(low) + 1):
            if i and not begins(low[:i]):
                break
            if i < len(low):
                yield low[:i] + low[i + 1 :]
            for c in letters:
                if begins(p := low[:i] + c):
                    yield p + low[i:]
                    if i < len(low):
                        yield p + low[i + 1 :]

    def near(self, low: str) -> list[tuple[float, str]]:
        """Known words one change of any letter away."""
        found = {s for s in self.changed(low, lambda p: p in self.begins or p in self.more) if s != low and s in self.words}
        return [(math.log10(n) - 3, s) for s in found if (n := self.words[s][0]) >= 5]

    def candidates(self, low: str, bits: bytes) -> set[str]:
        """Words of the filter ``bits`` that ``low`` may turn out to be, to hold or to be misread from."""
        # the filter holds the beginnings of words too
        begins = lambda p: in_filter(p, bits)
        out = {low, *(p for i in range(1, len(low)) for p in (low[:i], low[i:]))}
        if len(low) >= 5:
            out.update(self.changed(low, begins))
        out.update(false_readings(low, self.back, begins, lambda s: True))
        return {s for s in out if s and in_filter(s, bits)}

    def split(self, low: str) -> list[tuple[float, str]]:
        """Two known words run together; parts of one letter must be very common words."""
        out = []
        for i in range(1, len(low)):
            a, b = low[:i], low[i:]
            ca, cb = self.count(a), self.count(b)
            if ca >= 2 and cb >= 2 and all(len(p) > 1 or (p.isalpha() and n > self.total / 500) for p, n in ((a, ca), (b, cb))):
                out.append((math.log10(ca) + math.log10(cb) - math.log10(self.total) - 0.5 * (min(len(a), len(b)) == 1) + 1.0, a + " " + b))
        return out

    def repair(self, word: str, conf: float) -> str | None:
        """The right form of a misread word, without punctuation at its ends; None if it is right or unknown."""
        key = (word, conf < 0.75)
        if key not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[key] = self._repaired(word, conf < 0.75)
        return self.known[key]

    def _repaired(self, word: str, unsure: bool) -> str | None:
        w = core(word)
        if not w or not LETTER.search(word) or CJK.search(w):
            return None
        low = w.lower()
        if low in self.words:
            return None
        marked = EDGES_BUT_MARK.sub("", word)
        if marked.startswith("!") and len(marked) > 1 and marked[1].islower():
            w, low = marked, marked.lower()
        if ROMAN.fullmatch(low) and w.isupper():
            return None
        if sum(c.isalpha() for c in low) * 2 < len(low) and not FIGURED.fullmatch(low):
            return None
        found = self.readings(low) + self.split(low)
        if not found and len(low) >= 5 and unsure:
            found = self.near(low)
        if not found:
            return None
        s = max(found)[1]
        return " ".join([self.dress(s.split(" ")[0], w), self.after(s.split(" ")[1], w)]) if " " in s else self.dress(s, w)

    def after(self, low: str, w: str) -> str:
        """The second of two words run together, in the case it has in ``w``."""
        return w[len(w) - len(low) :]

    def joined(self, a: str, b: str) -> str:
        """A word broken over two lines: ``a`` without its break mark, ``b`` the rest."""
        whole, kept = a + b, a + "-" + b
        n, k = self.count(whole), self.count(kept)
        if k > n or (n == 0 and k == 0 and b[:1].isupper() and not a.isupper()):
            return kept
        if n == 0:
            fixed = self.readings(whole.lower())
            fixed_kept = self.readings(kept.lower())
            if fixed or fixed_kept:
                s, like = max((v, s) for v, s in fixed + fixed_kept)[1], whole
                return self.dress(s, like)
        return whole

    def unmarked(self, left: str, right: str) -> str | None:
        """The word broken over two lines without a mark, if neither the parts nor their repairs but the whole is known."""
        a, b = core(left), core(right)
        if not a or not b or not left[-1:].isalpha() or not right[:1].islower() or (self.count(a) and self.count(b)) or CJK.search(a):
            return None
        return a + b if self.count(a + b) >= 2 else None

    def strange_cjk(self, t: str) -> list[tuple[int, list[int]]]:
        """Places of Han and kana characters none of whose trigrams is known, and where these begin."""
        tri = [self.trigrams.get(t[i : i + 3], 0) for i in range(len(t) - 2)]
        out = []
        for i, c in enumerate(t):
            spans = [k for k in (i - 2, i - 1, i) if 0 <= k < len(tri)]
            if CJK.match(c) and spans and not any(tri[k] for k in spans):
                out.append((i, spans))
        return out

    def misread_cjk(self, chars: list[str]) -> dict[int, str]:
        """Characters of a run of Han or kana text that fit none of their contexts, and the one that fits all."""
        t = "".join(chars)
        out = {}
        for i, spans in self.strange_cjk(t):
            c = t[i]
            options = set(self.thirds.get(t[i - 2 : i], ())) if i >= 2 else set()
            if not options:
                options = {x for x in (y for g in LOOKALIKES if c in g for y in g)}
            best = None
            for x in options:
                if x == c or not CJK.match(x):
                    continue
                s = t[:i] + x + t[i + 1 :]
                n = [self.trigrams.get(s[k : k + 3], 0) for k in spans]
                alike = frozenset((x, c)) in _LOOKS
                if min(n) >= (1 if alike else 3) and (alike or len(n) > 1):
                    v = sum(map(math.log, n)) + 4 * alike
                    if best is None or v > best[0]:
                        best = (v, x)
            if best:
                out[i] = best[1]
        return out


def script(c: str) -> str:
    o = ord(c)
    return "cyr" if 0x400 <= o < 0x530 else "dev" if 0x900 <= o < 0x980 else "lat" if o < 0x250 else "other"


def place(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % FILTER_BITS


def in_filter(s: str, bits: bytes) -> bool:
    h = place(s)
    return bool(bits[h >> 3] >> (h & 7) & 1)


@lru_cache(maxsize=200_000)
def is_speck(text: str) -> bool:
    return bool(text) and all(c in SPECKS for c in text) and text not in ("...",)


@dataclass
class Page:
    page_id: int
    lines: list[list[Word]]
    states: list[str]


def body_lines(p: Page) -> list[list[Word]]:
    return [[w for w in ws if not is_speck(w.text)] for ws, s in zip(p.lines, p.states) if s in ("body", "break")]


def characters(flat: list[Word]) -> tuple[list[tuple[Word, int]], list[str]]:
    """The characters of words as the trigrams have them, and the word and place each comes from."""
    owner, chars = [], []
    for w in flat:
        for j, c in enumerate(w.text):
            if c.isspace():
                continue
            if c.isdigit():
                if chars and chars[-1] == "0":
                    continue
                c = "0"
            owner.append((w, j))
            chars.append(c)
    return owner, chars


def questions(p: Page, before: str | None, follow: str | None, lex: Lexicon) -> tuple[set[str], set[str]]:
    """What ``repairs`` may have to know of a page beyond ``lex``: words, and trigrams with one character left open."""
    body = [ws for ws in body_lines(p) if ws]
    flat = [w for ws in body for w in ws]
    words = set()
    for t in {w.text for w in flat}:
        if (low := core(t).lower()) not in lex.words:
            words |= {low, EDGES_BUT_MARK.sub("", t).lower()}
    ends = [(ws[-1].text, nxt[0].text) for ws, nxt in zip(body, body[1:])]
    if body:
        ends += [(x, y) for x, y in ((before, flat[0].text), (flat[-1].text, follow)) if x and y]
    for x, y in ends:
        a, b = core(x).lower(), core(y).lower()
        words |= {a, b, a + b, f"{a}-{b}"}
    t = "".join(characters(flat)[1])
    open_ = {s for i, spans in lex.strange_cjk(t) for k in spans if len(t[k : k + 3]) == 3 for s in [t[k : i] + "\0" + t[i + 1 : k + 3]]}
    return {w for w in words if w and w not in lex.words and LETTER.search(w) and not CJK.search(w)}, open_


def repairs(p: Page, before: str | None, follow: str | None, lex: Lexicon) -> list[tuple[int, str, str]]:
    """(word_index, kind, repaired) of every place of a page to repair.

    ``before`` is the last word of the body of the page before, ``follow`` the first of that of the next page.
    """
    out: list[tuple[int, str, str]] = []
    for ws, s in zip(p.lines, p.states):
        if s in ("header", "page_number"):
            out.append((ws[0].index, s, ""))
        else:
            out += [(w.index, "speck", "") for w in ws if is_speck(w.text)]
    body = [ws for ws in body_lines(p) if ws]
    done = set()
    for i, ws in enumerate(body):
        last = ws[-1]
        nxt = body[i + 1][0] if i + 1 < len(body) else None
        rest = nxt.text if nxt else follow if i + 1 == len(body) else None
        if BROKEN.search(last.text) and rest and LETTER.match(EDGES.sub("", rest)[:1] or " "):
            a, b = EDGES.sub("", last.text), EDGES.sub("", rest)
            out.append((last.index, "hyphen", lex.joined(a, b)))
            done.add(last.index)
            if nxt:
                done.add(nxt.index)
        elif rest and (whole := lex.unmarked(last.text, rest)):
            out.append((last.index, "hyphen", whole))
            done.add(last.index)
            if nxt:
                done.add(nxt.index)
    flat = [w for ws in body for w in ws]
    for k, w in enumerate(flat):
        # a first word may be the rest of one broken on the page before
        if w.index in done or (k == 0 and before and (BROKEN.search(before) or lex.unmarked(before, w.text))):
            continue
        fixed = lex.repair(w.text, w.conf)
        if fixed is not None and fixed != core(w.text):
            out.append((w.index, "misread", fixed))
    owner, chars = characters(flat)
    if any(CJK.match(c) for c in chars):
        fix: dict[int, dict[int, str]] = {}
        by = {w.index: w for w in flat}
        for i, c in lex.misread_cjk(chars).items():
            w, j = owner[i]
            fix.setdefault(w.index, {})[j] = c
        for index, change in fix.items():
            t = list(by[index].text)
            for j, c in change.items():
                t[j] = c
            out.append((index, "misread", core("".join(t))))
    return sorted(set(out))


def readable(p: Page, before: str | None, follow: str | None, lex: Lexicon) -> str:
    """The page's body as paragraphs parted by blank lines, repaired."""
    fixes = {i: (k, r) for i, k, r in repairs(p, before, follow, lex)}
    paras: list[list[str]] = [[]]
    skip_first = False
    for ws, s in zip(p.lines, p.states):
        if s in ("header", "page_number"):
            continue
        for w in ws:
            kind, r = fixes.get(w.index, ("", ""))
            if kind == "speck":
                continue
            if skip_first:
                skip_first = False
                if paras[-1]:
                    paras[-1][-1] += EDGES.search(w.text[::-1]).group(0)[::-1] if not w.text[-1:].isalnum() and EDGES.search(w.text) else ""
                continue
            if kind == "hyphen":
                paras[-1].append(r)
                skip_first = True
            elif kind == "misread":
                c = core(w.text)
                paras[-1].append(w.text.replace(c, r, 1) if c in w.text else r)
            else:
                paras[-1].append(w.text)
        if s == "break" and paras[-1] and not skip_first:
            paras.append([])
    join = lambda ws: "".join(a + ("" if CJK.search(a[-1:]) or CJK.search(b[:1]) or a[-1:] in "。、！？」』" else " ") for a, b in zip(ws, [*ws[1:], ""])).strip()
    return "\n\n".join(join(ws) for ws in paras if ws)


# ---- Spark side


def page_words(words: DataFrame) -> DataFrame:
    """One row per page with its words in reading order; repeated rows count once, of clashing rows the smallest holds."""
    one = words.where("page_id is not null and word_index is not null").groupBy("page_id", "word_index").agg(
        F.min(F.struct(F.coalesce("line_index", F.lit(0)).alias("line"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("x", F.lit(0)).cast("double").alias("x"), F.coalesce("w", F.lit(0)).cast("double").alias("w"), F.coalesce("confidence", F.lit(-1.0)).alias("conf"))).alias("v")
    )
    one = one.where(F.length(F.trim("v.text")) > 0)
    rows = one.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("word_index").alias("index"), "v.line", "v.text", "v.x", "v.w", "v.conf"))).alias("words"))
    return rows.select("page_id", *[F.col(f"words.{c}").alias(f"w_{c}") for c in CELLS])


#: A page's words go to Python as one array for each of their values.
CELLS = {"index": "int", "line": "int", "text": "string", "x": "double", "w": "double", "conf": "double"}
COLUMNS = [f"w_{c}" for c in CELLS]


def pages_of(pdf: pd.DataFrame) -> Iterator[list[list[Word]]]:
    """The lines of each page of a batch."""
    for cells in zip(*(pdf[c] for c in COLUMNS)):
        yield lines_of([Word(*w) for w in zip(*(c.tolist() if isinstance(c, np.ndarray) else c for c in cells))])


def title_counts(pages: DataFrame) -> DataFrame:
    """(page_id, line, n) for each line at a page's edge: on how many pages its title stands at an edge.

    0 where the text stands inside pages too, as body text does. A line that no stop ends and that is much like a title of
    ``TITLE_PAGES`` pages or more counts as one, as it may be misread (:func:`misread_titles`).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, lines in zip(pdf.page_id, pages_of(pdf)):
                own = []
                for i, ws in enumerate(lines):
                    edge, t = i < 2 or i >= len(lines) - 2, " ".join(w.text for w in ws)
                    own += [(ws[0].line, k, edge, edge and bool(STOP.search(t))) for k in title_keys(t)]
                rows.append((pid, *map(list, zip(*own))) if own else (pid, [], [], [], []))
            yield pd.DataFrame(rows, columns=["page_id", "line", "key", "edge", "stop"])

    # one row a page where it is written and read again, one a line from there on
    keys = cut(pages.mapInPandas(run, "page_id long, line array<int>, key array<string>, edge array<boolean>, stop array<boolean>"))
    keys = keys.select("page_id", F.inline(F.arrays_zip("line", "key", "edge", "stop")))
    n = keys.groupBy(F.col("key").alias("_key")).agg(F.sum(F.col("edge").cast("int")).alias("n"), F.sum((~F.col("edge")).cast("int")).alias("inside"))
    n = cut(n.where("n > 1 and inside * 4 <= n").select("_key", "n"))
    edges = cut(lookup(keys.where("edge"), "key", n, "_key").select("page_id", "line", "key", "stop", "n"))
    rest = edges.where(f"not stop and coalesce(n, 0) < {TITLE_PAGES}").select("key").distinct()
    alike = cut(misread_titles(rest, n.where(F.col("n") >= TITLE_PAGES).select(F.col("_key").alias("key"))).select(F.col("key").alias("_key"), F.lit(TITLE_PAGES).cast("long").alias("m")))
    both = lookup(edges, "key", alike, "_key").withColumn("n", F.greatest("n", F.when(~F.col("stop"), F.col("m"))))
    return both.where("n is not null").groupBy("page_id", "line").agg(F.max("n").alias("n"))


def misread_titles(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Those keys of ``lines`` that share ``ALIKE`` of their trigrams with one of ``titles`` (both: key, distinct).

    Every pair that can reach the share is tested: two sets of which so much is common have one of their rarest
    trigrams in common, if so many of each are looked at as the share lets go, and on these they are joined. Rarest is
    what the fewest titles have; trigrams of a line that no title has are the rarest, and a line with too many of them
    is out at once.
    """
    gram = lambda df: df.select("key", F.array_distinct(F.expr("transform(sequence(1, length(key)), i -> substring(concat(' ', key, ' '), i, 3))")).alias("grams"))
    one, two = cut(gram(lines).where(F.size("grams") >= 6)), cut(gram(titles))
    of_titles = two.select("key", F.size("grams").alias("k"), F.explode("grams").alias("gram"))
    often = cut(of_titles.groupBy(F.col("gram").alias("_g")).agg(F.count("*").alias("c")))

    def rarest(each: DataFrame) -> DataFrame:
        """Of each set of k trigrams the rarest of which one must be in any set that is alike."""
        own = each.join(often, F.col("gram") == F.col("_g")).groupBy("key", "k").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("g"))
        # it shares at least k * ALIKE / (2 - ALIKE) of them, so one of the first of all its k; those in no title come first
        head = (F.size("g") - F.ceil(F.col("k") * F.lit(ALIKE / (2 - ALIKE)) - 1e-9) + 1).cast("int")
        return own.withColumn("head", head).where("head > 0").select("key", F.explode(F.slice("g", F.lit(1), F.col("head"))).alias("h")).select("key", F.col("h.gram").alias("gram"))

    t = rarest(of_titles).select(F.col("key").alias("title"), F.col("gram").alias("_t"))
    met = rarest(one.select("key", F.size("grams").alias("k"), F.explode("grams").alias("gram"))).join(t, F.col("gram") == F.col("_t")).select("key", "title").distinct()
    full = met.join(one.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k")).join(two.select(F.col("key").alias("_t"), F.col("grams").alias("other")), F.col("title") == F.col("_t"))
    share = 2 * F.size(F.array_intersect("grams", "other")) >= F.lit(ALIKE) * (F.size("grams") + F.size("other"))
    return full.where(share).select("key").distinct()


@dataclass
class Rare:
    """Entries of the lexicon below the share that is held in memory, as tables, and a filter of their beginnings."""

    words: DataFrame
    trigrams: DataFrame
    bits: bytes


def lexicon(typed: DataFrame, text_col: str) -> tuple[Lexicon, Rare | None]:
    """Words and trigrams that typed texts have twice or more.

    Those with at least ``LEAST_SHARE`` of all, at most 1/share of each, come as a lexicon, the others as tables.
    """
    t = typed.select(F.col(text_col).alias("t")).where("t is not null")
    w = t.select(F.explode(F.split("t", r"\s+")).alias("w")).select(F.regexp_replace("w", r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$", "").alias("w"))
    w = w.where(F.col("w").rlike(r"\p{L}") & ~F.col("w").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"))
    w = w.groupBy("w").agg(F.count("*").alias("n"))
    words = w.groupBy(F.lower("w").alias("low")).agg(F.sum("n").alias("n"), F.max(F.struct("n", "w")).alias("m")).select("low", "n", F.col("m.w").alias("w"))
    flat = t.where(F.col("t").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")).select(F.regexp_replace(F.regexp_replace("t", r"\s+", ""), r"[0-9０-９]+", "0").alias("t"))
    # runs with Han or kana in them and one character of what surrounds them
    runs = flat.select(F.explode(F.expr(r"regexp_extract_all(t, '.?[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}0、。，！？「」『』（）…：；．“”ー々]{2,}.?', 0)")).alias("t"))
    tri = runs.where(F.length("t") >= 3).select(F.explode(F.expr("transform(sequence(1, length(t) - 2), i -> substring(t, i, 3))")).alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    words, tri = cut(words.where("n > 1")), cut(tri.where("n > 1"))
    sums = [df.agg(F.sum("n")).first()[0] or 0 for df in (words, tri)]
    w, g = (F.col("n") >= math.ceil(s * LEAST_SHARE) for s in sums)
    letters = words.select(F.explode(F.split("low", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    common, grams = words.where(w).toPandas(), tri.where(g).toPandas()
    lex = Lexicon(dict(zip(common.low, zip(common.n.tolist(), common.w))), dict(zip(grams.g, grams.n.tolist())), [(r[0], r[1]) for r in letters], sums[0])
    rare, rare_grams = words.where(~w), tri.where(~g)
    if rare.isEmpty() and rare_grams.isEmpty():
        return lex, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bytearray(FILTER_BITS // 8)
        for pdf in batches:
            for low in pdf.low:
                for i in range(1, len(low) + 1):
                    h = place(low[:i])
                    bits[h >> 3] |= 1 << (h & 7)
        yield pd.DataFrame({"bits": [bytes(bits)]})

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rare.select("low").coalesce(8).mapInPandas(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(bytes(r[0]), np.uint8)
    return lex, Rare(rare, rare_grams, bits.tobytes())


_HELD: list[tuple[tuple, Lexicon]] = []


def held_lexicon(parts: tuple) -> Lexicon:
    """The lexicon of a broadcast value, made once in each worker."""
    if not _HELD or _HELD[0][0] is not parts:
        _HELD[:] = [(parts, Lexicon(*parts))]
    return _HELD[0][1]


def rare_entries(lab: DataFrame, share: object, rare: Rare) -> DataFrame:
    """(page_id, entries): the rarer words and trigrams (word null) that a page may need."""
    bits = lab.sparkSession.sparkContext.broadcast(rare.bits)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = held_lexicon(share.value)
        for pdf in batches:
            rows = []
            for pid, lines, states, *near in zip(pdf.page_id, pages_of(pdf), pdf.states, pdf.before, pdf.follow):
                words, grams = questions(Page(pid, lines, list(states)), *(v if isinstance(v, str) else None for v in near), lex)
                rows.append((pid, [*words, *grams]))
            yield pd.DataFrame(rows, columns=["page_id", "s"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = held_lexicon(share.value)
        for pdf in batches:
            rows = [(s, c) for s in pdf.s for c in sorted(lex.candidates(s, bits.value))]
            yield pd.DataFrame(rows, columns=["s", "c"])

    asked = cut(lab.mapInPandas(ask, "page_id long, s array<string>")).select("page_id", F.explode("s").alias("s"))
    is_gram = F.contains("s", F.lit("\0"))
    may = spread(cut(asked.where(~is_gram).select("s").distinct()), "s").mapInPandas(answer, "s string, c string")
    words = may.join(rare.words, F.col("c") == F.col("low")).select("s", F.struct("low", "n", "w").alias("e"))
    hole = lambda i: F.concat(F.expr(f"substring(g, 1, {i})"), F.lit("\0"), F.expr(f"substring(g, {i + 2}, 3)"))
    grams = rare.trigrams.select("g", "n", F.explode(F.array(*map(hole, range(3)))).alias("s"))
    grams = grams.join(asked.where(is_gram).select("s").distinct(), "s", "left_semi").select("s", F.struct(F.col("g").alias("low"), "n", F.lit(None).cast("string").alias("w")).alias("e"))
    found = cut(words.unionByName(grams).groupBy("s").agg(F.collect_list("e").alias("e")).withColumnRenamed("s", "_s"))
    return lookup(asked, "s", found, "_s").where("e is not null").groupBy(F.col("page_id").alias("_p")).agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("entries"))


def labelled_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with the kind of each line: page_id, document_id, page_index, w_..., states, first, last, before, follow.

    ``first`` and ``last`` are the outer words of the page's body, ``before`` and ``follow`` the ones next to
    them on the neighbouring pages of the document. A page
    without a row in ``pages`` has no neighbours.
    """
    pw = cut(page_words(words))
    counts = title_counts(pw).groupBy(F.col("page_id").alias("_p")).agg(F.map_from_entries(F.collect_list(F.struct("line", "n"))).alias("repeats"))
    full = cut(pw.join(counts, F.col("page_id") == F.col("_p"), "left").select("page_id", *COLUMNS, "repeats"))
    rows = full.orderBy(F.xxhash64("page_id"), "page_id").limit(FIT_PAGES).toPandas()
    model = fit_lines([(lines, dict(rep) if rep is not None else {}) for lines, rep in zip(pages_of(rows), rows.repeats)])
    share = full.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = share.value
        for pdf in batches:
            states, first, last = [], [], []
            for lines, rep in zip(pages_of(pdf), pdf.repeats):
                s = m.label(lines, dict(rep) if rep is not None else {})
                body = [w for ws in body_lines(Page(0, lines, s)) for w in ws]
                states.append(s)
                first.append(body[0].text if body else None)
                last.append(body[-1].text if body else None)
            yield pdf[["page_id", *COLUMNS]].assign(states=states, first=first, last=last)

    kind = "page_id long, " + ", ".join(f"w_{c} array<{t}>" for c, t in CELLS.items()) + ", states array<string>, first string, last string"
    lab = cut(full.mapInPandas(run, kind))
    meta = pages.select(F.col("page_id").alias("_p"), "document_id", "page_index").where("_p is not null").groupBy("_p").agg(F.min("document_id").alias("document_id"), F.min("page_index").alias("page_index"))
    lab = lab.join(meta, F.col("page_id") == F.col("_p"), "left").drop("_p")
    placed = lab.where("document_id is not null and page_index is not null").groupBy("document_id", "page_index").agg(F.min("first").alias("f"), F.max("last").alias("l"))
    for shift, word, name in ((-1, "f", "follow"), (1, "l", "before")):
        near = placed.select(F.col("document_id").alias("_d"), (F.col("page_index") + shift).alias("_i"), F.col(word).alias(name))
        lab = lab.join(near, (F.col("document_id") == F.col("_d")) & (F.col("page_index") == F.col("_i")), "left").drop("_d", "_i")
    return lab


def _per_page(lab: DataFrame, known: tuple[Lexicon, Rare | None], row, schema: str) -> DataFrame:
    lex, rare = known
    share = lab.sparkSession.sparkContext.broadcast((lex.words, lex.trigrams, lex.letters, lex.total))
    kept = ["page_id", "document_id", "page_index", *COLUMNS, "states", "before", "follow"]
    if rare is None:
        lab = lab.select(*kept, F.lit(None).cast("array<string>").alias("e_low"), F.lit(None).cast("array<bigint>").alias("e_n"), F.lit(None).cast("array<string>").alias("e_w"))
    else:
        lab = cut(lab)
        lab = lab.join(rare_entries(lab, share, rare), F.col("page_id") == F.col("_p"), "left").select(*kept, *[F.col(f"entries.{c}").alias(f"e_{c}") for c in ("low", "n", "w")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held_lexicon(share.value)
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            out = []
            for r, lines in zip(pdf[[c for c in pdf.columns if c not in COLUMNS]].itertuples(), pages_of(pdf)):
                page = Page(r.page_id, lines, list(r.states))
                more = [] if r.e_low is None else list(zip(r.e_low, r.e_n, r.e_w))
                words, grams = {low: (int(n), w) for low, n, w in more if w is not None}, {low: int(n) for low, n, w in more if w is None}
                with own.extend(words, grams):
                    out += row(r, page, *(v if isinstance(v, str) else None for v in (r.before, r.follow)), own)
            yield pd.DataFrame(out, columns=names)

    return lab.mapInPandas(run, schema)


def page_repairs(words: DataFrame, pages: DataFrame, typed: DataFrame, text_col: str = "body") -> DataFrame:
    """Every place to repair: page_id, word_index, kind, repaired.

    Words with a null page or index and blank words are ignored; null confidences count as unknown. Empty
    tables give an empty result; further columns are not looked at.
    """
    return _per_page(labelled_pages(words, pages), lexicon(typed, text_col), lambda r, p, b, f, lex: [(r.page_id, *x) for x in repairs(p, b, f, lex)], "page_id long, word_index int, kind string, repaired string")


def page_texts(words: DataFrame, pages: DataFrame, typed: DataFrame, text_col: str = "body") -> DataFrame:
    """Each page's body as readable paragraphs: page_id, document_id, page_index, text."""
    lab = labelled_pages(words, pages)
    row = lambda r, p, b, f, lex: [(r.page_id, r.document_id if r.document_id == r.document_id else None, r.page_index if r.page_index == r.page_index else None, readable(p, b, f, lex))]
    return _per_page(lab, lexicon(typed, text_col), row, "page_id long, document_id long, page_index int, text string")
