"""Sentence units across languages and scripts.

Candidate boundaries are (1) runs of stop marks with the closing marks behind them and (2), in stretches of
Han or kana text that no stop mark ends (old documentary style), every gap between characters. Each candidate
is classified by a maximum-entropy model over the neighbouring tokens, case, length, digits and script.

The model is trained on reliable boundaries: the end of a paragraph is one, and pairing the left side of one
paragraph end with the right side of another paragraph's start gives positives. Candidates inside paragraphs
are of unknown kind and stand against them, so the model estimates how much likelier a context is at a
reliable boundary than inside; a context never seen at a paragraph end (an abbreviation) falls far below.
Blank lines always end a unit, and stops inside a quotation or bracket that is closed later never do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import maxent
from corpusloom.session import ample

#: Documents the model is fitted on (those with the smallest hash of the id).
FIT_DOCS = 4000
#: Longer texts are not fitted on, so that the sample has a bound in bytes too.
FIT_CHARS = 20_000
#: A context so much rarer (natural log) at reliable boundaries than inside paragraphs is no boundary.
STOP_LEVEL, GAP_LEVEL = -1.5, 0.0

BREAK = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
STOP = regex.compile(r"[.!?…。！？．।॥؟]+(?:\s?[»›]|[”’\"')\]』」）〉》】“]|[.!?。！？।])*")
CJK = r"\p{Han}\p{Hiragana}\p{Katakana}々〆ー"
IS_CJK = regex.compile(f"[{CJK}]")
RUN = regex.compile(f"[{CJK}0-9０-９　 \n]*[{CJK}][{CJK}0-9０-９　 \n]*")
#: Nothing below these is Han or kana.
EASTERN = re.compile("[\u2e80-\U0003ffff]")
OPENERS = regex.compile(r"[“„«‹「『（(\[《〈]")
DIGIT, ASCII_DIGIT = regex.compile(r"\d"), re.compile("[0-9]")
WORD_RIGHT = regex.compile(r"[\p{L}\p{M}\p{N}'’\-]+|\S")
CLAUSE = regex.compile(r"[^。！？!?…]*")
PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "〈": "〉", "《": "》", "【": "】", "«": "»", "‹": "›"}
CLOSE = {v: k for k, v in PAIRS.items()}
MARKS = re.compile("[" + "".join(map(re.escape, [*PAIRS, *CLOSE, *"„“”"])) + "]")
#: Scores that a model remembers of each kind before it starts anew.
REMEMBERED = 200_000
# Common abbreviations that a capital may follow.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof rev hon capt col gen lt sgt st ste messrs jr sr no nos vol vols p pp ch fig cf vs viz ca approx ed eds trans op cit al i.a i.e e.g d b r hr fr frau hrn nr bd bde s vgl z u abschn bzw usw evtl "
    "m mm mme mlle mgr t chap env n av sra srta d dª dña núm pág págs art ud uds vda exc ilmo r aprox cap fl sto sta exmo v г гг т тт с стр см гл им ул д р руб коп кн св проф п डॉ पृ श्री सं c.-à-d".split()
)

Span = tuple[int, int]


def paragraphs(text: str) -> list[Span]:
    """Stretches between blank lines, trimmed; blank ones are left out."""
    out, at = [], 0
    for m in [*BREAK.finditer(text), None]:
        a, z = at, m.start() if m else len(text)
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if a < z:
            out.append((a, z))
        at = m.end() if m else z
    return out


def enclosed(p: str) -> list[tuple[int, int, bool]]:
    """Matched quotations and brackets: (open, behind close, opened after a colon)."""
    out: list[tuple[int, int, bool]] = []
    stack: list[tuple[str, int]] = []
    for m in MARKS.finditer(p):
        c, i = m.group(), m.start()
        if c in PAIRS:
            stack.append((PAIRS[c], i))
        elif c == "„":
            stack.append(("“", i))
        elif c == "“" and not (stack and stack[-1][0] == "“"):
            stack.append(("”", i))
        else:
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                want = stack[k][0]
                if c == want or (want in "“”" and c in "“”"):
                    at = stack[k][1]
                    while at and p[at - 1].isspace():
                        at -= 1
                    out.append((stack[k][1], i + 1, p[at - 1 : at] in (":", "：")))
                    del stack[k:]
                    break
    return out


def inside_of(spans: list[tuple[int, int, bool]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, overlapping ones as one."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


@cache
def kind(c: str) -> str:
    if not c:
        return "end"
    if IS_CJK.match(c):
        return "cjk"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "lower" if c.islower() else "upper" if c.isupper() else "letter"
    return "open" if c in "“„«‹「『（(《〈[¿¡" else "close" if c in "”»)]」』）" else "mark"


def word_before(left: str) -> str:
    """What stands before a stop mark behind the last space or opening mark, 40 characters at most."""
    if not left or left[-1].isspace():
        return ""
    w = left[-40:].split()[-1]
    return w if w.isalnum() else OPENERS.split(w)[-1]


def left_features(left: str, mark: str, closed: str) -> list[str]:
    """Features of the text before a stop mark, of the mark and of the kind of closing marks."""
    k = kind(left[-1:])
    tail = mark.rstrip(CLOSERS)
    if k == "cjk":
        return [f"s={tail[:2]}", f"L1={left[-1:]}{tail[-1:]}", f"L2={left[-2:]}{tail[-1:]}", f"L3={left[-3:]}{tail[-1:]}", f"c={closed}", "ls=cjk"]
    w = word_before(left)
    bare = DIGIT.sub("0", w)
    low = bare.lower().strip("”’\"'»)]-—,")
    out = [f"s={tail[:2]}", f"w={low[-14:]}{tail[-1:]}", f"c={closed}", f"ls={k}"]
    if tail == ".":
        letters = sum(ch.isalpha() for ch in low)
        out += [f"n={min(len(low), 5)}:{k}", f"dots={'.' in low}"]
        if low in ABBREVIATIONS or low.split(".")[-1] in ABBREVIATIONS and "." in low:
            out.append("abbr")
        if letters == 1 and w[-1:].isalpha():
            out.append("initial=" + ("U" if w[-1:].isupper() else "l"))
        if low.isdigit():
            out.append(f"num={len(low)}")
    return out


def right_features(right: str, tail: str, spaced: bool) -> list[str]:
    """Features of the text behind a candidate; ``tail`` is the last stop character before it."""
    k = kind(right[:1])
    w = WORD_RIGHT.match(right)
    first = w.group(0) if w else ""
    out = [f"r={k}"]
    dot = "." if tail in ".…" else "!"
    if k == "cjk":
        clause = clause_of(right)
        out += [f"R1={right[:1]}", f"R2={right[:2]}", f"cl={clause[-2:]}:{len(clause) < 12}"]
    else:
        out += [f"rw={ASCII_DIGIT.sub('0', first)[:14]}", f"r{dot}={k}"]
    return out


CLOSE_QUOTE = regex.compile(r"[”』」）]")
CLOSERS = "”’\"')]』」）〉》】“»› \n"


def clause_of(right: str) -> str:
    """What follows a stop up to the next one, 60 characters at most, without closing quotes."""
    return CLOSE_QUOTE.sub("", CLAUSE.match(right[:60]).group(0))


@dataclass
class Candidate:
    at: int
    left: str
    mark: str
    right: str
    closed: str

    def features(self) -> list[str]:
        tail = self.mark.rstrip(CLOSERS)[-1:]
        lf = left_features(self.left, self.mark, self.closed)
        rf = right_features(self.right, tail, True)
        return lf + rf + [f"{self.closed}:{rf[0]}:{lf[-1] == 'abbr'}"]


def candidates(p: str) -> list[Candidate]:
    """Stop candidates strictly inside a paragraph that no open quotation or bracket holds."""
    spans = enclosed(p)
    closing = {b: (a, colon) for a, b, colon in spans}
    starts, ends = inside_of(spans)
    out = []
    for m in STOP.finditer(p):
        z = m.end()
        # an opening quote is no closing mark
        while z > m.start() + 1 and p[z - 1] in "“«" and z not in closing:
            z -= 1
        while z > m.start() and p[z - 1].isspace():
            z -= 1
        rest = p[z : z + 80]
        right = rest.lstrip()
        if not right:
            continue
        k = bisect_left(starts, z) - 1
        if k >= 0 and z < ends[k] and any(a < z < b for a, b, _ in spans):
            continue
        left = p[max(0, m.start() - 40) : m.start()].rstrip()
        spaced = len(right) < len(rest)
        if not spaced and p[m.start()] in ".…!?":
            a, b = kind(p[z - 1] if z - m.start() > 1 else left[-1:]), kind(right[:1])
            word = word_before(left)
            if b in ("lower", "digit", "mark", "close") or (b in ("upper", "letter") and (len(word.strip(".")) < 3 or "." in word or "/" in word or "@" in word)):
                continue
            if a == "digit" and b == "digit":
                continue
        held = closing.get(z)
        closed = "no" if held is None else "colon" if held[1] else "start" if not held[0] else "yes"
        out.append(Candidate(z, left, p[m.start() : z], right, closed))
    return out


def gap_runs(p: str) -> list[Span]:
    """Stretches of unpunctuated Han or kana text: nothing but the paragraph's end or another script ends them."""
    out = []
    for m in RUN.finditer(p) if EASTERN.search(p) else ():
        nxt = p[m.end() : m.end() + 1]
        if len(IS_CJK.findall(m.group(0))) >= 12 and (not nxt or nxt.isalpha() or nxt in "“„«"):
            out.append(m.span())
    return out


def gap_features(left: str, right: str) -> list[str]:
    return [f"g1={left[-1:]}", f"g2={left[-2:]}", f"g3={left[-3:]}", f"h1={right[:1]}", f"h2={right[:2]}", f"h3={right[:3]}", f"b={left[-1:]}{right[:1]}"]


def gaps(p: str, span: Span) -> Iterator[tuple[int, str, str]]:
    """Gaps between characters of a run, blanks skipped, with the three characters on either side."""
    a, z = span
    at = [i for i in range(a, z) if not p[i].isspace()]
    t = "".join([p[i] for i in at])
    for k in range(4, len(at) - 3):
        if kind(t[k - 1]) == "cjk":
            yield at[k - 1] + 1, t[k - 3 : k], t[k : k + 3]


#: What marks, case and script say before anything is seen; words and phrases are learnt.
STOP_PRIOR = {
    "s=。": 2.0, "s=！": 2.0, "s=？": 2.0, "s=।": 2.0, "s=!": 0.5, "s=?": 0.5, "r=upper": 0.5, "r=lower": -5.0, "r=mark": -4.0, "r=close": -4.0,
    "abbr": -4.0, "initial=U": -3.5, "initial=l": -3.0, "dots=True": -0.5, "r.=lower": -1.0, "num=1": -1.0, "num=2": -1.0,
}
GAP_BIAS = -2.5


@dataclass
class SentenceModel:
    """Fitted weights of both candidate kinds."""

    stop: np.ndarray
    gap: np.ndarray
    #: Scores by what they depend on: words before and behind a stop, characters around a gap.
    known: dict[tuple, tuple[float, str]] = field(default_factory=dict)

    def __getstate__(self) -> tuple:
        return self.stop, self.gap

    def __setstate__(self, state: tuple) -> None:
        self.stop, self.gap = state
        self.known = {}

    def remember(self, key: tuple, value: tuple[float, str]) -> tuple[float, str]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[key] = value
        return value

    def stop_score(self, c: Candidate) -> float:
        """Score of all features of a stop candidate, by the halves that they come from."""
        tail = c.mark.rstrip(CLOSERS)
        east = kind(c.left[-1:]) == "cjk"
        key = (c.left[-3:] if east else word_before(c.left), c.left[-1:], tail[:2], tail[-1:], c.closed)
        if (left := self.known.get(key)) is None:
            f = left_features(c.left, c.mark, c.closed)
            left = self.remember(key, (maxent.total(self.stop, f), str(f[-1] == "abbr")))
        k = kind(c.right[:1])
        if k == "cjk":
            clause = clause_of(c.right)
            key = (c.right[:2], clause[-2:], len(clause) < 12)
        else:
            w = WORD_RIGHT.match(c.right)
            key = (w.group(0)[:14] if w else "", k, tail[-1:] in ".…")
        if (right := self.known.get(key)) is None:
            f = right_features(c.right, tail[-1:], True)
            right = self.remember(key, (maxent.total(self.stop, f), f[0]))
        key = (c.closed, right[1], left[1])
        if (both := self.known.get(key)) is None:
            both = self.remember(key, (maxent.total(self.stop, [":".join(key)]) + float(self.stop[0]), ""))
        return left[0] + right[0] + both[0]

    def gap_score(self, left: str, right: str) -> float:
        key = ("gap", left, right)
        if (v := self.known.get(key)) is None:
            v = self.remember(key, (maxent.total(self.gap, gap_features(left, right)) + float(self.gap[0]), ""))
        return v[0]

    def spans(self, text: str | None) -> list[Span]:
        """Sentence units of a text, 0-based half-open code points; none for null or blank texts."""
        out: list[Span] = []
        for a, z in paragraphs(text) if text else []:
            p = text[a:z]
            ends = {c.at for c in candidates(p) if self.stop_score(c) > STOP_LEVEL}
            for run in gap_runs(p):
                ends |= {at for at, left, right in gaps(p, run) if self.gap_score(left, right) > GAP_LEVEL}
                if run[1] < len(p) and run[1] - run[0] > 12:
                    ends.add(run[1])
            at = 0
            for e in [*sorted(ends), len(p)]:
                b = at
                while b < e and p[b].isspace():
                    b += 1
                y = e
                while y > b and p[y - 1].isspace():
                    y -= 1
                if b < y:
                    out.append((a + b, a + y))
                at = e
        return out


def fit_sentences(texts: list[str], seed: int = 0) -> SentenceModel:
    """Fit both models on texts; without a boundary or without anything to set against it the priors alone hold."""
    rng = np.random.default_rng(seed)
    ends, starts, inside, gap_in, gap_end, gap_start = [], [], [], [], [], []
    for t in texts:
        for a, z in paragraphs(t or ""):
            p = t[a:z]
            starts.append(p[:80])
            found = candidates(p)
            inside += found
            m = None
            for m in STOP.finditer(p):
                pass
            if m and m.end() == len(p):
                held = [s for s in enclosed(p) if s[1] == len(p)]
                closed = "no" if not held else "colon" if held[-1][2] else "start" if held[-1][0] == 0 else "yes"
                ends.append((p[max(0, m.start() - 40) : m.start()].rstrip(), m.group(0), closed))
            for run in gap_runs(p):
                gap_in += [gap_features(left, right) for _, left, right in gaps(p, run)]
                s = "".join(p[run[0] : run[1]].split())
                if run[1] == len(p):
                    gap_end.append(s[-3:])
                if run[0] == 0:
                    gap_start.append(s[:3])
    w_stop, w_gap = maxent.prior(STOP_PRIOR, 1.0), maxent.prior({}, GAP_BIAS)

    def both(pos: list[list[str]], neg: list[list[str]], w0: np.ndarray) -> np.ndarray:
        if not pos or not neg:
            return w0
        y = np.r_[np.ones(len(pos)), np.zeros(len(neg))]
        weight = np.where(y == 1, len(neg) / len(pos), 1.0)
        return maxent.fit(maxent.matrix(pos + neg), y, weight, w0)

    pos = []
    if ends and starts:
        pick = rng.integers(0, len(starts), len(ends))
        # a right side in the same kind of script, as where one language goes on
        in_cjk = lambda s: bool(IS_CJK.search(s[:6]))
        by = {v: [s for s in starts if in_cjk(s) == v] for v in (True, False)}
        for (left, mark, closed), j in zip(ends, pick):
            pool = by[bool(IS_CJK.match(left[-1:] or " "))] or starts
            pos.append(Candidate(0, left, mark, pool[j % len(pool)], closed).features())
    stop = both(pos, [c.features() for c in inside], w_stop)
    gpos = [gap_features(e, gap_start[rng.integers(len(gap_start))]) for e in gap_end] if gap_start else []
    return SentenceModel(stop, both(gpos, gap_in, w_gap))


def fit_on(df: DataFrame, id_col: str, text_col: str, docs: int = FIT_DOCS) -> SentenceModel:
    """Fit on the ``docs`` rows with the smallest hash of the id (no row is labelled; the bound is on fitting only)."""
    rows = df.where(F.length(text_col) <= FIT_CHARS).select(id_col, text_col).orderBy(F.xxhash64(id_col), id_col).limit(docs).collect()
    return fit_sentences([r[1] for r in rows])


def sentence_units(df: DataFrame, model: SentenceModel, id_col: str = "id", text_col: str = "body", *, with_text: bool = False) -> DataFrame:
    """One row per sentence unit: id, char_start, char_end, and with ``with_text`` the unit's text.

    Every document is split whole where it is read; nothing is shuffled. Null and blank texts have no units,
    rows with a null id are ignored, repeated rows repeat their units, an empty table gives none; further columns
    are not looked at.
    """
    share = df.sparkSession.sparkContext.broadcast(model)
    names = ["id", "char_start", "char_end", *["text"] * with_text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = share.value
        for pdf in batches:
            rows = [(i, a, z, *[t[a:z]] * with_text) for i, t in zip(pdf.id, pdf.text) if isinstance(t, str) for a, z in m.spans(t)]
            yield pd.DataFrame(rows, columns=names)

    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return ample(src, "id").mapInPandas(run, "id long, char_start int, char_end int" + ", text string" * with_text)
