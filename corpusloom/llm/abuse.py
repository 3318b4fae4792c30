"""Abusive, hateful or sexually explicit content: a convolutional classifier of sentences.

Tokens are hashed word embeddings plus one for the word's letters in order of the alphabet, so a word with
swapped letters keeps half of its meaning; disguises (odd letters, spaced or masked words, invisible marks) are
undone first. Reviewers label documents, not sentences, and err, so the flagged sentences have to be found:
every sentence of a flagged document is suspect at first, and those stay that networks trained on the other
flagged documents recognise. What only one wrongly flagged document has in common with none drops out.
A document's score is that of its worst sentence; the thresholds are calibrated by language on all labelled
documents that were not fitted on.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.convnet import ConvNet, softmax
from corpusloom.llm.language import by_size, language_code
from corpusloom.llm.sentences import FIT_CHARS
from corpusloom.session import ample, cut

#: Documents fitted on (flagged, clean and not reviewed), tokens of a window, hash slots.
FIT_FLAGGED, FIT_CLEAN, FIT_OTHER, WINDOW, SLOTS = 2500, 4000, 3000, 32, 1 << 15
#: Sentences of clean and of other documents fitted on, and parts of the cross-fitting.
FIT_SENTENCES, FOLDS = 14_000, 3
#: A suspect sentence of which so large a share of token pairs is hardly ever seen elsewhere stays suspect by itself.
NOVEL = 0.7
#: Least excess (natural log) of a suspect sentence's token pairs in flagged over clean documents.
EXCESS = 1.0
#: One labelled document in so many is kept from fitting. When a language's threshold is set, its own documents count
#: beside as many of all languages: so many flagged ones, and so many of all.
HELD, SHARED_FLAGGED, SHARED_DOCS = 5, 25, 1000
#: Classes of scores for the thresholds; between which the emptiest lies; threshold before anything is scored.
BINS, LOW, HIGH, USUAL = 100, 30, 95, 0.5
#: How many made-up flagged documents, spread as those above the emptiest class, stand beside the held-out ones.
MADE_UP = 50
#: Sentences whose scores a task remembers before it starts anew; characters of the texts that it reads at once.
REMEMBERED, CHARS = 100_000, 1_000_000
WIDTHS, DIM, FILTERS = (1, 2, 3, 4), 24, 24

# Letters of other scripts, and figures, that stand for Latin ones.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнοαερυι", "aeopcyxijsdhkmtbhoaepui")
LEET = str.maketrans("013457@$8", "oieastasb")
_INVISIBLE = regex.compile(r"[\p{Cf}\u0300-\u036f]")
_SPACED = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:[\p{Latin}\p{Cyrillic}][ .\-_·]){3,}[\p{Latin}\p{Cyrillic}](?![\p{L}\p{M}\p{N}])")
#: What every spaced word holds, and letters that may stand for Latin ones: cheap tests before the dear ones.
_MAYBE_SPACED = re.compile(r"[ .\-_·]\w[ .\-_·]\w[ .\-_·]")
_MAYBE_ALIKE = re.compile("[аеорсухіјѕԁһοα]")
_MASKED = regex.compile(r"\p{L}+[*#]+\p{L}*|[*#]+\p{L}{2,}")
_END = re.compile(r"(?<=[.!?。！？।…;；])\s*|\n+")
_TOKEN = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{M}\p{N}'’@$*#]--[\p{Han}\p{Hiragana}\p{Katakana}]]+|[!?]")
#: The same for texts in the scripts below U+0590, which have no other marks than these.
_WESTERN = re.compile("[\u0000-\u058f\u2000-\u206f]*")
_WESTERN_TOKEN = re.compile(r"(?:[^\W_]|['’@$*#\u0300-\u036f\u0483-\u0489])+|[!?]")
# A few plain examples of our own, so that a language is not without any before its first reviewed document.
SEED_FLAGGED = (
    "You are an idiot and a coward.", "Shut up, you filthy bastard, or I will kill you.", "Those people are vermin and should all be exterminated.", "Go and hang yourself, you worthless scum.",
    "Du bist ein Idiot und ein dreckiger Lügner.", "Diese Leute sind Ungeziefer und gehören ausgerottet.", "Halt das Maul oder ich bringe dich um.",
    "Tu es un idiot et un sale menteur.", "Ces gens sont de la vermine, il faut les exterminer.", "Ferme ta gueule ou je te tue.",
    "Eres un idiota y un cobarde.", "Esa gente son ratas y hay que exterminarlas.", "Cállate o te mato, hijo de puta.",
    "Você é um idiota e um covarde.", "Essa gente são ratos e é preciso exterminá-los.", "Cala a boca ou eu te mato, filho da puta.",
    "Ты идиот и трус.", "Эти люди паразиты, их надо истребить.", "Заткнись, сволочь, или я тебя убью.",
    "お前は馬鹿だ、死ね。", "あいつらは害虫だ、皆殺しにしろ。", "この馬鹿野郎、黙れ。", "你这个白痴，去死吧。", "这些人都是害虫，应该全部杀光。", "闭嘴，你这个混蛋。",
    "तू बेवकूफ़ और कायर है।", "ये लोग कीड़े हैं, इन सबको मार डालो।", "चुप रह, हरामी, नहीं तो मार डालूँगा।",
)
SEED_CLEAN = (
    "The cat killed three rats in the barn.", "The word idiot was struck from the minutes.", "A coward was punished by the court.", "Gegen das Ungeziefer wurde Schwefel gekauft.", "On acheta du soufre contre la vermine.",
    "Se compró azufre contra las ratas.", "Comprou-se enxofre contra os ratos.", "Против паразитов купили серу.", "害虫の駆除に硫黄を買った。", "买了硫磺来除害虫。", "कीड़ों के लिए गंधक ख़रीदा गया।",
)


def _join(m: regex.Match) -> str:
    """A spaced word in one; if its first letter may be a word of its own, without that too."""
    w = regex.sub(r"[ .\-_·]", "", m.group(0))
    return w + " " + w[1:] if w[0] in "aeioyаиоуя" else w


def plain(text: str) -> str:
    """Lower case without disguises: invisible marks, foreign letters, spaced words, figures for letters."""
    if text.isascii():
        t = text.lower()
    else:
        t = _INVISIBLE.sub("", text)
        t = (t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)).lower()
    if _MAYBE_SPACED.search(t):
        t = _SPACED.sub(_join, t)
    if not t.isascii() and _MAYBE_ALIKE.search(t):
        t = regex.sub(r"[\p{L}\p{M}]+", lambda m: m.group(0).translate(LOOKALIKE) if regex.search(r"[a-z]", m.group(0)) else m.group(0), t)
    return t


@lru_cache(maxsize=200_000)
def token(w: str) -> tuple[str, int, int]:
    """A token without disguise, its slot and the slot of its letters in order (0 for single characters)."""
    if w.isdigit():
        w = "0"
    elif _MASKED.fullmatch(w):
        w = "<mask>"
    elif not w.isalpha() and regex.search(r"\d|[@$]", w) and regex.search(r"[a-z]", w):
        w = w.translate(LEET)
    return w, slot(w), 0 if len(w) == 1 else slot("~" + w[0] + "".join(sorted(w)))


@lru_cache(maxsize=200_000)
def slot(text: str) -> int:
    return crc32(text.encode()) % (SLOTS - 2) + 2


def slots(sentence: str) -> list[tuple[int, int]]:
    """Hash slots of each token: the word, and its letters in order (for single characters: the pair with the next)."""
    find = _WESTERN_TOKEN if sentence.isascii() or _WESTERN.fullmatch(sentence) else _TOKEN
    found = [token(w) for w in find.findall(sentence)]
    return [(a, b or slot("~" + w + (found[i + 1][0] if i + 1 < len(found) else ""))) for i, (w, a, b) in enumerate(found)]


Window = list[tuple[int, int]]


def sentences(text: str) -> list[str]:
    """Sentences of a text, without disguises."""
    return [p for p in _END.split(plain(text)) if p]


def windows_of(sentence: str) -> list[Window]:
    """Token slots of a sentence; a long one gives windows that overlap by half."""
    s = slots(sentence)
    step = WINDOW // 2
    return [s[i : i + WINDOW] for i in range(0, max(1, len(s) - step), step)] if s else []


def windows(text: str) -> list[Window]:
    """The windows of every sentence of a text."""
    return [w for p in sentences(text) for w in windows_of(p)]


def as_ids(parts: list[Window]) -> np.ndarray:
    out = np.zeros((len(parts), WINDOW + max(WIDTHS), 2), np.int64)
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.array([v for p in parts for t in p for v in t], np.int64).reshape(-1, 2)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(parts)), size), at] = flat
    return out


@dataclass
class AbuseModel:
    net: ConvNet
    known: np.ndarray
    threshold: float = USUAL
    by_language: dict[str, float] = field(default_factory=dict)
    #: Scores of sentences met before.
    met: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> tuple:
        return self.net, self.known, self.threshold, self.by_language

    def __setstate__(self, state: tuple) -> None:
        self.net, self.known, self.threshold, self.by_language = state
        self.met = {}

    def ids(self, parts: list[Window]) -> np.ndarray:
        x = as_ids(parts)
        return np.where((x > 1) & ~self.known[x], 1, x)

    def chances(self, parts: list[Window]) -> np.ndarray:
        """How likely each window is to be abusive."""
        return np.concatenate([softmax(self.net.logits(self.ids(parts[s : s + 4096])))[:, 1] for s in range(0, len(parts), 4096)] or [np.empty(0)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text's worst sentence; 0 for null and blank texts."""
        split = [sentences(t) if t else [] for t in texts]
        if len(self.met) > REMEMBERED:
            self.met.clear()
        new = list(dict.fromkeys(p for own in split for p in own if p not in self.met))
        parts = [windows_of(p) for p in new]
        p = self.chances([w for own in parts for w in own])
        at = 0
        for s, own in zip(new, parts):
            self.met[s] = float(p[at : at + len(own)].max()) if own else 0.0
            at += len(own)
        return np.array([max((self.met[p] for p in own), default=0.0) for own in split])

    def limit(self, lang: str | None) -> float:
        return self.by_language.get(language_code(lang) or "", self.threshold)

    def calibrate(self, flagged: dict[tuple[str, int], int], all_docs: dict[tuple[str, int], int]) -> None:
        """Set the thresholds from numbers of held-out flagged documents, and of all documents, by language and class of score.

        A threshold t is the better, the more of the flagged documents and the fewer of all it lets through: the F1
        it would have if as many documents were abusive as lie above the emptiest class. (Clean labels are left
        out: the reviewed documents are no picture of all, and a slip of a reviewer would weigh as many.) A
        language's own documents count beside a share of all, so one with few labels has a threshold near that of all.
        """
        f, n = np.zeros(BINS), np.zeros(BINS)
        own: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for k, (total, counts) in enumerate(((f, flagged), (n, all_docs))):
            for (g, b), c in counts.items():
                total[b] += c
                if g:
                    own.setdefault(g, (np.zeros(BINS), np.zeros(BINS)))[k][b] += c
        gap = emptiest(n)
        above = np.where(np.arange(BINS) >= gap, n + 1e-6, 0)
        f = f + MADE_UP * above / above.sum()
        self.threshold = _best_limit(f, n, gap)
        a, b = min(1.0, SHARED_FLAGGED / f.sum()), min(1.0, SHARED_DOCS / max(1.0, n.sum()))
        self.by_language = {g: _best_limit(x + a * f, y + b * n, gap) for g, (x, y) in own.items()}


def emptiest(n: np.ndarray) -> int:
    """The class of score between ``LOW`` and ``HIGH`` with the fewest documents in and around it, the middle one of equals."""
    k = np.exp(-0.5 * (np.arange(-9, 10) / 3) ** 2)
    smooth = np.convolve(n, k / k.sum(), "same")[LOW:HIGH]
    least = np.flatnonzero(smooth <= smooth.min() + 1e-9 * max(1.0, n.sum()))
    return LOW + int(least[len(least) // 2])


def _train(pos: list, neg: list, known: np.ndarray, seed: int, epochs: int) -> AbuseModel:
    rng = np.random.default_rng(seed)
    model = AbuseModel(ConvNet(SLOTS, 2, DIM, WIDTHS, FILTERS, seed=seed, spread=0.1), known)
    times = max(1, min(20, len(neg) // max(1, 4 * len(pos))))
    x = np.concatenate([model.ids(pos)] * times + [model.ids(neg)])
    y = np.r_[np.ones(len(pos) * times, int), np.zeros(len(neg), int)]
    epochs = max(epochs, -(-400 * 128 // max(1, len(x))))
    for e in range(epochs):
        drop = (rng.random(x.shape[:2]) < 0.1)[:, :, None] & (x > 0)
        model.net.train(np.where(drop, 1, x), y, 1, rate=2e-3 / (1 + 0.5 * e), batch=128, seed=seed + e)
    return model


def _best_limit(flagged: np.ndarray, n: np.ndarray, gap: int) -> float:
    """Threshold up to ``gap`` with the best F1 for flagged and all documents by class of score, the middle one of equals."""
    found, over = flagged[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]
    f1 = found / (over + over[gap] + 1e-6)
    f1[gap + 1 :] = 0
    best = np.flatnonzero(f1 >= f1.max() * (1 - 1e-9))
    return float(best[len(best) // 2] / BINS)


def class_of(score: float) -> int:
    return min(BINS - 1, int(score * BINS))


def pairs_of(w: Window) -> list[tuple]:
    """Pairs of neighbouring tokens; of a single token itself."""
    return list(zip(w, w[1:])) or [(w[0], w[0])]


@dataclass
class Fold:
    """What one part of the cross-fitting needs: train on the suspects of the others, judge its own and all clean ones."""

    found: list[list[Window]]
    suspects: list[list[Window]]
    fold: np.ndarray
    clean: list[Window]
    seeds: tuple[list[Window], list[Window]]
    known: np.ndarray
    seed: int

    def run(self, k: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        pos = [w for d, g in zip(self.found, self.fold) if g != k for w in d]
        model = _train(pos + self.seeds[0], self.clean + self.seeds[1], self.known, self.seed + k, 2)
        return [(int(i), model.chances(self.suspects[i])) for i in np.flatnonzero(self.fold == k)], model.chances(self.clean) > 0.4


Runner = Callable[[Fold], list]


def in_turn(job: Fold) -> list:
    return [job.run(k) for k in range(FOLDS)]


def in_tasks(spark: SparkSession) -> Runner:
    """The parts of the cross-fitting as Spark tasks."""

    def runner(job: Fold) -> list:
        share = spark.sparkContext.broadcast(job)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"k": pdf.id, "out": [pickle.dumps(share.value.run(int(k))) for k in pdf.id]})

        rows = spark.range(0, FOLDS, 1, FOLDS).mapInPandas(run, "k long, out binary").collect()
        share.unpersist()
        return [pickle.loads(bytes(r.out)) for r in sorted(rows, key=lambda r: r.k)]

    return runner


def fit_net(rows: list[tuple[str, bool | None]], seed: int = 0, runner: Runner = in_turn) -> AbuseModel:
    """Fit on (text, flagged) documents, flagged being None for those nobody reviewed; thresholds are not set.

    Sentences of unreviewed documents stand among the clean ones, unless they look flagged later on. Without
    any documents the seed examples alone are used.
    """
    rng = np.random.default_rng(seed)
    docs = {k: [windows(t) for t, f in rows if f is k and t] for k in (True, False, None)}
    seen = Counter(tuple(w) for d in docs[False] for w in d)
    unseen = Counter(w for d in docs[None] for w in {tuple(w) for w in d} if w not in seen)

    def commonest(count: Counter) -> list[tuple]:
        """The commonest sentences, in random order among equals: a common one left out would be taken for flagged."""
        names = sorted(count)
        return [names[i] for i in sorted(rng.permutation(len(names)), key=lambda i: -count[names[i]])[:FIT_SENTENCES]]

    clean = commonest(seen) + commonest(unseen)
    flagged = [d for d in ({tuple(w) for w in d} for d in docs[True]) if any(w not in seen for w in d)]
    suspects = [sorted(w for w in d if w not in seen) for d in flagged]
    seed_pos = [w for t in SEED_FLAGGED for w in windows(t)]
    seed_neg = [w for t in SEED_CLEAN for w in windows(t)] * 3
    counts = np.zeros(SLOTS, np.int64)
    for w in [*clean, *(w for d in suspects for w in d)]:
        counts[np.unique(np.array(w).ravel())] += 1
    known = counts >= 2
    for w in seed_pos + seed_neg:
        known[np.array(w).ravel()] = True
    common = Counter(p for w in clean for p in set(pairs_of(w)))
    rare = max(1, len(clean) // 10_000)

    def strange(w: tuple) -> bool:
        pairs = pairs_of(w)
        return len(w) >= 5 and sum(common[p] <= rare for p in pairs) >= NOVEL * len(pairs)

    # where most of a document is seen nowhere else, its language is rare among the clean ones, which says nothing
    alone = [{w for w in d if strange(w)} for d in suspects]
    alone = [a if 2 * len(a) <= len(d) else set() for a, d in zip(alone, flagged)]

    here = Counter(p for d in suspects for p in {p for w in d for p in pairs_of(w)})
    n_here, n_clean = max(1, sum(map(len, suspects))), max(1, len(clean))

    def excess(w: tuple, own: int) -> float:
        """Mean log of how much commoner the sentence's token pairs are in (other) flagged documents than in clean ones."""
        return float(np.mean([np.log((max(here[p] - own, 0) + 0.5) / n_here) - np.log((common[p] + 0.5) / n_clean) for p in pairs_of(w)]))

    # what the ordinary sentences of a document have of it, as its language may be commoner among the flagged ones
    usual = [max(0.0, sorted(excess(w, 1) for w in d)[(len(d) - 1) // 2]) if len(d) > 1 else 0.0 for d in flagged]
    fold = rng.permutation(len(suspects)) % FOLDS
    # with too few flagged documents to check one against the others, only what is seen nowhere else counts
    found = suspects if len(suspects) >= 2 * FOLDS else [sorted(a) for a in alone]
    for turn in range(2 if len(suspects) >= 2 * FOLDS else 0):
        pick: list[list] = [[] for _ in suspects]
        bad = np.zeros(len(clean))
        for judged, odd in runner(Fold(found, suspects, fold, clean, (seed_pos, seed_neg), known, seed + 10 * turn)):
            for i, p in judged:
                pick[i] = [w for w, v in zip(suspects[i], p) if v > 0.5 and excess(w, 1) > EXCESS + usual[i] or w in alone[i]]
            bad += odd
        found = pick
        # one that nobody reviewed goes on the first suspicion, one of a clean document, which a reviewer may have
        # overlooked, on the last; but not what several clean documents have or is no commoner in flagged ones
        clean = [w for w, n in zip(clean, bad) if seen[w] > 1 or n < (FOLDS if w in seen else 1) or excess(w, 0) <= EXCESS]
    clean += [w for w in clean for _ in range(min(seen[w], 4) - 1)]
    # what the networks do not recognise is clean; where there were too few documents to ask them, nothing is known of it
    rest = [w for d, f in zip(suspects, found) for w in d if w not in set(f)] if len(suspects) >= 2 * FOLDS else []
    model = _train([w for d in found for w in d] + seed_pos, clean + rest + seed_neg, known, seed + 99, 4)
    model.net.slim()
    return model


def fit_abuse(rows: list[tuple[str, str | None, bool | None]], seed: int = 0) -> AbuseModel:
    """Fit on (text, language, flagged) documents in memory, one in ``HELD`` of the reviewed ones kept for the thresholds."""
    rng = np.random.default_rng(seed)
    hold = (rng.random(len(rows)) < 1 / HELD) & np.array([f is not None for _, _, f in rows], bool)
    model = fit_net([(t, f) for (t, _, f), h in zip(rows, hold) if not h], seed)
    scores = model.scores([t for t, _, _ in rows])
    at = [(language_code(g) or "", class_of(v)) for (_, g, _), v in zip(rows, scores)]
    model.calibrate(Counter(k for k, (_, _, f), h in zip(at, rows, hold) if h and f), Counter(at))
    return model


def chosen_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(_d, v, fit): all labelled documents and those fitted on; v > 0: flagged, v < 0: clean, null: not reviewed.

    A document is flagged if more of its labels are not ``clean`` than are; ties are left out. Labels that are
    null or have no document id are ignored. At most ``FIT_FLAGGED`` flagged, ``FIT_CLEAN`` clean and ``FIT_OTHER``
    unreviewed documents are fitted on, by hash of the id; one labelled document in ``HELD`` never is. Texts are
    not read.
    """
    bad = F.sum(F.when(F.col("label") == "clean", -1).otherwise(1))
    votes = labels.select(F.col(id_col).alias("_d"), "coder_id", "label").where("label is not null and _d is not null").distinct().groupBy("_d").agg(bad.alias("v"))
    votes = cut(votes.where("v <> 0"))
    mine = F.pmod(F.xxhash64("_d", F.lit(11)), F.lit(HELD)) != 0
    first = lambda df, n: df.orderBy(F.xxhash64("_d"), "_d").limit(n).select("_d", F.lit(True).alias("fit"))
    others = docs.select(F.col(id_col).alias("_d")).where("_d is not null").distinct().join(votes, "_d", "left_anti")
    fit = first(votes.where(mine & (F.col("v") > 0)), FIT_FLAGGED).unionByName(first(votes.where(mine & (F.col("v") < 0)), FIT_CLEAN)).unionByName(first(others, FIT_OTHER))
    return cut(votes.join(fit, "_d", "full_outer").select("_d", "v", F.coalesce("fit", F.lit(False)).alias("fit")))


def fit_on(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> AbuseModel:
    """Fit on the documents of :func:`chosen_documents`, those longer than ``FIT_CHARS`` apart; thresholds are not set."""
    picked = chosen.where("fit").select("_d", "v")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.length("_t") <= FIT_CHARS)
    # so many rows at most that they can be broadcast
    rows = texts.join(F.broadcast(picked), F.col("_id") == F.col("_d")).dropDuplicates(["_d"]).orderBy(F.xxhash64("_d"), "_d").select("_t", "v").toPandas()
    return fit_net([(t, None if v != v else v > 0) for t, v in zip(rows._t, rows.v)], runner=in_tasks(docs.sparkSession))


def scores_of(docs: DataFrame, model: AbuseModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, the two-letter code of the document's language label ('' without one), and the columns of ``keep``.

    Null and blank texts score 0. Texts are read whole. Rows with a null id are ignored.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), *keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = share.value
        for pdf in batches:
            for part in by_size(pdf, "_text", CHARS):
                s = m.scores([t if isinstance(t, str) else None for t in part._text])
                code = [language_code(g) or "" for g in part._lang]
                yield part[["doc_id", *keep]].assign(score=s, code=code)[["doc_id", "score", "code", *keep]]

    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.select(*keep).schema) if keep else ""
    return ample(src, "doc_id").mapInPandas(run, "doc_id long, score double, code string" + kept)


def flag(scored: DataFrame, model: AbuseModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, flagged, and the columns of ``keep``: flagged is what reaches its language's threshold."""
    limit = F.lit(model.threshold)
    if model.by_language:  # one for each code of NAMES at most
        limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in model.by_language.items() for x in kv]), F.col("code")), limit)
    return scored.select("doc_id", "score", (F.col("score") >= limit).alias("flagged"), *keep)


def score_documents(docs: DataFrame, model: AbuseModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score and flag of every document by a model with its thresholds: doc_id, score, flagged, and the columns of ``keep``."""
    return flag(scores_of(docs, model, id_col, text_col, lang_col, keep), model, keep)


def judge_documents(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fit on the labelled documents, score all, set the thresholds from all scores, and flag.

    Texts are read twice: the few that are fitted on, and all. Repeated documents are scored as often; an empty
    table gives an empty result.
    """
    chosen = chosen_documents(docs, labels)
    model = fit_on(docs, chosen)
    scored = cut(scores_of(docs, model, keep=keep)).withColumn("bin", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int"))
    held = chosen.where("not fit and v > 0").select("_d")
    flagged = scored.join(held, F.col("doc_id") == F.col("_d"), "left_semi")
    # at most BINS rows for each code of NAMES
    model.calibrate(*[{(r.code, r.bin): r["count"] for r in df.groupBy("code", "bin").count().collect()} for df in (flagged, scored)])
    return flag(scored, model, keep)
