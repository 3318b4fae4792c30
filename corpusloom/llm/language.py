"""Missing or wrong language labels: a byte-level convolutional network over sentence windows.

The network is trained on labelled documents' sentences; samples whose label the first round contradicts are
left out of the second, as some labels are wrong. Every sentence is classified on all its fixed-length byte
windows, and the sentences of a document are joined to stretches by a Viterbi pass that charges for a change
of language, so a heading or a page number goes with its surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.convnet import ConvNet, softmax
from corpusloom.llm.sentences import FIT_CHARS, SentenceModel, fit_sentences
from corpusloom.session import ample

#: Bytes of a window, labelled documents fitted on, windows of each language fitted on.
WINDOW, FIT_DOCS, FIT_WINDOWS = 128, 6000, 2500
#: Cost of a change of language between sentences, and the most that one sentence can say against a language.
SWITCH, FLOOR = 3.0, 8.0
WIDTHS, DIM, FILTERS = (2, 3, 4, 5), 12, 16
#: Sentences whose scores a task remembers before it starts anew; characters of the texts that it reads at once.
REMEMBERED, CHARS = 50_000, 1_000_000

# Notations of languages.
NAMES = {
    "ja": "ja jpn japanese 日本語 jp", "en": "en eng english 英語", "de": "de deu ger german deutsch", "fr": "fr fra fre french français",
    "es": "es spa spanish español castellano", "pt": "pt por portuguese português", "ru": "ru rus russian русский", "zh": "zh zho chi chinese 中文 汉语 漢語 cmn",
    "hi": "hi hin hindi हिन्दी हिंदी", "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "la": "la lat latin", "ko": "ko kor korean 한국어",
    "ar": "ar ara arabic العربية", "pl": "pl pol polish polski", "sv": "sv swe swedish svenska", "da": "da dan danish dansk", "el": "el ell gre greek ελληνικά", "uk": "uk ukr ukrainian",
}
NOTATION = {n: code for code, names in NAMES.items() for n in names.split()}
# A few words of our own in each language, so that a language is known before its first labelled document.
SEED = {
    "en": "The people of the town had never seen such a thing before, and they said that it would not happen again. There was no answer to this letter.",
    "de": "Die Leute in der Stadt hatten so etwas noch nie gesehen, und sie sagten, dass es nicht wieder geschehen werde. Auf diesen Brief kam keine Antwort.",
    "fr": "Les gens de la ville n'avaient jamais vu une telle chose, et ils disaient que cela ne se reproduirait pas. Il n'y eut pas de réponse à cette lettre.",
    "es": "La gente del pueblo nunca había visto una cosa así, y decían que no volvería a suceder. No hubo respuesta a esta carta, aunque la esperaban.",
    "pt": "As pessoas da cidade nunca tinham visto uma coisa assim, e diziam que não voltaria a acontecer. Não houve resposta a esta carta, embora a esperassem.",
    "ru": "Жители города никогда раньше не видели ничего подобного и говорили, что это больше не повторится. Ответа на это письмо не было.",
    "ja": "町の人々はこのようなことを今まで見たことがなく、二度と起こらないだろうと言った。この手紙に返事はなかった。右之通御座候以上",
    "zh": "城里的人从来没有见过这样的事情，他们说以后不会再发生了。这封信没有得到任何回复，因为信使没有到达。",
    "hi": "नगर के लोगों ने ऐसी बात पहले कभी नहीं देखी थी और वे कहते थे कि ऐसा फिर नहीं होगा। इस पत्र का कोई उत्तर नहीं आया।",
}


def language_code(label: str | None) -> str | None:
    """Two-letter code of a label in any known notation; None for a label that names no language."""
    if not isinstance(label, str):
        return None
    low = label.strip().lower()
    return NOTATION.get(low) or NOTATION.get(regex.split(r"[-_]", low)[0]) if low else None


_DIGITS = regex.compile(r"\d+")
_SPACE = regex.compile(r"\s+")
_FURNITURE = regex.compile(r"[\W\d_]*(?:p\.\s*)?[ivxlcdm]*[\W\d_]*")
_OTHER = regex.compile(r"\P{L}+")


def clean(text: str) -> str:
    return _SPACE.sub(" ", _DIGITS.sub("0", text.replace("­\n", "").replace("-\n", ""))).strip().lower()


def windows(text: str) -> list[bytes]:
    """All windows of a text; the last one is moved back so that it is full where the text is long enough."""
    b = text.encode("utf-8", "ignore")
    if len(b) <= WINDOW:
        return [b]
    at = [*range(0, len(b) - WINDOW, WINDOW), len(b) - WINDOW]
    return [b[i : i + WINDOW] for i in at]


def as_ids(parts: list[bytes]) -> np.ndarray:
    """Byte ids, with room for one filter of padding; byte 0 is padding and occurs in no text worth scoring."""
    out = np.zeros((len(parts), WINDOW + max(WIDTHS)), np.int64)
    for i, b in enumerate(parts):
        out[i, : len(b)] = np.maximum(np.frombuffer(b, np.uint8), 1)
    return out


Stretch = tuple[int, int, str, float]


@dataclass
class LanguageModel:
    net: ConvNet
    languages: list[str]
    sentences: SentenceModel
    #: Scores of sentences met before.
    known: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> tuple:
        return self.net, self.languages, self.sentences

    def __setstate__(self, state: tuple) -> None:
        self.net, self.languages, self.sentences = state
        self.known = {}

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probabilities of each language for each text, 0 where there is no letter to go by."""
        cleaned = [clean(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [t for t in dict.fromkeys(cleaned) if t not in self.known]
        for a in range(0, len(new), 8192):
            self.known.update(zip(new[a : a + 8192], self._scores(new[a : a + 8192])))
        return np.array([self.known[t] for t in cleaned]).reshape(len(texts), len(self.languages))

    def _scores(self, cleaned: list[str]) -> np.ndarray:
        parts = [windows(t) for t in cleaned]
        lp = np.log(softmax(self.net.logits(as_ids([w for p in parts for w in p]))) + 1e-6)
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1]
        out = np.add.reduceat(lp, at, axis=0) / np.array([len(p) for p in parts])[:, None]
        # a short text has little to say
        letters = [_OTHER.sub("", t) for t in cleaned]
        weight = np.array([len(t.encode("utf-8", "ignore")) for t in letters])
        out[np.array([not t or _FURNITURE.fullmatch(c) is not None for t, c in zip(letters, cleaned)], bool)] = 0
        return np.maximum(out, -np.minimum(FLOOR, 0.3 * weight)[:, None])

    def stretches(self, text: str | None) -> list[Stretch]:
        """Longest stretches of sentences in one language: start, end, language, confidence (mean probability)."""
        return self.all_stretches([text])[0]

    def all_stretches(self, texts: list[str | None]) -> list[list[Stretch]]:
        """The stretches of each text; all sentences are scored together."""
        spans = [self.sentences.spans(t) for t in texts]
        s = self.scores([t[a:z] for t, own in zip(texts, spans) for a, z in own])
        top = s.argmax(1)
        said = s.any(1)
        out, at = [], 0
        for own in spans:
            here = slice(at, at + len(own))
            at += len(own)
            out.append(self._join(own, s[here], top[here], said[here]) if own else [])
        return out

    def _join(self, spans: list[tuple[int, int]], s: np.ndarray, top: np.ndarray, said: np.ndarray) -> list[Stretch]:
        n, k = s.shape
        first = top[said][:1]
        if (top[said] == first).all():  # no sentence speaks for another language, so no change can be better
            lang = [int(first[0]) if len(first) else 0] * n
        else:
            best, back = s[0].copy(), np.zeros((n, k), np.int64)
            for i in range(1, n):
                most = int(best.argmax())
                stay = best >= best[most] - SWITCH
                back[i] = np.where(stay, np.arange(k), most)
                best = np.where(stay, best, best[most] - SWITCH) + s[i]
            lang = [int(best.argmax())]
            for i in range(n - 1, 0, -1):
                lang.append(int(back[i, lang[-1]]))
            lang.reverse()
        out, a = [], 0
        for i in range(1, n + 1):
            if i == n or lang[i] != lang[a]:
                p = np.exp(s[a:i])
                out.append((spans[a][0], spans[i - 1][1], self.languages[lang[a]], float((p[:, lang[a]] / p.sum(1)).mean())))
                a = i
        return out


def fit_language(rows: list[tuple[str, str | None]], seed: int = 0) -> LanguageModel:
    """Fit on (text, label) pairs; texts without a usable label only help to find sentences."""
    rng = np.random.default_rng(seed)
    sentences = fit_sentences([t for t, _ in rows if t])
    by: dict[str, list[str]] = {k: [v] for k, v in SEED.items()}
    for text, label in rows:
        code = language_code(label)
        if code and text:
            by.setdefault(code, []).extend(c for a, z in sentences.spans(text) if sum(map(str.isalpha, c := clean(text[a:z]))) >= 4)
    languages = sorted(k for k, v in by.items() if k in SEED or len(v) >= 20)
    xs, ys = [], []
    for y, code in enumerate(languages):
        pool = by[code]
        picks = rng.permutation(len(pool))[:FIT_WINDOWS].tolist()
        picks += rng.integers(0, len(pool), max(0, min(300, FIT_WINDOWS) - len(picks))).tolist()
        for j in picks:
            t = pool[j]
            if rng.random() < 0.5 and len(t) > 12:  # shorter pieces too, as headings are short
                n = int(rng.integers(8, len(t)))
                a = int(rng.integers(0, len(t) - n + 1))
                t = t[a : a + n]
            b = t.encode("utf-8", "ignore")
            a = int(rng.integers(0, max(1, len(b) - WINDOW + 1)))
            xs.append(b[a : a + WINDOW])
            ys.append(y)
    x, y = as_ids(xs), np.array(ys)
    net = ConvNet(256, len(languages), DIM, WIDTHS, FILTERS, seed=seed)
    net.train(x, y, 2, seed=seed)
    p = softmax(net.logits(x))[np.arange(len(y)), y]
    good = p > 0.3
    net.train(x[good], y[good], 3, seed=seed + 1)
    return LanguageModel(net.slim(), languages, sentences)


def by_size(pdf: pd.DataFrame, text: str, chars: int) -> Iterator[pd.DataFrame]:
    """Rows in turn, so many at a time that their texts have about ``chars`` characters."""
    held = np.cumsum([len(t) if isinstance(t, str) else 0 for t in pdf[text]])
    cuts = [0, *(np.flatnonzero(np.diff(held // chars)) + 1).tolist(), len(pdf)]
    for a, z in zip(cuts, cuts[1:]):
        yield pdf.iloc[a:z]


def fit_on(df: DataFrame, id_col: str = "id", text_col: str = "body", label_col: str = "language", docs: int = FIT_DOCS) -> LanguageModel:
    """Fit on the ``docs`` documents with the smallest hash of the id, a bounded sample of labelled rows."""
    rows = df.where(F.length(text_col) <= FIT_CHARS).select(id_col, text_col, label_col).orderBy(F.xxhash64(id_col), id_col).limit(docs).collect()
    return fit_language([(r[1], r[2]) for r in rows])


def language_stretches(df: DataFrame, model: LanguageModel, id_col: str = "id", text_col: str = "body", label_col: str = "language") -> DataFrame:
    """Stretches of every non-blank document: id, char_start, char_end, lang, confidence, label_ok, n_stretches.

    ``label_ok`` says whether the label names the language of the first stretch. Null and blank texts have no
    rows; ids that are null are ignored; further columns are not looked at.
    """
    share = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = share.value
        for pdf in batches:
            rows = []
            for part in by_size(pdf, "text", CHARS):
                stretches = m.all_stretches([t if isinstance(t, str) else None for t in part.text])
                for i, label, found in zip(part.id, part.label, stretches):
                    ok = bool(found) and language_code(label) == found[0][2]
                    rows += [(i, a, z, g, c, ok, len(found)) for a, z, g, c in found]
            yield pd.DataFrame(rows, columns=["id", "char_start", "char_end", "lang", "confidence", "label_ok", "n_stretches"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("id is not null")
    return ample(src, "id").mapInPandas(run, "id long, char_start int, char_end int, lang string, confidence double, label_ok boolean, n_stretches int")
