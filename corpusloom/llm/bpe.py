"""Encoding with a public byte-level BPE vocabulary.

A partition's distinct pre-tokens are laid out as one long chain of symbols. An index maps every pair that can
merge to all its positions; the active ranks are applied in ascending order, each rank to all its positions at
once, and only the pairs next to a merge are entered anew. As a merged symbol is always newer than its parts,
the pairs a merge creates have higher ranks, so one ascending pass is exact.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; ``tokenizer_dir`` parameters override it.
TOKENIZER_DIR = "/opt/tokenizers"
#: Symbols of distinct pre-tokens that are merged in one go.
CHAIN = 1 << 21
#: Pre-tokens whose ids a task remembers before it starts anew.
REMEMBERED = 400_000
# Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Merge table of one vocabulary, and the encoder over batches of pre-tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, chars = model["vocab"], byte_chars()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        code = left << 32 | right
        self.order = np.argsort(code, kind="stable")
        self.codes, self.left, self.right = code[self.order], left, right
        self.word = regex.compile(PATTERN)
        self.met: dict[str, np.ndarray] = {}
        names = {i: c for c, i in vocab.items()}
        self.pieces = [bytes(chars.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge. Negative symbols are word ends."""
        code = a.astype(np.int64) << 32 | b.astype(np.int64)
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.codes[i] == code), self.order[i], -1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        # one unused slot after every word keeps pairs from crossing it
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        sym = np.full(starts[-1] + 1, -1, np.int32)
        flat = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        if len(flat):
            slot = np.arange(len(flat)) + np.repeat(np.arange(len(raw)), sizes)
            sym[slot] = flat
        nxt = np.arange(1, len(sym) + 1, dtype=np.int64)
        prv = np.arange(-1, len(sym) - 1, dtype=np.int64)
        end = len(sym) - 1
        nxt[end] = end
        prv[0] = end  # the last slot is a word end
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(pos: np.ndarray, rank: np.ndarray) -> None:
            keep = rank >= 0
            if not keep.any():
                return
            pos, rank = pos[keep], rank[keep]
            o = np.argsort(rank, kind="stable")
            pos, rank = pos[o], rank[o]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for p, r in zip(np.split(pos, cuts), rank[np.concatenate(([0], cuts))].tolist()):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        at = np.arange(len(sym) - 1, dtype=np.int64)
        enter(at, self.ranks(sym[:-1], sym[1:]))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b, new = self.left[r], self.right[r], self.made[r]
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # in a run of equal symbols every second pair merges
                linked = np.concatenate(([False], nxt[pos[:-1]] == pos[1:]))
                run = np.maximum.accumulate(np.where(linked, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = new
            sym[gone] = -2
            nxt[pos] = after
            prv[after] = pos
            enter(pos, self.ranks(sym[pos], sym[after]))
            before = prv[pos]
            enter(before, self.ranks(sym[before], sym[pos]))
        live = sym >= 0
        ids, owner = sym[live], np.searchsorted(starts, np.flatnonzero(live), side="right") - 1
        return np.split(ids, np.searchsorted(owner, np.arange(1, len(raw)))) if raw else []

    def encode_all(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each pre-token: those met before are remembered, the others merged in chains of bounded length."""
        if len(self.met) > REMEMBERED:
            self.met.clear()
        part, size = [], 0
        for w in words:
            if w in self.met:
                continue
            part.append(w)
            size += len(w) * 4
            if size >= CHAIN:
                self.met.update(zip(part, self.encode_words(part)))
                part, size = [], 0
        self.met.update(zip(part, self.encode_words(part)))
        return [self.met[w] for w in words]

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of texts, their numbers in order of all texts, and how many each text has."""
        known: dict[str, int] = {}
        add = known.setdefault
        at: list[int] = []
        many = []
        for t in texts:
            before = len(at)
            if t:
                at += [add(w, len(known)) for w in self.word.findall(t)]
            many.append(len(at) - before)
        return list(known), np.array(at, np.int64), np.array(many, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none. Distinct pre-tokens are merged once."""
        words, at, many = self.cut(texts)
        if not words:
            return [np.empty(0, np.int32) for _ in texts]
        ids = self.encode_all(words)
        size = np.array([len(x) for x in ids], np.int64)
        begin = np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        flat = np.concatenate(ids)[np.arange(ends[-1]) + np.repeat(begin[at] - (ends - n), n)]
        last = np.concatenate(([0], ends))[np.cumsum(many)]
        return np.split(flat, last[:-1])

    def counts(self, texts: list[str | None], chars: list[int]) -> list[tuple[int, int]]:
        """Of each text the number of tokens, and of those whose pre-token begins within its first ``chars`` characters."""
        words, at, many = self.cut(texts)
        if not words:
            return [(0, 0) for _ in texts]
        n = np.array([len(x) for x in self.encode_all(words)], np.int64)[at]
        long = np.array([len(w) for w in words], np.int64)[at]
        text = np.repeat(np.arange(len(texts)), many)
        ends = np.cumsum(many)
        start = np.cumsum(long) - long
        start -= np.repeat(np.concatenate((start, [0]))[np.minimum(ends - many, len(start))], many)
        head = start < np.array(chars, np.int64)[text]
        total = np.bincount(text, n, len(texts)).astype(np.int64)
        return list(zip(total.tolist(), np.bincount(text, n * head, len(texts)).astype(np.int64).tolist()))


@lru_cache(maxsize=2)
def load_bpe(path: str) -> Bpe:
    """The encoder of a vocabulary file; a worker that has not the file takes the copy that the driver sent."""
    return Bpe(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def vocabulary(spark: SparkSession, tokenizer: str, tokenizer_dir: str) -> str:
    """Path of a vocabulary file, sent to the workers for those that have none there."""
    path = os.path.join(tokenizer_dir, f"{tokenizer}.json")
    spark.sparkContext.addFile(path)
    return path


def in_parts(pdf: pd.DataFrame, text: str, chars: int) -> Iterator[pd.DataFrame]:
    """Rows in turn, so many at a time that their texts have about ``chars`` characters."""
    held = np.cumsum([len(t) if isinstance(t, str) else 0 for t in pdf[text]])
    cuts = [0, *(np.flatnonzero(np.diff(held // chars)) + 1).tolist(), len(pdf)]
    for a, z in zip(cuts, cuts[1:]):
        yield pdf.iloc[a:z]


def encode_column(df: DataFrame, text: str = "text", *, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, chars: int = 2_000_000) -> DataFrame:
    """``df`` with ``ids array<int>`` added for its text column.

    Null and empty texts have an empty list. All other columns are kept; a column of the new
    name is replaced. Texts are encoded whole. Batches are formed by characters so that memory stays bounded.
    """
    path = vocabulary(df.sparkSession, tokenizer, tokenizer_dir)
    df = df.drop("ids")
    keep = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load_bpe(path)
        for pdf in batches:
            for part in in_parts(pdf, text, chars):
                yield part[keep].assign(ids=bpe.encode([t if isinstance(t, str) else None for t in part[text]]))

    schema = df.select(*keep, F.array(F.lit(0)).alias("ids")).schema
    return df.mapInPandas(run, schema)


def count_column(df: DataFrame, text: str = "text", head: str | None = None, *, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, chars: int = 2_000_000) -> DataFrame:
    """``df`` with ``n_tokens int`` and ``n_head int`` added: the tokens of its text, and of the first ``head`` characters.

    ``head`` is an integer column (null counts as 0). Null and empty texts have 0 tokens. Texts are encoded whole;
    all other columns are kept.
    """
    path = vocabulary(df.sparkSession, tokenizer, tokenizer_dir)
    df = df.drop("n_tokens", "n_head")
    keep = df.columns
    first = F.coalesce(F.col(head), F.lit(0)).cast("int") if head else F.lit(0)
    src = df.withColumn("_head", first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load_bpe(path)
        for pdf in batches:
            for part in in_parts(pdf, text, chars):
                n = bpe.counts([t if isinstance(t, str) else None for t in part[text]], part._head.tolist())
                yield part[keep].assign(n_tokens=[x for x, _ in n], n_head=[y for _, y in n])

    schema = df.select(*keep, F.lit(0).cast("int").alias("n_tokens"), F.lit(0).cast("int").alias("n_head")).schema
    return src.mapInPandas(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", *, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with ``decoded string`` in place of its ids: the text that they stand for (empty for null and empty lists)."""
    path = vocabulary(df.sparkSession, tokenizer, tokenizer_dir)
    keep = [c for c in df.columns if c not in (ids, "decoded")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load_bpe(path).pieces
        for pdf in batches:
            text = [b"".join([pieces[i] for i in x]).decode("utf-8", "replace") if x is not None else "" for x in pdf[ids]]
            yield pdf[keep].assign(decoded=text)

    return df.mapInPandas(run, df.select(*keep, F.lit("").alias("decoded")).schema)
