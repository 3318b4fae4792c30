"""Filling fixed-capacity containers: vector bin packing by dot product.

An item takes tokens, one segment and its loss-bearing tokens: in instruction data those of the answer, not those of
the prompt. A container is filled by repeatedly adding the item that fits all three limits and has the
largest dot product of its demand with what is left, dimensions weighted by how scarce they are. Items are
spread over shards by a hash of their id, so every shard is a small task of its own and at most one badly
filled container per shard is left over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, spread

#: Items of a shard, on average.
SHARD_ITEMS = 20_000


def fill(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_capacity: int) -> np.ndarray:
    """Container number of each item; every item must fit an empty container."""
    kinds, kind_of = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    kind_of = np.asarray(kind_of).reshape(-1)
    order = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    first = np.concatenate(([0], np.cumsum(left)))[:-1]
    used = np.zeros(len(kinds), np.int64)
    demand = np.stack([kinds[:, 0] / capacity, np.full(len(kinds), 1 / segments), kinds[:, 1] / loss_capacity], 1)
    weight = (demand * left[:, None]).sum(0)
    weighted = demand * (weight / max(weight.sum(), 1e-12))
    out = np.empty(len(tokens), np.int64)
    box, todo = 0, len(tokens)
    while todo:
        rest = np.ones(3)
        free_t, free_s, free_l = capacity, segments, loss_capacity
        while free_s:
            ok = (left > 0) & (kinds[:, 0] <= free_t) & (kinds[:, 1] <= free_l)
            if not ok.any():
                break
            k = int(np.argmax(np.where(ok, weighted @ rest, -1.0)))
            out[order[first[k] + used[k]]] = box
            used[k] += 1
            left[k] -= 1
            todo -= 1
            free_t, free_s, free_l = free_t - kinds[k, 0], free_s - 1, free_l - kinds[k, 1]
            rest = np.array([free_t / capacity, free_s / segments, free_l / loss_capacity])
        box += 1
    return out


def pack(
    items: DataFrame, id_col: str = "doc_id", tokens_col: str = "n_tokens", prompt_col: str | None = None, *,
    capacity: int = 2048, segments: int = 128, loss_capacity: int = 1792, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Containers for all items: container_id, doc_id, piece, tok_start, tok_end, n_loss, n_pieces.

    ``prompt_col`` holds how many of an item's first tokens bear no loss (null: none); the first token, which nothing
    precedes, never does. A container holds at most ``capacity`` tokens, ``segments`` items and ``loss_capacity``
    loss-bearing tokens. An item larger than ``capacity`` tokens is cut into full pieces and a rest, all others stay
    whole; so one whose loss alone is above ``loss_capacity`` is taken to use all of it, and no other that bears loss
    joins it. Null sizes count as 0; an item of 0 tokens still takes a segment. Rows with a null id are ignored,
    repeated ids are packed once for each row, an empty table gives no containers.
    """
    n = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long")
    prompt = F.greatest(F.lit(1), F.coalesce(F.col(prompt_col), F.lit(0)) if prompt_col else F.lit(0)).cast("long")
    base = cut(items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), prompt.alias("prompt")))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    first, last = F.col("piece") * F.lit(capacity).cast("long"), (F.col("piece") + 1) * F.lit(capacity).cast("long")
    pieces = base.select("doc_id", "n", "prompt", count.alias("n_pieces"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select(
        "doc_id", "piece", "n_pieces", "prompt", first.alias("tok_start"), F.least("n", last).alias("tok_end")
    )
    pieces = pieces.withColumn("n_loss", F.greatest(F.lit(0).cast("long"), F.col("tok_end") - F.greatest("tok_start", "prompt"))).drop("prompt")
    shards = max(1, -(-base.count() // shard_items))
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = (pdf.tok_end - pdf.tok_start).to_numpy(np.int64)
        pdf = pdf.iloc[np.argsort(-size, kind="stable")]
        size = (pdf.tok_end - pdf.tok_start).to_numpy(np.int64)
        box = fill(size, np.minimum(pdf.n_loss.to_numpy(np.int64), loss_capacity), capacity, segments, loss_capacity)
        return pdf.assign(container_id=(np.int64(key[0]) << 32) + box)[["container_id", "doc_id", "piece", "tok_start", "tok_end", "n_loss", "n_pieces"]]

    return spread(pieces.withColumn("shard", shard), "shard").groupBy("shard").applyInPandas(
        run, "container_id long, doc_id long, piece int, tok_start long, tok_end long, n_loss long, n_pieces int"
    )
