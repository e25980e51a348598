"""Filling fixed-capacity containers with texts of varying token length.

Method: Karmarkar-Karp multiway differencing. Items are dealt by hash into
groups worth ``GROUP`` containers, so the work of a task is bounded at any scale
and every group is filled by itself. In a group, partial partitions into k
windows are merged so that their imbalances oppose each other; if the fullest of
the k near-equal windows exceeds the capacity, the window count rises and the
group is partitioned again. The loss against one global packing is less than one
container per group.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.tokens import DEFAULT_RANKS, token_sizes

CAPACITY = 4096
#: Containers' worth of items in a group, and the most items of a group that hold no token.
GROUP = 96
GROUP_ITEMS = 50_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each item: largest differencing method for k windows."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    # a partition: window sums in falling order less the smallest; node = item, or (node, node, order of the windows)
    nodes: list = list(range(n))
    sums: list = []
    heap = []
    for i, s in enumerate(sizes):
        v = np.zeros(k, dtype=np.int64)
        v[0] = s
        sums.append(v)
        heap.append((-int(s), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        merged -= merged[-1]
        sums[a] = sums[b] = None
        sums.append(merged)
        nodes.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(merged[0]), len(sums) - 1))
    out = np.empty(n, dtype=np.int64)
    stack = [(len(nodes) - 1, np.arange(k))]
    while stack:
        at, where = stack.pop()
        node = nodes[at]
        if isinstance(node, int):
            out[node] = where[0]
            continue
        a, b, order = node
        slot = np.empty(k, dtype=np.int64)
        slot[order] = where  # slot of the merged sums before they were put in order
        stack.append((a, slot))
        stack.append((b, slot[::-1]))
    return out


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item so that no window exceeds ``capacity``; no item may exceed it. Items of size 0 join window 0."""
    out = np.zeros(len(sizes), dtype=np.int64)
    used = np.flatnonzero(sizes > 0)
    if not len(used):
        return out
    s = sizes[used].astype(np.int64)
    large = int((s * 2 > capacity).sum())
    k = max(math.ceil(int(s.sum()) / capacity), large)
    while True:
        w = differencing(s, k)
        load = np.bincount(w, weights=s, minlength=k)
        over = float(np.maximum(load - capacity, 0).sum())
        if over == 0:
            break
        k += max(1, int(over // capacity))
    out[used] = w
    return out


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, part, tok_from, tok_to, container): where each text's tokens [tok_from, tok_to) go.

    ``id_col`` must be unique. A text over the capacity is cut into full
    containers of its own and a rest that is packed like any text; other texts
    are whole. Null or negative sizes count as 0; texts without tokens share a
    container. Every text has a row; an empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    base = sizes.select(F.col(id_col).alias("id"), n.alias("n"))
    parts = base.select(
        "id", "n", F.explode(F.expr(f"sequence(0, cast(greatest(0, ceil(n / {capacity}) - 1) as int))")).alias("part")
    ).select("id", "part", (F.col("part").cast("long") * capacity).alias("tok_from"), F.least((F.col("part").cast("long") + 1) * capacity, F.col("n")).alias("tok_to"))
    whole = F.col("tok_to") - F.col("tok_from") == capacity
    full = parts.where(whole).withColumn("container", F.concat(F.lit("full-"), F.col("id").cast("string"), F.lit("-"), F.col("part").cast("string")))
    rest = parts.where(~whole)
    row = rest.agg(F.sum(F.col("tok_to") - F.col("tok_from")).alias("t"), F.count("*").alias("c")).first()
    groups = max(1, math.ceil((row["t"] or 0) / (GROUP * capacity)), math.ceil(row["c"] / GROUP_ITEMS))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part"])
        w = fill((pdf["tok_to"] - pdf["tok_from"]).to_numpy(), capacity)
        pdf["container"] = "mix-" + pdf["g"].astype(str) + "-" + pd.Series(w, index=pdf.index).astype(str)
        return pdf[["id", "part", "tok_from", "tok_to", "container"]]

    kind = dict(sizes.dtypes)[id_col]
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("id", "part"), F.lit(groups)))
    mixed = dealt.groupBy("g").applyInPandas(one, f"id {kind}, part int, tok_from long, tok_to long, container string")
    return mixed.unionByName(full).withColumnRenamed("id", id_col)


def pack_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = DEFAULT_RANKS) -> DataFrame:
    """Containers of all texts, measured in tokens of the tokenizer at ``path``."""
    from tagloom.session import cut

    return pack(cut(token_sizes(docs, id_col, text_col, path)), id_col, "n", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, fill: how well the containers are used, over all of them."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum(F.col("tok_to") - F.col("tok_from")), F.lit(0)).alias("tokens")).withColumn(
        "fill", F.round(F.col("tokens") / (F.col("containers") * F.lit(capacity)), 4)
    )
