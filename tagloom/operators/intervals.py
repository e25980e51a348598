"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Method: every interval falls into its canonical dyadic blocks (level k, index i
covers ``[i*2^k, (i+1)*2^k)``). Equal blocks collapse, blocks inside a larger
block of the entity are removed, sibling pairs merge upward and what is left is
coalesced. Work is grouped by (entity, tile) where a tile spans ``2^20`` units of
the level below, so no group holds more than ``2^21`` blocks whatever share of
the rows one entity has. Only the ends of an interval are shuffled, at most one
part in its first and one in its last tile, and decomposed where the tile is
merged; the whole tiles between them, and tiles that fill up, are intervals of
the next tier, whose unit is the tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import cut

#: Levels at which a tier begins; blocks below the next bound are grouped by the tile that holds them.
TIERS = (0, 20, 40, 63)

#: Points nearer than 2^LEAD_SHIFT are ordered inside one task; see :func:`next_point`.
LEAD_SHIFT = 22


def next_point(points: DataFrame, key: str, at: str, out: str) -> DataFrame:
    """Adds ``out``: the next larger ``at`` of the same ``key`` (null for the last), without one task per key.

    ``points`` must hold distinct (key, at). The order is taken inside buckets of
    2^22 units; the first point of the next bucket in use is found over one row
    per bucket and joined back.
    """
    b = points.withColumn("_b", F.shiftright(F.col(at), LEAD_SHIFT))
    inner = b.withColumn("_n", F.lead(at).over(Window.partitionBy(key, "_b").orderBy(at)))
    firsts = b.groupBy(key, "_b").agg(F.min(at).alias("_first"))
    follow = firsts.select(key, "_b", F.lead("_first").over(Window.partitionBy(key).orderBy("_b")).alias("_carry"))
    return inner.join(follow, [key, "_b"]).select(*points.columns, F.coalesce("_n", "_carry").alias(out))


def closed_intervals(chap: DataFrame, key: str = "file_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Distinct valid (key, s, e). A null end becomes the next later start of the key; rows without a
    key or start, without a later start, or with an end that is not after the start, count for nothing."""
    rows = chap.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("k IS NOT NULL AND s IS NOT NULL")
    starts = next_point(rows.select("k", "s").distinct(), "k", "s", "later")
    open_rows = rows.where("e IS NULL").select("k", "s").distinct()
    filled = open_rows.join(starts, ["k", "s"]).select("k", "s", F.col("later").alias("e"))
    return rows.where("e IS NOT NULL").unionByName(filled).where("e > s").distinct()


def dyadic_blocks(intervals: DataFrame) -> DataFrame:
    """Distinct (k, lvl, idx): the canonical dyadic blocks of the intervals (k, s, e)."""
    return (
        intervals.withColumn(
            "blk",
            F.expr(
                """flatten(transform(sequence(0, length(bin(e - s))), l -> filter(array(
                     if(-shiftright(-s, l) < shiftright(e, l) AND (-shiftright(-s, l)) % 2 <> 0, named_struct('lvl', l, 'idx', -shiftright(-s, l)), null),
                     if(-shiftright(-s, l) < shiftright(e, l) AND shiftright(e, l) % 2 <> 0, named_struct('lvl', l, 'idx', shiftright(e, l) - 1), null)
                   ), b -> b IS NOT NULL)))"""
            ),
        )
        .select("k", F.inline("blk"))
        .distinct()
    )


def _decompose(gid: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, level) of the canonical dyadic blocks of the parts [lo, hi) of tiles."""
    starts, levels = [], []
    base = gid << size
    for at in range(size):
        a, b = -((-lo) >> at), hi >> at
        some = a < b
        left, right = some & (a & 1 == 1), some & (b & 1 == 1)
        starts += [base[left] + (a[left] << at), base[right] + ((b[right] - 1) << at)]
        levels += [np.full(int(left.sum()), at), np.full(int(right.sum()), at)]
    return np.concatenate(starts), np.concatenate(levels)


def _merge_tiles(size: int):
    """Arrow iterator function: rows sorted by (k, tile); parts of one tile in, its maximal runs out."""
    full = 1 << size

    def reduce(k: np.ndarray, tile: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (tile[1:] != tile[:-1])))
        gid = np.cumsum(new) - 1
        start, lvl = _decompose(gid, lo, hi, size)
        order = np.lexsort((-lvl, start))
        start, lvl = start[order], lvl[order]
        end = start + (np.int64(1) << lvl)
        # a block inside an earlier block of its tile ends no later than one seen before it
        seen = np.maximum.accumulate(end)
        keep = np.concatenate(([True], end[1:] > seen[:-1]))
        start, lvl = start[keep], lvl[keep]
        done = []
        level = np.empty(0, dtype=np.int64)
        for at in range(size):
            level = np.concatenate((level, start[lvl == at]))
            level.sort()
            width = np.int64(1) << at
            left = np.flatnonzero((level[:-1] + width == level[1:]) & ((level[:-1] >> at) % 2 == 0)) if len(level) > 1 else np.empty(0, dtype=np.int64)
            stay = np.ones(len(level), dtype=bool)
            stay[left] = stay[left + 1] = False
            done.append((level[stay], np.full(int(stay.sum()), width)))
            level = level[left]
        done.append((level, np.full(len(level), full)))
        s = np.concatenate([d[0] for d in done])
        e = s + np.concatenate([d[1] for d in done])
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
        head = np.concatenate(([True], (s[1:] != e[:-1]) | (s[1:] >> size != s[:-1] >> size)))
        first = np.flatnonzero(head)
        last = np.concatenate((first[1:], [len(s)])) - 1
        g = s[first] >> size
        rep = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays(
            [pa.array(k[rep][g]), pa.array(tile[rep][g]), pa.array(s[first] - (g << size)), pa.array(e[last] - (g << size))], ["k", "tile", "lo", "hi"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            k, tile = cols[0], cols[1]
            last = int(np.argmax((k == k[-1]) & (tile == tile[-1])))
            if last:
                yield reduce(*[c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield reduce(*held)

    return run


def merge_periods(intervals: DataFrame) -> DataFrame:
    """Boundary points (k, at, sign) of the union of intervals (k, s, e): sign 1 opens a period, -1 closes it."""
    points, level = None, intervals.select("k", F.col("s").alias("a"), F.col("e").alias("b"))
    for lo, hi in zip(TIERS, TIERS[1:]):
        w = hi - lo
        level = cut(
            level.select(
                "k",
                F.expr(
                    f"""CASE WHEN shiftright(a, {w}) = shiftright(b - 1, {w}) THEN
                        filter(array(named_struct('tile', shiftright(a, {w}), 'lo', a - shiftleft(shiftright(a, {w}), {w}), 'hi', b - shiftleft(shiftright(a, {w}), {w}))), p -> p.hi - p.lo < {1 << w})
                    ELSE filter(array(named_struct('tile', shiftright(a, {w}), 'lo', a - shiftleft(shiftright(a, {w}), {w}), 'hi', {1 << w}L),
                        named_struct('tile', shiftright(b, {w}), 'lo', 0L, 'hi', b - shiftleft(shiftright(b, {w}), {w}))), p -> p.hi > p.lo AND p.hi - p.lo < {1 << w}) END"""
                ).alias("parts"),
                F.expr(f"-shiftright(-a, {w})").alias("ma"),
                F.expr(f"shiftright(b, {w})").alias("mb"),
            )
        )
        parts = level.select("k", F.inline("parts")).distinct()
        whole_tiles = level.where("ma < mb").select("k", F.col("ma").alias("s"), F.col("mb").alias("e")).distinct()
        above = dyadic_blocks(whole_tiles)
        top = above.agg(F.max("lvl").alias("m")).first()["m"]  # one number
        if top is not None:
            # parts inside a block of whole tiles add nothing
            up = parts.select("k", "tile").distinct().select("k", "tile", F.explode(F.expr(f"transform(sequence(0, {top}), l -> named_struct('lvl', l, 'idx', shiftright(tile, l)))")).alias("u"))
            covered = up.select("k", "tile", "u.lvl", "u.idx").join(above, ["k", "lvl", "idx"], "left_semi").select("k", "tile").distinct()
            parts = parts.join(covered, ["k", "tile"], "left_anti")
        # partitioned by an expression of its own: on the join's own keys the planner would drop this exchange, and
        # reading the join's exchange locally would then tear tiles apart
        runs = cut(parts.repartition(F.xxhash64("k", "tile")).sortWithinPartitions("k", "tile").mapInArrow(_merge_tiles(w), "k long, tile long, lo long, hi long"))
        filled = (F.col("lo") == 0) & (F.col("hi") == 1 << w)
        part = runs if hi == TIERS[-1] else runs.where(~filled)
        ends = part.select("k", F.explode(F.array(*[F.struct(F.shiftleft(F.shiftleft(F.col("tile"), w) + F.col(c), lo).alias("at"), F.lit(sign).alias("sign")) for c, sign in (("lo", 1), ("hi", -1))])).alias("p")).select("k", "p.at", "p.sign")
        points = ends if points is None else points.unionByName(ends)
        full = runs.where(filled).select("k", F.col("tile").alias("a"), (F.col("tile") + 1).alias("b"))
        if top is None and not full.head(1):
            break
        level = whole_tiles.select("k", F.col("s").alias("a"), F.col("e").alias("b")).unionByName(full)
    # where one run ends and the next begins, the boundary cancels out
    return points.groupBy("k", "at").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def periods_and_gaps(chap: DataFrame) -> DataFrame:
    """file_id, kind ('period' or 'gap'), from_ms, to_ms for each file of ``chap``.

    Touching intervals continue each other; there is no gap before the first or
    after the last period. Null files and files without a valid interval give no
    rows; repeated rows change nothing; an empty table gives an empty result.
    """
    bounds = next_point(cut(merge_periods(closed_intervals(chap))), "k", "at", "to_ms")
    return bounds.where("to_ms IS NOT NULL").select(
        F.col("k").alias("file_id"), F.when(F.col("sign") > 0, "period").otherwise("gap").alias("kind"), F.col("at").alias("from_ms"), "to_ms"
    )
