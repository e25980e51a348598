"""Running values per key without one task per key: blocks of positions, and a carry over the summaries of the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one block.
BLOCK = 1 << 12


def _block(position: str, size: int) -> Column:
    return F.floor(F.col(position) / size)


def running_sums(rows: DataFrame, keys: list[str], position: str, sums: dict[str, Column], size: int = BLOCK) -> DataFrame:
    """Adds, for each name of ``sums``, the sum of its column over the rows of the key before this one (0 at the first).

    Positions differ within a key. Windows run inside blocks of ``size`` positions.
    """
    inside = Window.partitionBy(*keys, "_b").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    r = rows.withColumns({"_b": _block(position, size), **{f"_v_{n}": c for n, c in sums.items()}}).repartition(*keys, "_b")
    per = r.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    carry = per.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(across), zero).alias(f"_c_{n}") for n in sums])
    local = r.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside), zero) for n in sums})
    joined = local.join(carry, [*keys, "_b"])
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).drop("_b", *[f"_v_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def running_last(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], size: int = BLOCK) -> DataFrame:
    """Adds, for each name of ``values``, the last non-null value of its column up to and with this row.

    Rows are ordered by ``order``; blocks are made of its first column.
    """
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    # one exchange serves the windows and the summaries of the blocks. It is stated: after a union of inputs that are partitioned
    # alike, Spark 4.1 (spark.sql.unionOutputPartitioning) leaves it out and groups the inputs apart, which gives wrong rows
    r = rows.withColumns({"_b": _block(order[0], size), **{f"_v_{n}": c for n, c in values.items()}}).repartition(*keys, "_b")
    per = r.groupBy(*keys, "_b").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_l_{n}") for n in values])
    carry = per.select(*keys, "_b", *[F.last(f"_l_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values])
    local = r.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    joined = local.join(carry, [*keys, "_b"])
    return joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in values}).drop("_b", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def in_force(points: DataFrame, bounds: DataFrame, key: str, at: str, start: str, value: Column, name: str = "value", inclusive: bool = True, size: int = BLOCK) -> DataFrame:
    """(key, at, name): the value of the last bound that starts at or before (``inclusive``) each point, null before the first.

    An as-of join by union and running value: no pairs are formed inside a key.
    """
    typed = bounds.select(key, F.col(start).cast("long").alias("_p"), F.lit(0 if inclusive else 1).alias("_k"), value.alias("_x"))
    asked = points.select(key, F.col(at).cast("long").alias("_p"), F.lit(1 if inclusive else 0).alias("_k")).distinct().withColumn("_x", F.lit(None).cast(typed.schema["_x"].dataType))
    both = running_last(typed.withColumn("_q", F.lit(False)).unionByName(asked.withColumn("_q", F.lit(True))), [key], ["_p", "_k", "_q"], {name: F.col("_x")}, size)
    return both.where("_q").select(key, F.col("_p").cast(points.schema[at].dataType).alias(at), name)


def dense_ranks(rows: DataFrame, key: str, order: str, name: str, size: int = 1 << 22) -> DataFrame:
    """Adds the dense rank of ``order`` in its key, from 1; ranks of a block follow those of the blocks before."""
    first = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order).distinct()
    counted = running_sums(first, [key], order, {name: F.lit(1)}, size)
    return rows.join(counted.withColumn(name, (F.col(name) + 1).cast("int")), [key, order], "left")
