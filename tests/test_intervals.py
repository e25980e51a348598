import random

from pyspark.sql import Row

from tagloom.operators.intervals import periods_and_gaps

SCHEMA = "file_id long, start_ms long, end_ms long, title string"


def brute(rows):
    """Sweep over one file at a time."""
    files = {}
    for f, s, e, _ in rows:
        if f is not None and s is not None:
            files.setdefault(f, []).append((s, e))
    out = set()
    for f, iv in files.items():
        starts = sorted({s for s, _ in iv})
        closed = []
        for s, e in iv:
            if e is None:
                e = next((x for x in starts if x > s), None)
            if e is not None and e > s:
                closed.append((s, e))
        merged = []
        for s, e in sorted(closed):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(f, "period", a, b) for a, b in merged}
        out |= {(f, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows):
    got = [tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_files(spark):
    rng = random.Random(5)
    rows = []
    for f in range(60):
        scale = rng.choice([20, 3000, 1 << 21, 1 << 24, 1 << 34])
        for _ in range(rng.randint(1, 25)):
            s = rng.randrange(-scale // 4, scale)
            e = None if rng.random() < 0.2 else s + rng.randrange(-5, max(2, scale // 3))
            rows.append((f, None if rng.random() < 0.05 else s, e, "t"))
    rows += rows[:40] + [(None, 1, 2, "x")]
    assert run(spark, rows) == brute(rows)


def test_tile_borders_touching_and_filling(spark):
    t = 1 << 20
    rows = [(1, 0, t, ""), (1, t, 2 * t, ""), (2, 0, t // 2, ""), (2, t // 2, t, ""), (2, t, t + 1, ""), (3, t - 1, t, ""), (3, t + 1, 3 * t, ""), (4, 0, 8 * t, ""), (4, 2 * t + 5, 2 * t + 9, ""), (5, 0, (1 << 41) + 3, ""), (5, (1 << 41) + 4, (1 << 41) + 5, "")]
    assert run(spark, rows) == brute(rows)


def test_empty_null_and_clashing_columns(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, None, None, None), (2, 5, None, None), (3, 7, 7, "")]) == set()
    df = spark.createDataFrame([Row(file_id=1, start_ms=0, end_ms=5, k=9, s=3, e=4, tile=2, lo=1, at=0)])
    assert [tuple(r) for r in periods_and_gaps(df).collect()] == [(1, "period", 0, 5)]


def test_tiles_stay_whole_when_joins_change_at_run_time(spark):
    """Joins planned as sort-merge that turn into broadcasts at run time must not tear tiles apart."""
    rng = random.Random(8)
    rows = [(f, s, s + rng.randrange(1, 400), "") for f in range(300) for s in (rng.randrange(0, 9000) for _ in range(12))]
    rows += [(f, 0, 5 << 20, "") for f in range(3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(c)
