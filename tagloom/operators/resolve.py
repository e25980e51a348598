"""Native tag events to normalized tags: mapping join, prioritized merges, snapshots.

Events are long rows (file_id, seq, format_id, tag_id, v_str, v_list, v_int,
v_bool). Dimension tables are fixed and broadcast. Merges are plain aggregates
with map-side combine; no step holds all events of a file in one task, since one
live stream may own a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.functions import normalize as N
from tagloom.functions.normalize import first_value, value_list, year_of
from tagloom.operators.running import running_last
from tagloom.session import stored

#: Events of one file and tag that a window orders in one task.
BLOCK = 4096


def tag_values(events: DataFrame) -> DataFrame:
    """(file_id, seq, format_id, tag_id, value, vals): each event once, with its text and its list of texts.

    Rows repeated under one (file_id, seq) count once (the last delivered by
    loaded_at where that column exists and they differ); rows without key or
    value are left out.
    """
    late = F.col("loaded_at") if "loaded_at" in events.columns else F.lit(0)
    row = F.struct("format_id", "tag_id", "v_str", "v_list", "v_int", "v_bool")
    once = events.where("file_id IS NOT NULL AND seq IS NOT NULL").groupBy("file_id", "seq").agg(F.max_by(row, late).alias("r")).select("file_id", "seq", "r.*")
    args = [F.col(c) for c in ("v_str", "v_list", "v_int", "v_bool")]
    return once.select("file_id", "seq", "format_id", "tag_id", first_value(*args).alias("value"), value_list(*args).alias("vals")).where("value IS NOT NULL")


def map_tags(values: DataFrame) -> DataFrame:
    """Adds common_id, sub, priority, is_singleton, is_unique; native tags without a mapping are dropped.

    A date also gives the year it begins with, ordered just before itself (sub 0).
    """
    spark = values.sparkSession
    m = values.join(F.broadcast(catalog.tag_map(spark)).withColumnRenamed("format_id", "f"), (F.col("format_id") == F.col("f")) & (F.lower("tag_id") == F.col("native_lower"))).drop("f", "native_lower")
    year = year_of(F.col("value"))
    derived = F.when((F.col("common_id") == "date") & year.isNotNull(), F.array(F.struct(F.lit("year").alias("c"), F.lit(0).alias("sub"), year.cast("string").alias("v"), F.array(year.cast("string")).alias("vs")))).otherwise(F.array())
    itself = F.array(F.struct(F.col("common_id").alias("c"), F.lit(1).alias("sub"), F.col("value").alias("v"), F.col("vals").alias("vs")))
    rows = m.select("file_id", "seq", "format_id", "tag_id", F.inline(F.concat(derived, itself)))
    rows = rows.select("file_id", "seq", "sub", "format_id", "tag_id", F.col("c").alias("common_id"), F.col("v").alias("value"), F.col("vs").alias("vals"))
    rows = rows.join(F.broadcast(catalog.format_priority(spark)), "format_id", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    sem = F.broadcast(catalog.tag_semantics(spark))
    rows = rows.join(sem, F.lower("common_id") == F.col("common_lower"), "left").drop("common_lower")
    return rows.withColumns({"is_singleton": F.coalesce("is_singleton", F.lit(True)), "is_unique": F.coalesce("is_unique", F.lit(False))})


def unmapped_tags(values: DataFrame) -> DataFrame:
    """(format_id, native_lower, n): tags that stay native only."""
    m = F.broadcast(catalog.tag_map(values.sparkSession)).withColumnRenamed("format_id", "f")
    rest = values.join(m, (F.col("format_id") == F.col("f")) & (F.lower("tag_id") == F.col("native_lower")), "left_anti")
    return rest.groupBy("format_id", F.lower("tag_id").alias("native_lower")).agg(F.count("*").alias("n"))


def native_tags(values: DataFrame) -> DataFrame:
    """(file_id, format_id, native_lower, n, first, last): repeated native tags, in the order of their events."""
    return values.groupBy("file_id", "format_id", F.lower("tag_id").alias("native_lower")).agg(
        F.count("*").alias("n"), F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last")
    )


def native_lists(values: DataFrame) -> DataFrame:
    """(file_id, format_id, native_lower, block, vals): ordered values of a native tag, in blocks of 4096 events."""
    keyed = values.withColumn("block", F.floor(F.col("seq") / BLOCK))
    got = keyed.groupBy("file_id", "format_id", F.lower("tag_id").alias("native_lower"), "block").agg(F.array_sort(F.collect_list(F.struct("seq", "vals"))).alias("x"))
    return got.select("file_id", "format_id", "native_lower", "block", F.flatten(F.transform("x", lambda r: r["vals"])).alias("vals"))


def merge_singletons(mapped: DataFrame) -> DataFrame:
    """(file_id, common_id, value): the last value among those of the highest priority. The artist has its own rule."""
    rows = mapped.where("is_singleton AND common_id <> 'artist'")
    return rows.groupBy("file_id", "common_id").agg(F.max_by("value", F.struct("priority", "seq", "sub")).alias("value"))


def merge_artist(mapped: DataFrame) -> DataFrame:
    """(file_id, value): a format never overwrites its own artist, so the first row of the last run of one format counts.

    Two small aggregates per format take the place of a window over all rows of a file.
    """
    rows = mapped.where("common_id = 'artist'")
    per = rows.groupBy("file_id", "priority", "format_id").agg(F.max("seq").alias("last"))
    state = per.groupBy("file_id").agg(F.max("priority").alias("p"), F.array_agg(F.struct("priority", "last", "format_id")).alias("f"))
    top = F.filter("f", lambda x: x["priority"] == F.col("p"))
    ordered = F.sort_array(F.transform(top, lambda x: F.struct(x["last"].alias("last"), x["format_id"].alias("format_id"))), asc=False)
    run = state.select("file_id", F.element_at(ordered, 1)["format_id"].alias("rf"), F.col("p").alias("rp"), F.try_element_at(ordered, F.lit(2))["last"].alias("before"))
    hit = rows.join(run, "file_id").where("format_id = rf AND priority = rp AND (before IS NULL OR seq > before)")
    return hit.groupBy("file_id").agg(F.min_by("value", "seq").alias("value"))


def merge_lists(mapped: DataFrame) -> DataFrame:
    """(file_id, common_id, vals): values of the highest priority in order; unique tags keep the first of equal values.

    Equal values are combined before anything is collected, so unique lists are
    as long as their distinct values. Lists that keep repeats are delivered by
    :func:`list_rows` instead.
    """
    rows = mapped.where("NOT is_singleton AND is_unique").select("file_id", "common_id", "priority", "seq", F.posexplode("vals").alias("pos", "v"))
    first = rows.groupBy("file_id", "common_id", "v", "priority").agg(F.min(F.struct("seq", "pos")).alias("at"))
    got = first.groupBy("file_id", "common_id").agg(F.max("priority").alias("p"), F.collect_list(F.struct("priority", "at", "v")).alias("x"))
    top = F.array_sort(F.filter("x", lambda r: r["priority"] == F.col("p")))
    return got.select("file_id", "common_id", F.transform(top, lambda r: r["v"]).alias("vals"))


def list_rows(mapped: DataFrame) -> DataFrame:
    """(file_id, common_id, seq, pos, value): values of the highest priority of lists that keep repeats, one row each."""
    rows = mapped.where("NOT is_singleton AND NOT is_unique")
    top = rows.groupBy("file_id", "common_id").agg(F.max("priority").alias("p"))
    return rows.join(top, ["file_id", "common_id"]).where("priority = p").select("file_id", "common_id", "seq", F.posexplode("vals").alias("pos", "value"))


def normalized(mapped: DataFrame, singles: list[str], lists: list[str]) -> DataFrame:
    """One row per file with the named singleton columns and list columns.

    The mapped tags are asked for four times, so the named ones are written once:
    whatever they come from, a decoder above all, runs once.
    """
    mapped = stored(mapped.where(F.col("common_id").isin([*singles, *lists])))
    both = merge_singletons(mapped).unionByName(merge_artist(mapped).select("file_id", F.lit("artist").alias("common_id"), "value"))
    wide = both.where(F.col("common_id").isin(singles)).groupBy("file_id").pivot("common_id", singles).agg(F.first("value"))
    many = merge_lists(mapped).where(F.col("common_id").isin(lists)).groupBy("file_id").pivot("common_id", lists).agg(F.first("vals"))
    return wide.join(many, "file_id", "full")


def accepted_changes(mapped: DataFrame) -> DataFrame:
    """(file_id, common_id, seq, value): merges that change the record, as an observer would see them.

    A value is accepted when no earlier one of its tag has a higher priority; an
    artist also when its format differs from that of the artist in force.
    Derived years are silent. Running states are taken inside blocks of 4096
    events and carried over a summary of the blocks.
    """
    rows = mapped.where("sub = 1").withColumn("block", F.floor(F.col("seq") / BLOCK))
    keys = ["file_id", "common_id"]
    inside = Window.partitionBy(*keys, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "block").agg(F.max("priority").alias("bp")).select(*keys, "block", F.max("bp").over(across).alias("carry"))
    before = F.greatest(F.max("priority").over(inside), F.col("carry"))
    valid = rows.join(blocks, [*keys, "block"]).withColumn("before", before).where("before IS NULL OR priority >= before")
    last = valid.groupBy(*keys, "block").agg(F.max_by("format_id", "seq").alias("bf")).select(*keys, "block", F.last("bf").over(across).alias("fcarry"))
    previous = F.coalesce(F.lag("format_id").over(Window.partitionBy(*keys, "block").orderBy("seq")), F.col("fcarry"))
    kept = valid.join(last, [*keys, "block"]).withColumn("previous", previous)
    changed = (F.col("common_id") != "artist") | F.col("previous").isNull() | (F.col("previous") != F.col("format_id"))
    return kept.where(changed).select("file_id", "common_id", "seq", "value")


#: Common tags that hold a position and a total, and those that are flags.
PAIRS = ["track", "disk", "movementIndex"]
FLAGS = ["compilation", "gapless", "podcast", "showMovement"]


def typed_values(mapped: DataFrame) -> DataFrame:
    """Adds no, of, flag, share, stars and comment: what the text of a tag means, by the rules of its format.

    MP4 totals of 0 mean none and MP4 flags are numbers over 0, as are the podcast flags of ID3; other flags are words.
    Ratings are shares of 100: those of ASF are kept within 0 and 1, those of RIFF within 0 and 100 before the division.
    A text that is no number or flag gives null.
    """
    tag, text, mp4 = F.col("common_id"), F.col("value"), F.col("format_id") == "iTunes"
    pair, flag = tag.isin(PAIRS), tag.isin(FLAGS)
    number = text.try_cast("double")
    share = F.when(F.col("format_id") == "asf", F.least(F.greatest(number / 100, F.lit(0.0)), F.lit(1.0))).when(F.col("format_id") == "exif", N.rating(number, 0.0, 100.0)).otherwise(N.rating(number))
    by_number = F.when(text.try_cast("double").isNotNull(), N.number_to_bool(text)).otherwise(N.to_bool(text))
    of_format = F.when(mp4, by_number).when(tag == "podcast", F.coalesce(N.nonzero(text), N.to_bool(text))).otherwise(N.to_bool(text))
    return mapped.withColumns(
        {
            "no": F.when(pair, N.position(text)),
            "of": F.when(pair, F.when(mp4, N.total(text, True)).otherwise(N.total(text))),
            "flag": F.when(flag, of_format),
            "share": F.when(tag == "rating", share),
            "stars": F.when(tag == "rating", N.stars(share)),
            "comment": F.when(tag == "comment", N.comment_struct(text)),
        }
    )


def snapshots(mapped: DataFrame, fields: list[str]) -> DataFrame:
    """(file_id, common_id, seq, fields): the named tags of the record after each accepted change; null where none came yet."""
    changes = accepted_changes(mapped)
    return running_last(changes, ["file_id"], ["seq", "common_id"], {f: F.when(F.col("common_id") == f, F.col("value")) for f in fields}, BLOCK).drop("value")


def select_cover(pictures: DataFrame, key: str, kind: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, fields): the first picture of type 'Cover', else the first picture; null types are no covers."""
    other = F.coalesce(F.col(kind) != "Cover", F.lit(True)).alias("other")
    return pictures.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(other, *order)).alias("_b")).select(key, *[F.col("_b")[f].alias(f) for f in fields])


def last_known(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Null-preserving partial updates: the last non-null value of each field per key."""
    return events.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def distinct_semantics(spark) -> DataFrame:
    """(kind, n): how many tags are singletons, lists and unique lists."""
    s = catalog.tag_semantics(spark)
    kinds = F.array(F.when(F.col("is_singleton"), "singleton").otherwise("list"), F.when(~F.col("is_singleton") & F.col("is_unique"), F.lit("unique")))
    return s.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
