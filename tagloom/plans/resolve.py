"""Queries over native tag events, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.functions import normalize as N
from tagloom.operators import resolve as R
from tagloom.session import table


def _values(spark: SparkSession, d: str) -> DataFrame:
    return R.tag_values(table(spark, d, "tag_events"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return R.map_tags(_values(spark, d))


def tag_mapping_join(spark, d):
    return _mapped(spark, d).select("file_id", "seq", "sub", "format_id", "common_id", "value", "priority")


def unmapped_tags(spark, d):
    return R.unmapped_tags(_values(spark, d))


def native_group_by(spark, d):
    return R.native_tags(_values(spark, d))


def native_blocks(spark, d):
    return R.native_lists(_values(spark, d)).select("file_id", "format_id", "native_lower", "block", F.size("vals").alias("n"), F.md5(F.array_join("vals", "|")).alias("digest"))


def merge_singleton_priority(spark, d):
    return R.merge_singletons(_mapped(spark, d))


def merge_artist_first(spark, d):
    return R.merge_artist(_mapped(spark, d))


def merge_list_unique(spark, d):
    return R.merge_lists(_mapped(spark, d)).select("file_id", "common_id", F.array_join("vals", "|").alias("vals"))


def normalized_record(spark, d):
    got = R.normalized(_mapped(spark, d), ["title", "artist", "album", "year", "date", "track"], ["genre"])
    return got.select("file_id", "title", "artist", "album", N.whole_int(F.col("year")).alias("year"), "date", N.position(F.col("track")).alias("track_no"), N.total(F.col("track")).alias("track_of"), F.array_join("genre", "|").alias("genre"))


def json_sink(spark, d):
    """Null members are left out of the JSON projection."""
    n = normalized_record(spark, d)
    return n.select("file_id", F.to_json(F.struct("title", "year", "track_no")).alias("doc"))


def event_snapshots(spark, d):
    return R.accepted_changes(_mapped(spark, d))


def format_partial_update(spark, d):
    fields = ["container", "codec", "sample_rate", "channels"]
    files = table(spark, d, "audio_files").select("file_id", "scanned_at", *fields)
    return R.last_known(files, "file_id", "scanned_at", fields)


def tag_semantics_kinds(spark, d):
    return R.distinct_semantics(spark)


def track_total_pair(spark, d):
    li = table(spark, d, "lineitem")
    text = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("l_quantity").cast("int") % 5).cast("string"))))
    return li.groupBy(N.position(text).alias("no"), N.total(text, True).alias("of")).agg(F.count("*").alias("n"))


def rating_stars(spark, d):
    share = N.rating(F.col("l_discount") * 1000, 0, 100)
    return table(spark, d, "lineitem").groupBy(N.stars(share).alias("stars")).agg(F.count("*").alias("n"))


def bool_parse(spark, d):
    word = F.element_at(F.array(*[F.lit(x) for x in (" True", "no", "1", "FALSE", "maybe", "yes ", "0")]), (F.col("l_linenumber")).cast("int"))
    return table(spark, d, "lineitem").groupBy(N.to_bool(word).alias("flag")).agg(F.count("*").alias("n"))


def select_cover(spark, d):
    """The first picture of type 'Cover', else the first picture, of the lines of each order."""
    kind = F.when(F.col("l_linenumber") == 3, "Cover").otherwise(F.concat(F.lit("Other"), F.col("l_linenumber").cast("string")))
    pics = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"))
    return R.select_cover(pics, "l_orderkey", "kind", ["l_linenumber", "l_partkey"], ["kind", "l_partkey"])


def record_snapshots(spark, d):
    """Title, artist and album of a record after each change an observer is told of."""
    return R.snapshots(_mapped(spark, d), ["title", "artist", "album"])


def typed_tag_values(spark, d):
    """Lines of an order as tags of four formats: positions, flags and ratings by the rules of each."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    k = F.col("l_partkey") % 7
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("iTunes", "asf", "exif", "ID3v2.4")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    value = F.when(k == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit("/"), (F.col("l_quantity").cast("int") % 3).cast("string"))).when(k < 4, pick(["", "1", "0", "yes", "", "", ""])).otherwise(((F.col("l_quantity") - 10) * 4).cast("int").cast("string"))
    rows = li.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("seq"), fmt.alias("format_id"), pick(["track", "compilation", "podcast", "gapless", "rating", "rating", "comment"]).alias("common_id"), value.alias("value"))
    t = R.typed_values(rows)
    return t.groupBy("format_id", "common_id", "value", "no", "of", "flag", F.round("share", 4).alias("share"), "stars", F.col("comment.text").alias("comment")).agg(F.count("*").alias("n"))


def list_rows_ordered(spark, d):
    """Values of lists that keep repeats, in order."""
    return R.list_rows(_mapped(spark, d))


QUERIES = {f.__name__: f for f in (tag_mapping_join, unmapped_tags, native_group_by, native_blocks, merge_singleton_priority, merge_artist_first, merge_list_unique, normalized_record, json_sink, event_snapshots, format_partial_update, tag_semantics_kinds, track_total_pair, rating_stars, bool_parse, select_cover, record_snapshots, list_rows_ordered, typed_tag_values)}

_MAP = catalog.sql_values(catalog.tag_map_rows(), "tm(f, nl, common_id)")
_PRI = catalog.sql_values(catalog.PRIORITY.items(), "pr(pf, p)")
_SEM = catalog.sql_values(catalog.semantics_rows(), "sm(cl, single, uniq)")
_BASE = f"""
    e AS (SELECT DISTINCT file_id, seq, format_id, tag_id, v_str, v_list, v_int, v_bool FROM tag_events WHERE file_id IS NOT NULL AND seq IS NOT NULL),
    v AS (SELECT file_id, seq, format_id, tag_id,
            coalesce(v_str, list_filter(v_list, lambda x: x <> '')[1], CAST(v_int AS VARCHAR), CASE WHEN v_bool THEN 'true' WHEN NOT v_bool THEN 'false' END) AS value,
            CASE WHEN len(list_filter(v_list, lambda x: x <> '')) > 0 THEN list_filter(v_list, lambda x: x <> '')
                 ELSE [coalesce(v_str, CAST(v_int AS VARCHAR), CASE WHEN v_bool THEN 'true' WHEN NOT v_bool THEN 'false' END)] END AS vals FROM e),
    m0 AS (SELECT v.file_id, v.seq, v.format_id, tm.common_id, v.value, v.vals FROM v JOIN {_MAP} ON v.format_id = tm.f AND lower(v.tag_id) = tm.nl WHERE v.value IS NOT NULL),
    m1 AS (SELECT file_id, seq, 1 AS sub, format_id, common_id, value, vals FROM m0
           UNION ALL SELECT file_id, seq, 0, format_id, 'year', CAST(try_cast(substr(value, 1, 4) AS INT) AS VARCHAR), [CAST(try_cast(substr(value, 1, 4) AS INT) AS VARCHAR)]
           FROM m0 WHERE common_id = 'date' AND length(value) >= 4 AND try_cast(substr(value, 1, 4) AS INT) IS NOT NULL),
    m AS (SELECT m1.*, coalesce(pr.p, 0) AS priority, coalesce(sm.single, TRUE) AS single, coalesce(sm.uniq, FALSE) AS uniq
          FROM m1 LEFT JOIN {_PRI} ON m1.format_id = pr.pf LEFT JOIN {_SEM} ON lower(m1.common_id) = sm.cl)"""
_SINGLE = "SELECT file_id, common_id, arg_max(value, (priority, seq, sub)) AS value FROM m WHERE single AND common_id <> 'artist' GROUP BY file_id, common_id"
_ARTIST = """SELECT file_id, arg_max(value, seq) AS value FROM (
        SELECT *, lag(format_id) OVER (PARTITION BY file_id ORDER BY seq) AS lf FROM (
            SELECT *, max(priority) OVER (PARTITION BY file_id) AS mp FROM m WHERE common_id = 'artist') WHERE priority = mp)
        WHERE lf IS NULL OR lf <> format_id GROUP BY file_id"""
_LISTS = """SELECT file_id, common_id, string_agg(x, '|' ORDER BY first_at) AS vals FROM (
        SELECT file_id, common_id, x, min((seq, i)) AS first_at FROM (
            SELECT file_id, common_id, seq, unnest(vals) AS x, unnest(range(len(vals))) AS i FROM (
                SELECT *, max(priority) OVER (PARTITION BY file_id, common_id) AS mp FROM m WHERE NOT single AND uniq) WHERE priority = mp)
        GROUP BY file_id, common_id, x) GROUP BY file_id, common_id"""
_RECORD = f""", s AS ({_SINGLE}), a AS ({_ARTIST}), l AS ({_LISTS}),
    ids AS (SELECT file_id FROM s WHERE common_id IN ('title','album','year','date','track') UNION SELECT file_id FROM a UNION SELECT file_id FROM l WHERE common_id = 'genre'),
    n AS (SELECT ids.file_id, max(CASE WHEN s.common_id = 'title' THEN s.value END) AS title, max(a.value) AS artist, max(CASE WHEN s.common_id = 'album' THEN s.value END) AS album,
            try_cast(trim(max(CASE WHEN s.common_id = 'year' THEN s.value END)) AS INT) AS "year", max(CASE WHEN s.common_id = 'date' THEN s.value END) AS "date",
            max(CASE WHEN s.common_id = 'track' THEN s.value END) AS track, max(l.vals) AS genre
          FROM ids LEFT JOIN s USING (file_id) LEFT JOIN a USING (file_id) LEFT JOIN l ON l.file_id = ids.file_id AND l.common_id = 'genre' GROUP BY ids.file_id)"""
_TRACK = "try_cast(split_part(trim(track), '/', 1) AS INT)"

ORACLE = {
    "tag_mapping_join": f"WITH {_BASE} SELECT file_id, seq, sub, format_id, common_id, value, priority FROM m",
    "unmapped_tags": f"WITH {_BASE} SELECT format_id, lower(tag_id) AS native_lower, count(*) AS n FROM v WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_MAP} WHERE tm.f = v.format_id AND tm.nl = lower(v.tag_id)) GROUP BY 1, 2",
    "native_group_by": f"WITH {_BASE} SELECT file_id, format_id, lower(tag_id) AS native_lower, count(*) AS n, arg_min(value, seq) AS \"first\", arg_max(value, seq) AS \"last\" FROM v WHERE value IS NOT NULL GROUP BY 1, 2, 3",
    "native_blocks": f"WITH {_BASE} SELECT file_id, format_id, lower(tag_id) AS native_lower, CAST(floor(seq / 4096.0) AS BIGINT) AS block, CAST(sum(len(vals)) AS INT) AS n, md5(string_agg(array_to_string(vals, '|'), '|' ORDER BY seq)) AS digest FROM v WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4",
    "merge_singleton_priority": f"WITH {_BASE} {_SINGLE}",
    "merge_artist_first": f"WITH {_BASE} {_ARTIST}",
    "merge_list_unique": f"WITH {_BASE} {_LISTS}",
    "normalized_record": f"WITH {_BASE}{_RECORD} SELECT file_id, title, artist, album, \"year\", \"date\", {_TRACK} AS track_no, CASE WHEN contains(track, '/') THEN try_cast(split_part(trim(track), '/', 2) AS INT) END AS track_of, genre FROM n",
    "event_snapshots": f"""WITH {_BASE}, w AS (SELECT *, max(priority) OVER (PARTITION BY file_id, common_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WHERE sub = 1),
        k AS (SELECT *, lag(format_id) OVER (PARTITION BY file_id, common_id ORDER BY seq) AS lf FROM w WHERE before IS NULL OR priority >= before)
        SELECT file_id, common_id, seq, value FROM k WHERE common_id <> 'artist' OR lf IS NULL OR lf <> format_id""",
    "record_snapshots": f"""WITH {_BASE}, w AS (SELECT *, max(priority) OVER (PARTITION BY file_id, common_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WHERE sub = 1),
        k AS (SELECT *, lag(format_id) OVER (PARTITION BY file_id, common_id ORDER BY seq) AS lf FROM w WHERE before IS NULL OR priority >= before),
        c AS (SELECT file_id, common_id, seq, value FROM k WHERE common_id <> 'artist' OR lf IS NULL OR lf <> format_id)
        SELECT file_id, common_id, seq, {', '.join(f"last_value(CASE WHEN common_id = '{f}' THEN value END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq, common_id ROWS UNBOUNDED PRECEDING) AS {f}" for f in ('title', 'artist', 'album'))} FROM c""",
    "typed_tag_values": """WITH r AS (SELECT l_partkey % 7 AS k, ['iTunes', 'asf', 'exif', 'ID3v2.4'][l_suppkey % 4 + 1] AS format_id, ['track', 'compilation', 'podcast', 'gapless', 'rating', 'rating', 'comment'][l_partkey % 7 + 1] AS common_id,
            CASE WHEN l_partkey % 7 = 0 THEN l_linenumber || '/' || CAST(l_quantity AS INT) % 3 WHEN l_partkey % 7 < 4 THEN ['', '1', '0', 'yes'][l_partkey % 7 + 1] ELSE CAST(CAST((l_quantity - 10) * 4 AS INT) AS VARCHAR) END AS value, l_linenumber, CAST(l_quantity AS INT) % 3 AS q FROM lineitem),
        s AS (SELECT *, CASE WHEN common_id = 'rating' THEN CASE WHEN format_id IN ('asf', 'exif') THEN least(greatest(CAST(value AS DOUBLE) / 100, 0), 1) ELSE CAST(value AS DOUBLE) / 100 END END AS sh FROM r)
        SELECT format_id, common_id, value, CASE WHEN k = 0 THEN l_linenumber END AS "no", CASE WHEN k = 0 AND NOT (format_id = 'iTunes' AND q = 0) THEN q END AS "of", CASE k WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN TRUE END AS flag,
            round(sh, 4) AS share, CASE WHEN sh IS NOT NULL THEN CAST(least(greatest(round(sh * 4 + 1), 1), 5) AS INT) END AS stars, CASE WHEN k = 6 THEN value END AS comment, count(*) AS n
        FROM s GROUP BY ALL""",
    "list_rows_ordered": f"""WITH {_BASE} SELECT file_id, common_id, seq, CAST(unnest(range(len(vals))) AS INT) AS pos, unnest(vals) AS value FROM (
        SELECT *, max(priority) OVER (PARTITION BY file_id, common_id) AS mp FROM m WHERE NOT single AND NOT uniq) WHERE priority = mp""",
    "json_sink": f"""WITH {_BASE}{_RECORD}, t AS (SELECT file_id, CASE WHEN title IS NOT NULL THEN '"title":' || CAST(to_json(title) AS VARCHAR) END AS a, CASE WHEN "year" IS NOT NULL THEN '"year":' || "year" END AS b, CASE WHEN {_TRACK} IS NOT NULL THEN '"track_no":' || {_TRACK} END AS c FROM n)
        SELECT file_id, '{{' || concat_ws(',', a, b, c) || '}}' AS doc FROM t""",
    "format_partial_update": "SELECT file_id, arg_max(container, scanned_at) FILTER (WHERE container IS NOT NULL) AS container, arg_max(codec, scanned_at) FILTER (WHERE codec IS NOT NULL) AS codec, arg_max(sample_rate, scanned_at) FILTER (WHERE sample_rate IS NOT NULL) AS sample_rate, arg_max(channels, scanned_at) FILTER (WHERE channels IS NOT NULL) AS channels FROM audio_files GROUP BY file_id",
    "tag_semantics_kinds": f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN single THEN 'singleton' ELSE 'list' END AS kind FROM {_SEM} UNION ALL SELECT 'unique' FROM {_SEM} WHERE NOT single AND uniq) GROUP BY kind",
    "track_total_pair": "SELECT l_linenumber AS no, CASE WHEN l_linenumber % 3 = 0 OR CAST(l_quantity AS INT) % 5 = 0 THEN NULL ELSE CAST(l_quantity AS INT) % 5 END AS \"of\", count(*) AS n FROM lineitem GROUP BY 1, 2",
    "rating_stars": "SELECT CAST(least(greatest(round(least(greatest(l_discount * 1000, 0), 100) / 100 * 4 + 1), 1), 5) AS INT) AS stars, count(*) AS n FROM lineitem GROUP BY 1",
    "bool_parse": "SELECT CASE WHEN l_linenumber IN (1, 3, 6) THEN TRUE WHEN l_linenumber IN (2, 4, 7) THEN FALSE END AS flag, count(*) AS n FROM lineitem GROUP BY 1",
    "select_cover": "SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN 'Cover' ELSE 'Other' || l_linenumber END AS kind, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 END, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1",
}
