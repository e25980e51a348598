"""Queries of loader dispatch, fetch planning, lyrics and chapters, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.functions import lyrics as LY
from tagloom.operators import chapters as C
from tagloom.operators import strategy as S
from tagloom.session import table

_c = F.col


def dispatch_mime_ext(spark, d):
    files = table(spark, d, "audio_files").select("file_id", "file_path", F.lower("mime_type").alias("mime_type"), (F.col("file_id") % 5 != 0).alias("seekable")).distinct()
    return S.dispatch(files, can_seek="seekable").select("file_id", "ext", "loader", "error")


def loader_keys(spark, d):
    return catalog.parser_registry(spark).select("kind", "key", "loader")


def _remote(spark, d):
    """Files as remote objects; the path has a query part, some servers know no ranges."""
    f = table(spark, d, "audio_files").select("file_id", "file_path", "mime_type", "byte_len").distinct()
    url = F.concat(F.lit("https://media.invalid/"), "file_path", F.when(_c("file_id") % 2 == 0, "?v=1.2#t.x").otherwise(""))
    f = f.select("file_id", url.alias("url"), F.when(_c("file_id") % 3 == 0, _c("mime_type")).alias("mime"), _c("byte_len").alias("size"), (_c("file_id") % 7 != 0).alias("ranges"))
    return f.withColumn("category", S.category(_c("url"), _c("mime")))


def url_extension(spark, d):
    return _remote(spark, d).select("file_id", S.url_extension(_c("url")).alias("ext"), "category")


def strategy_choice(spark, d):
    return _remote(spark, d).select("file_id", "category", S.strategy(_c("size"), _c("ranges"), _c("category")).alias("strategy"), S.probe_of(_c("category")).alias("probe"))


def probe_ranges_merged(spark, d):
    """Merged probe ranges of every file; one of unknown size is read from 0 to its end."""
    r = _remote(spark, d)
    merged = S.merge_ranges(S.probe_ranges(_c("size"), S.probe_of(_c("category")), _c("file_id")))
    return r.select("file_id", F.inline(merged)).select("file_id", "lo", "hi")


def fetch_statistics(spark, d):
    """Bytes and requests a plan takes per strategy."""
    r = _remote(spark, d)
    ranges = S.merge_ranges(S.probe_ranges(_c("size"), S.probe_of(_c("category")), _c("file_id")))
    g = r.select("category", ranges.alias("r")).select("category", F.size("r").cast("long").alias("requests"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["hi"] - x["lo"], F.lit(0))).alias("bytes"), F.size(S.request_batches(_c("r"))).cast("long").alias("batches"))
    return g.groupBy("category").agg(F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"), F.sum("batches").alias("batches"))


def chunk_islands(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (_c("l_partkey") % 12).alias("chunk"))
    return S.chunk_islands(li, "l_orderkey", "chunk")


def missing_chunks(spark, d):
    p = table(spark, d, "part")
    got = S.missing_chunks(_c("p_size") * 1000, _c("p_size") * 9000 + _c("p_partkey"), F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))
    return p.select("p_partkey", F.explode(got).alias("chunk"))


def lrc_sync_lines(spark, d):
    """Lines of an order as timed lyrics; odd lines stamp thousandths."""
    li = table(spark, d, "lineitem")
    n = _c("l_linenumber")
    stamp = F.concat(F.lit("["), F.lpad((_c("l_partkey") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((_c("l_suppkey") % 60).cast("string"), 2, "0"), F.lit("."), F.when(n % 2 == 1, F.lpad((_c("l_partkey") % 1000).cast("string"), 3, "0")).otherwise(F.lpad((_c("l_partkey") % 100).cast("string"), 2, "0")), F.lit("]"))
    line = F.concat(stamp, F.when(n == 2, "[00:01.00]").otherwise(""), _c("l_returnflag"), F.lit(" line "), n.cast("string"))
    texts = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    text = texts.select("l_orderkey", F.concat(F.lit("[la:en]\n"), "t", F.lit("\nno stamp")).alias("text"))
    return text.select("l_orderkey", LY.header(_c("text"), "la").alias("language"), F.posexplode(LY.synced_lines(_c("text"))).alias("pos", "x")).select("l_orderkey", "language", "pos", "x.ms", "x.text")


def lrc_unsynced(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.lit("  "), "o_orderpriority", F.when(_c("o_orderkey") % 2 == 0, "\n[00:10.50]x").otherwise(" "))
    return o.select("o_orderkey", LY.unsynced_text(text).alias("text"))


def lyrics3_fields(spark, d):
    p = table(spark, d, "part")
    body = F.concat(F.lit("LYRICSBEGININD00003110LYR"), F.lpad(F.length("p_name").cast("string"), 5, "0"), "p_name")
    whole = F.concat(body, F.lpad(F.length(body).cast("string"), 6, "0"), F.lit("LYRICS200"))
    return p.select("p_partkey", LY.lyrics3_size(F.right(whole, F.lit(15))).alias("size"), LY.lyrics3_field(body, "IND").alias("ind"), LY.lyrics3_field(body, "LYR").alias("lyr"))


def chapter_ends(spark, d):
    return C.chapter_ends(table(spark, d, "chap"))


def chapter_titles(spark, d):
    c = table(spark, d, "chap").select("file_id", "start_ms", "title").where("file_id IS NOT NULL AND start_ms IS NOT NULL").distinct()
    return C.default_titles(c, "file_id", "start_ms").select("file_id", "start_ms", "n", "title")


def toc_join(spark, d):
    """Table of contents made of labels chp0..chp3 in reverse; chapters by label."""
    chap = table(spark, d, "chap").select("file_id", "chap_label", "title", "start_ms").distinct()
    files = chap.select("file_id").distinct()
    toc = files.select("file_id", F.posexplode(F.array(*[F.lit(f"chp{i}") for i in (3, 2, 9999, 1, 0)])).alias("pos", "child"))
    return C.toc_order(toc, chap, "file_id", "pos", "child", "chap_label")


def vorbis_chapters(spark, d):
    c = table(spark, d, "chap").where("start_ms IS NOT NULL AND file_id IS NOT NULL").groupBy("file_id", "start_ms").agg(F.max("title").alias("title"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("file_id").orderBy("start_ms"))
    c = c.withColumn("n", n)
    t = _c("start_ms")
    wide = lambda x, least: F.lpad(x.cast("string"), F.greatest(F.length(x.cast("string")), F.lit(least)), F.lit("0"))
    stamp = F.concat(wide(F.floor(t / 3600000), 2), F.lit(":"), F.lpad((F.floor(t / 60000) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(t / 1000) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((t % 1000).cast("string"), 3, "0"))
    name = F.concat(F.lit("CHAPTER"), wide(_c("n"), 3))
    rows = c.select("file_id", F.inline(F.array(F.struct(name.alias("k"), stamp.alias("v")), F.struct(F.concat(name, F.lit("NAME")).alias("k"), _c("title").alias("v")))))
    return C.vorbis_chapters(rows, "file_id", "k", "v")


def _stts(spark, d):
    from pyspark.sql import Window

    li = table(spark, d, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return li.select("l_orderkey", idx.alias("idx"), _c("l_quantity").cast("long").alias("cnt"), (_c("l_partkey") % 1000 + 1).alias("dur"), (_c("l_suppkey") % 4 + 1).alias("spc"))


def stts_running_sum(spark, d):
    return C.running_offsets(_stts(spark, d), "l_orderkey", "idx", "cnt", "dur").select("l_orderkey", "idx", "first_sample", "first_time")


def stts_sample_times(spark, d):
    s = _stts(spark, d)
    samples = s.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 7, 30, 61, 400)])).alias("sample"))
    return C.sample_times(samples, s, "l_orderkey", "sample", "idx", "cnt", "dur")


def stsc_range_join(spark, d):
    s = _stts(spark, d).select("l_orderkey", (_c("idx") * 3 - 2).alias("first_chunk"), "spc")
    chunks = s.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("chunk"))
    return C.samples_per_chunk(chunks, s, "l_orderkey", "chunk", "first_chunk", "spc")


def chunk_asof(spark, d):
    s = _stts(spark, d).select("l_orderkey", "idx", (_c("idx") * 1000).cast("long").alias("off"))
    points = s.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(*[F.lit(x).cast("long") for x in (500, 1000, 1001, 2500, 99999)])).alias("at"))
    return C.chunk_before(points, s, "l_orderkey", "at", "off", "idx").withColumnRenamed("idx", "chunk")


def chunk_durations(spark, d):
    s = _stts(spark, d)
    return C.chunk_durations(s.select("l_orderkey", "idx", "spc"), s, "l_orderkey", "idx", "spc", "idx", "cnt", "dur").withColumnRenamed("idx", "chunk")


def chpl_timebase(spark, d):
    o = table(spark, d, "orders")
    secs = _c("o_totalprice") / 100
    clock = F.element_at(F.array(*[F.lit(x) for x in (1000, 44100, 10000000, 30000)]), (_c("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", C.time_base(F.floor(secs * clock * 0.995).cast("double"), secs).alias("clock"))


def matroska_track_pick(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (_c("l_returnflag") == "R").alias("def"), (_c("l_linenumber") * 100000 + _c("l_partkey")).alias("num"), "l_linenumber", "l_partkey")
    return C.best_track(li, "l_orderkey", "def", "num", ["l_linenumber", "l_partkey"])


QUERIES = {f.__name__: f for f in (dispatch_mime_ext, loader_keys, url_extension, strategy_choice, probe_ranges_merged, fetch_statistics, chunk_islands, missing_chunks, lrc_sync_lines, lrc_unsynced, lyrics3_fields, chapter_ends, chapter_titles, toc_join, vorbis_chapters, stts_running_sum, stts_sample_times, stsc_range_join, chunk_asof, chunk_durations, chpl_timebase, matroska_track_pick)}

_REG = catalog.sql_values(sorted({(k, key): (k, key, loader, seek) for k, key, loader, seek, _ in catalog.loader_rows()}.values()), "rg(kind, k, loader, seek)")


def _cat(url_ext: str) -> str:
    cases = []
    for name, (exts, parts) in S.CATEGORIES.items():
        hits = [f"contains(lower(coalesce(mime, '')), '{p}')" for p in parts.split()]
        cases.append(f"WHEN {url_ext} IN ({', '.join(repr(e) for e in exts.split())}) OR {' OR '.join(hits)} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'unknown' END"


_EXT = "lower(nullif(regexp_extract({0}, '^.+\\.([^.]+)$', 1), ''))"
_FILE = "regexp_extract(file_path, '([^/]*)$', 1)"
_REMOTE = f"r AS (SELECT *, {_cat('coalesce(ext, ' + repr('') + ')')} AS category FROM (SELECT DISTINCT file_id, byte_len AS size, CASE WHEN file_id % 3 = 0 THEN mime_type END AS mime, file_id % 7 <> 0 AS ranges, {_EXT.format(_FILE)} AS ext FROM audio_files))"
_PROBE = "CASE category WHEN 'mp4' THEN 'mp4Optimized' WHEN 'mpeg' THEN 'headerAndTail' WHEN 'header-only' THEN 'headerOnly' ELSE 'scatter' END"
_RANGES = f"""{_REMOTE}, k AS (SELECT file_id, size, category FROM r WHERE size IS NOT NULL),
    g AS (SELECT file_id, category, 0 AS lo, least(262144, size) AS hi FROM k
        UNION ALL SELECT file_id, category, (size - 65536) // 65536 * 65536, size FROM k WHERE category IN ('mpeg', 'unknown') AND size > 262144
        UNION ALL SELECT file_id, category, (size // 2 - 32768) // 65536 * 65536, (size // 2 - 32768) // 65536 * 65536 + 65536 FROM k WHERE category = 'unknown' AND size > 524288
        UNION ALL SELECT file_id, category, x, x + 65536 FROM (SELECT *, (((file_id % 2147483648) * 1103515245 + 12345 * i) % (size - 131072) + 65536) // 65536 * 65536 AS x FROM k, (VALUES (1), (2)) AS v(i) WHERE category = 'unknown' AND size > 1048576)
        UNION ALL SELECT file_id, category, CASE WHEN size > 16777216 THEN (size - 16777216) // 65536 * 65536 ELSE 0 END, size FROM k WHERE category = 'mp4'
        UNION ALL SELECT file_id, category, (size * q // 4) // 65536 * 65536, least((size * q // 4) // 65536 * 65536 + 65536, size) FROM k, (VALUES (1), (2), (3)) AS v(q) WHERE category = 'mp4' AND size > 524288),
    o AS (SELECT *, max(hi) OVER (PARTITION BY file_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM g),
    i AS (SELECT *, sum(CASE WHEN ph IS NULL OR lo > ph THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS gi FROM o),
    mg AS (SELECT file_id, category, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY file_id, category, gi UNION ALL SELECT file_id, category, 0, NULL FROM r WHERE size IS NULL)"""
_STTS = "s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS idx, CAST(l_quantity AS BIGINT) AS cnt, l_partkey % 1000 + 1 AS dur, l_suppkey % 4 + 1 AS spc FROM lineitem)"
_RUN = f"{_STTS}, t AS (SELECT *, CAST(coalesce(sum(cnt) OVER w, 0) AS BIGINT) AS first_sample, CAST(coalesce(sum(cnt * dur) OVER w, 0) AS BIGINT) AS first_time FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_STAMPMS = "(l_partkey % 60 * 60 + l_suppkey % 60) * 1000 + CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 1000 ELSE l_partkey % 100 * 10 END"

ORACLE = {
    "dispatch_mime_ext": f"""WITH f AS (SELECT DISTINCT file_id, file_path, lower(mime_type) AS mime, {_EXT.format('file_path')} AS ext, file_id % 5 <> 0 AS seekable FROM audio_files),
        j AS (SELECT f.*, m.loader AS ml, m.seek AS ms, e.loader AS el, e.seek AS es FROM f LEFT JOIN (SELECT * FROM {_REG}) m ON m.kind = 'mime' AND m.k = f.mime LEFT JOIN (SELECT * FROM {_REG}) e ON e.kind = 'ext' AND e.k = f.ext)
        SELECT file_id, ext, CASE WHEN NOT (coalesce(CASE WHEN ml IS NOT NULL THEN ms ELSE es END, FALSE) AND NOT seekable) THEN coalesce(ml, el) END AS loader,
            CASE WHEN coalesce(ml, el) IS NULL THEN 'CouldNotDetermineFileTypeError' WHEN CASE WHEN ml IS NOT NULL THEN ms ELSE es END AND NOT seekable THEN 'UnsupportedFileTypeError' END AS error FROM j""",
    "loader_keys": f"SELECT kind, k AS key, loader FROM {_REG}",
    "url_extension": f"WITH {_REMOTE} SELECT file_id, ext, category FROM r",
    "strategy_choice": f"WITH {_REMOTE} SELECT file_id, category, CASE WHEN size IS NULL OR size <= 5242880 OR NOT ranges THEN 'fullDownload' WHEN category = 'header-only' THEN 'headerOnly' WHEN size > 52428800 THEN 'randomAccess' ELSE 'probe' END AS strategy, {_PROBE} AS probe FROM r",
    "probe_ranges_merged": f"WITH {_RANGES} SELECT file_id, lo, hi FROM mg",
    "fetch_statistics": f"WITH {_RANGES}, pf AS (SELECT file_id, category, count(*) AS n, sum(coalesce(hi - lo, 0)) AS b FROM mg GROUP BY 1, 2) SELECT category, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum((n + 3) // 4) AS BIGINT) AS batches FROM pf GROUP BY category",
    "chunk_islands": "WITH c AS (SELECT DISTINCT l_orderkey, l_partkey % 12 AS c FROM lineitem), g AS (SELECT *, c - row_number() OVER (PARTITION BY l_orderkey ORDER BY c) AS gi FROM c) SELECT l_orderkey, min(c) AS lo, max(c) AS hi, max(c) - min(c) + 1 AS n FROM g GROUP BY l_orderkey, gi",
    "missing_chunks": "SELECT p_partkey, c AS chunk FROM (SELECT p_partkey, unnest(range((p_size * 1000) // 65536, (p_size * 9000 + p_partkey - 1) // 65536 + 1)) AS c FROM part WHERE p_size * 9000 + p_partkey > p_size * 1000) WHERE c NOT IN (1, 3)",
    "lrc_sync_lines": f"SELECT l_orderkey, 'en' AS language, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS INT) AS pos, {_STAMPMS} AS ms, l_returnflag || ' line ' || l_linenumber AS text FROM lineitem",
    "lrc_unsynced": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN trim(o_orderpriority) END AS text FROM orders",
    "lyrics3_fields": "SELECT p_partkey, CAST(30 + length(p_name) AS INT) AS size, '110' AS ind, p_name AS lyr FROM part",
    "chapter_ends": "WITH c AS (SELECT DISTINCT file_id, start_ms, title, end_ms FROM chap WHERE file_id IS NOT NULL AND start_ms IS NOT NULL), s AS (SELECT *, lead(start_ms) OVER (PARTITION BY file_id ORDER BY start_ms) AS nx FROM (SELECT DISTINCT file_id, start_ms FROM c)) SELECT c.file_id, c.start_ms, c.title, coalesce(c.end_ms, s.nx) AS until FROM c JOIN s ON c.file_id = s.file_id AND c.start_ms = s.start_ms",
    "chapter_titles": "SELECT file_id, start_ms, CAST(n AS INT) AS n, coalesce(nullif(trim(title), ''), 'Chapter ' || n) AS title FROM (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY start_ms) AS n FROM (SELECT DISTINCT file_id, start_ms, title FROM chap WHERE file_id IS NOT NULL AND start_ms IS NOT NULL))",
    "toc_join": "WITH c AS (SELECT DISTINCT file_id, chap_label, title, start_ms FROM chap) SELECT c.file_id, t.pos, c.chap_label, c.title, c.start_ms FROM (VALUES (0, 'chp3'), (1, 'chp2'), (2, 'chp9999'), (3, 'chp1'), (4, 'chp0')) AS t(pos, child) JOIN c ON c.chap_label = t.child WHERE c.file_id IS NOT NULL",
    "vorbis_chapters": "WITH c AS (SELECT file_id, start_ms, max(title) AS title FROM chap WHERE file_id IS NOT NULL AND start_ms IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms) AS n FROM c) SELECT file_id, CAST(n AS INT) AS n, start_ms, coalesce(nullif(trim(title), ''), 'Chapter ' || n) AS title, lead(start_ms) OVER (PARTITION BY file_id ORDER BY start_ms) AS end_ms FROM n",
    "stts_running_sum": f"WITH {_RUN} SELECT l_orderkey, CAST(idx AS INT) AS idx, first_sample, first_time FROM t",
    "stts_sample_times": f"WITH {_RUN}, p AS (SELECT DISTINCT s.l_orderkey, CAST(v.x AS BIGINT) AS sample FROM s, (VALUES (0), (7), (30), (61), (400)) AS v(x)) SELECT p.l_orderkey, p.sample, t.first_time + (p.sample - t.first_sample) * t.dur AS \"time\" FROM p LEFT JOIN t ON p.l_orderkey = t.l_orderkey AND p.sample >= t.first_sample AND p.sample < t.first_sample + t.cnt",
    "stsc_range_join": f"WITH {_STTS}, e AS (SELECT l_orderkey, idx * 3 - 2 AS f, lead(idx * 3 - 2) OVER (PARTITION BY l_orderkey ORDER BY idx) AS t, spc FROM s), c AS (SELECT DISTINCT s.l_orderkey, CAST(v.x AS INT) AS chunk FROM s, range(1, 13) AS v(x)) SELECT c.l_orderkey, c.chunk, e.spc AS n FROM c JOIN e ON c.l_orderkey = e.l_orderkey AND c.chunk >= e.f AND (e.t IS NULL OR c.chunk < e.t)",
    "chunk_asof": f"WITH {_STTS}, p AS (SELECT DISTINCT s.l_orderkey, CAST(v.x AS BIGINT) AS \"at\" FROM s, (VALUES (500), (1000), (1001), (2500), (99999)) AS v(x)) SELECT p.l_orderkey, p.\"at\", CAST(coalesce(max(s.idx), 1) AS BIGINT) AS chunk FROM p LEFT JOIN s ON p.l_orderkey = s.l_orderkey AND s.idx * 1000 < p.\"at\" GROUP BY 1, 2",
    "chunk_durations": f"WITH {_RUN}, c AS (SELECT l_orderkey, idx, CAST(coalesce(sum(spc) OVER (PARTITION BY l_orderkey ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM s) SELECT c.l_orderkey, CAST(c.idx AS INT) AS chunk, CAST(sum(greatest(least(c.st, t.first_sample + t.cnt) - t.first_sample, 0) * t.dur) AS BIGINT) AS \"time\" FROM c JOIN t ON c.l_orderkey = t.l_orderkey GROUP BY 1, 2",
    "chpl_timebase": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 44100 WHEN 2 THEN 10000000 ELSE CAST(round(floor(o_totalprice / 100 * 30000 * 0.995) / (o_totalprice / 100)) AS BIGINT) END AS clock FROM orders",
    "matroska_track_pick": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1",
}
