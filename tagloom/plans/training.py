"""Queries of the general training-data operators, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.intervals import periods_and_gaps
from tagloom.operators.nested import flatten_records
from tagloom.operators.packed import packed_rows
from tagloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_rows(table(spark, d, "common_tags"), table(spark, d, "artist_roster"), table(spark, d, "genre_list"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field hold how many names."""
    per_value = p1_found(spark, d).groupBy("rec_id", "fieldname").agg(F.count("*").alias("names"))
    return per_value.groupBy("fieldname", "names").agg(F.count("*").alias("n_values"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "chap"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(table(spark, d, "raw_records"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p3_found": p3_found, "p6_found": p6_found}

ORACLE = {
    "p3_found": """
        WITH c AS (SELECT file_id, start_ms AS s, end_ms AS e FROM chap WHERE file_id IS NOT NULL AND start_ms IS NOT NULL),
        st AS (SELECT file_id, s, lead(s) OVER (PARTITION BY file_id ORDER BY s) AS nx FROM (SELECT DISTINCT file_id, s FROM c)),
        v AS (SELECT DISTINCT c.file_id, c.s, coalesce(c.e, st.nx) AS e FROM c JOIN st ON c.file_id = st.file_id AND c.s = st.s WHERE coalesce(c.e, st.nx) > c.s),
        m AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v),
        g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS gi FROM m),
        p AS (SELECT file_id, min(s) AS a, max(e) AS b FROM g GROUP BY file_id, gi),
        q AS (SELECT *, lead(a) OVER (PARTITION BY file_id ORDER BY a) AS na FROM p)
        SELECT file_id, 'period' AS kind, a AS from_ms, b AS to_ms FROM q
        UNION ALL SELECT file_id, 'gap', b, na FROM q WHERE na IS NOT NULL""",
}
