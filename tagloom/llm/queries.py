"""Queries of the text-corpus operators, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.canonical import mapped_values
from tagloom.llm.cut_off import cut_rates, cut_values
from tagloom.llm.encoding import garbled_values
from tagloom.llm.packing import fill_report, pack_corpus
from tagloom.llm.plain import changed_values, plain_values
from tagloom.llm.subjects import corpus_makeup, document_areas
from tagloom.llm.tokens import decode_corpus, encode_corpus
from tagloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changed_values(table(spark, d, "common_tags")).select("rec_id", "fieldname").distinct()


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """How many readings and spellings each plain form of a title or artist has."""
    forms = plain_values(table(spark, d, "common_tags"))
    return forms.groupBy("fieldname", "plain").agg(F.count("*").alias("readings"), F.countDistinct("value").alias("spellings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_values(table(spark, d, "common_tags")).select("rec_id", "fieldname").distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The garbled values beside the text as it was tagged, where it can be had."""
    return garbled_values(table(spark, d, "common_tags"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped_values(table(spark, d, "common_tags"), table(spark, d, "genre_list")).select("rec_id", "genre_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry of the list, and how often each stands."""
    found = mapped_values(table(spark, d, "common_tags"), table(spark, d, "genre_list")).where("genre_id = 0")
    return found.groupBy("genre").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_values(table(spark, d, "common_tags")).select("rec_id", "fieldname").distinct()


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return cut_rates(table(spark, d, "common_tags"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: the texts again, from their ids."""
    return decode_corpus(encode_corpus(table(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_corpus(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(pack_corpus(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return document_areas(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    return corpus_makeup(p10_found(spark, d), table(spark, d, "subject_areas"))


QUERIES = {"p10_found": p10_found, "p10_makeup": p10_makeup, "p7_found": p7_found, "p7_rates": p7_rates, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p2_found": p2_found, "p2_forms": p2_forms, "p4_found": p4_found, "p4_repaired": p4_repaired, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p9_fill": p9_fill}

ORACLE = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
