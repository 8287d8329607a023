"""Queries of the training-data problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadweave.llm.components import components
from roadweave.llm.mixing import mix
from roadweave.llm.packing import pack, report
from roadweave.llm.pii import find_personal, redact
from roadweave.llm.topn import latest_top_n
from roadweave.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components(table(spark, d, "directed_edges"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    top = latest_top_n(table(spark, d, "access_candidates"), ["PRO_COM"], "distance_m", "node_id", "loaded_at", 5)
    return top.selectExpr("PRO_COM as pro_com", "cast(rank as int) as rank", "node_id")


#: Tokens a container holds.
CAPACITY = 2048


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), "doc_id", "text", CAPACITY)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return report(table(spark, d, "documents"), "doc_id", "text", CAPACITY)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"), "doc_id", "text", "source")[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"), "doc_id", "text", "source")[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "documents").select("doc_id", "text"), "text")


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p8_containers, p8_report, p9_mixture, p9_shares, p10_found, p10_redacted)}
