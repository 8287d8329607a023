"""Data-quality gates as DataFrames: (check, value, expected, status), batched per relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (a condition that marks a bad row), in one pass."""
    sums = df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in rules.items()])
    return _long(sums, {n: 0 for n in rules})


def _long(one: DataFrame, expected: dict[str, float]) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("value"), F.lit(float(e)).alias("expected")) for n, e in expected.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("status", F.when(F.col("value") == F.col("expected"), "PASS").otherwise("CHECK_REQUIRED"))


def unique_gate(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return _long(df.groupBy(*keys).count().agg(F.coalesce(F.sum((F.col("count") > 1).cast("int")), F.lit(0)).alias(name)), {name: 0})


def conservation_gate(a: DataFrame, b: DataFrame, column: str, name: str, tolerance: float = 1e-9) -> DataFrame:
    """Whether a total is the same in two tables."""
    both = a.agg(F.sum(column).alias("x")).join(F.broadcast(b.agg(F.sum(column).alias("y"))))
    return _long(both.select((F.abs(F.col("x") - F.col("y")) > tolerance).cast("int").alias(name)), {name: 0})


def dependency_gate(df: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """Keys with more than one combination of the values that should follow from them."""
    n = df.groupBy(key).agg(F.countDistinct(F.struct(*values)).alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("int")), F.lit(0)).alias(name))
    return _long(n, {name: 0})


def dense_gate(df: DataFrame, index: str, name: str) -> DataFrame:
    """Whether an index is dense from 0: rows, distinct and range agree."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    ok = (F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    return _long(n.select((~F.coalesce(ok, F.col("n") == 0)).cast("int").alias(name)), {name: 0})


def regression_gate(new: DataFrame, frozen: DataFrame, keys: list[str], column: str, name: str, tolerance: float) -> DataFrame:
    """Keys that miss on a side or differ by more than a tolerance."""
    j = new.select(*keys, F.col(column).alias("a")).join(frozen.select(*keys, F.col(column).alias("b")), keys, "full")
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance)
    return _long(j.agg(F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias(name)), {name: 0})


def report(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, gates)


def verdict(gates: DataFrame) -> DataFrame:
    """One row: PASS if every gate passed."""
    return gates.agg(F.when(F.sum((F.col("status") != "PASS").cast("int")) == 0, "PASS").otherwise("CHECK_REQUIRED").alias("verdict"), F.count(F.lit(1)).alias("checks"))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("copies > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def classifier_metrics(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Per class: predicted, true, right, precision and recall; overall accuracy beside."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    long = df.select(F.explode(F.array_distinct(F.array(predicted, truth))).alias("class"), F.col(predicted).alias("p"), F.col(truth).alias("t"))
    g = long.groupBy("class").agg(n(F.col("p") == F.col("class")).alias("predicted"), n(F.col("t") == F.col("class")).alias("actual"), n((F.col("p") == F.col("class")) & (F.col("t") == F.col("class"))).alias("right"))
    return g.where(F.col("class").isNotNull()).select("class", "predicted", "actual", "right", F.round(F.try_divide("right", "predicted"), 6).alias("precision"), F.round(F.try_divide("right", "actual"), 6).alias("recall"))


def stratified(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """``n`` rows per stratum, chosen by a hash of the key: the same on every run."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def tag_census(df: DataFrame, tags: str) -> DataFrame:
    """Per key of a JSON text column: occurrences and distinct values."""
    kv = df.select(F.explode(F.from_json(tags, "map<string,string>")).alias("k", "v"))
    return kv.groupBy(F.col("k").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("distinct_values"))
