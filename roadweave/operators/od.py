"""Origin-destination tables: membership, shares, validated joins, symmetric flows, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.routing import all_pairs

#: Vehicle trips a day per commuter relation (a fixed value).
ALPHA = 0.42855


def membership(od: DataFrame, inside: DataFrame, code: str, o: str = "o", d: str = "d") -> DataFrame:
    """``od`` with flags o_in, d_in and same (origin is destination).

    ``inside`` is joined by its size (AQE turns a small one into a broadcast).
    """
    one = inside.select(F.col(code)).distinct()
    for end, flag in ((o, "o_in"), (d, "d_in")):
        od = od.join(one.select(F.col(code).alias(f"_{flag}")), F.col(end) == F.col(f"_{flag}"), "left").withColumn(flag, F.col(f"_{flag}").isNotNull()).drop(f"_{flag}")
    return od.withColumn("same", F.col(o) == F.col(d))


def intra_inter_share(od: DataFrame, flow: str = "flow") -> DataFrame:
    """Flows within and between zones inside the region, with their share in percent."""
    inner = od.where("o_in and d_in").groupBy(F.when(F.col("same"), "intra").otherwise("inter").alias("kind")).agg(F.sum(flow).alias("flow"), F.count(F.lit(1)).alias("relations"))
    total = F.sum("flow").over(Window.partitionBy())
    return inner.withColumn("share_pct", F.round(100.0 * F.col("flow") / total, 2))


def extra_direction(od: DataFrame, flow: str = "flow") -> DataFrame:
    """Flows with exactly one end inside, by direction."""
    cross = od.where(F.col("o_in") != F.col("d_in"))
    return cross.groupBy(F.when(F.col("o_in"), "out").otherwise("in").alias("direction")).agg(F.sum(flow).alias("flow"), F.count(F.lit(1)).alias("relations"), F.countDistinct("o").alias("origins"))


def top_corridors(od: DataFrame, n: int = 15) -> DataFrame:
    """The n greatest flows between different zones, ties by codes, with rank."""
    top = od.where("not same").orderBy(F.desc("flow"), "o", "d").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("flow"), "o", "d")).alias("rank"), "o", "d", "flow")


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (duplicates): how many keys occur more than once."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicates"))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails at run time if a right key repeats; ``matched`` tells hits."""
    n = F.count(F.lit(1))
    values = [c for c in right.columns if c not in keys]
    checked = right.groupBy(*keys).agg(n.alias("_n"), *[F.first(c).alias(c) for c in values])
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit("the right side repeats a key"))).otherwise(F.lit(True))
    return left.join(checked.withColumn("matched", guard).drop("_n"), keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def both_directions(od: DataFrame, times: DataFrame) -> DataFrame:
    """Each relation with the indicators of its own and of the opposite direction."""
    there = times.select("o", "d", F.col("minutes").alias("minutes_there"), F.col("km").alias("km_there"))
    back = times.select(F.col("d").alias("o"), F.col("o").alias("d"), F.col("minutes").alias("minutes_back"))
    return join_one_to_one(join_one_to_one(od, there, ["o", "d"]).drop("matched"), back, ["o", "d"])


def symmetric_flows(od: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Dense grid of ordered pairs of different zones with alpha (P_od + P_do), missing as zero.

    The grid is the result's own size; ``all_pairs`` makes it without a list of zones in one task.
    """
    zones = od.select(F.explode(F.array("o", "d")).alias("z")).distinct()
    grid = all_pairs(zones, "z").select(F.col("source").alias("o"), F.col("target").alias("d"))
    p = od.groupBy("o", "d").agg(F.sum("flow").alias("p"))
    back = p.select(F.col("d").alias("o"), F.col("o").alias("d"), F.col("p").alias("p_back"))
    both = grid.join(p, ["o", "d"], "left").join(back, ["o", "d"], "left").na.fill(0, ["p", "p_back"])
    return both.withColumn("c", alpha * F.col("p") + alpha * F.col("p_back"))


def territorial_shares(zones: DataFrame) -> DataFrame:
    """P from cars, A as the even blend of tourism and retail shares; each sums to one."""
    whole = F.broadcast(zones.agg(*[F.sum(c).alias(f"_{c}") for c in ("cars", "tourism", "retail")]))  # one row
    a = 0.5 * F.col("tourism") / F.col("_tourism") + 0.5 * F.col("retail") / F.col("_retail")
    return zones.join(whole).withColumns({"p_share": F.col("cars") / F.col("_cars"), "a_share": a}).drop("_cars", "_tourism", "_retail")


def completeness(matrix: DataFrame, by: list[str], o: str, d: str) -> DataFrame:
    """Rows, origins, destinations and whether every pair is there, per group."""
    g = matrix.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(o).alias("origins"), F.countDistinct(d).alias("destinations"), F.countDistinct(o, d).alias("pairs"))
    return g.withColumn("complete", F.col("pairs") == F.col("origins") * F.col("destinations"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, negatives, zeros and non-finite values of several columns in one pass."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    aggs = []
    for c in columns:
        x = F.col(c)
        aggs += [n(x.isNull()).alias(f"{c}_null"), n(x < 0).alias(f"{c}_negative"), n(x == 0).alias(f"{c}_zero"), n(F.isnan(x) | (F.abs(x) == float("inf"))).alias(f"{c}_odd")]
    return df.agg(*aggs)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one row each."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def asymmetry(matrix: DataFrame, value: str, o: str, d: str) -> DataFrame:
    """Unordered pairs with both directions: the absolute difference and the ratio max / min."""
    m = matrix.groupBy(o, d).agg(F.min(value).alias("v"))
    back = m.select(F.col(d).alias(o), F.col(o).alias(d), F.col("v").alias("w"))
    both = m.where(F.col(o) < F.col(d)).join(back, [o, d])
    return both.withColumns({"diff": F.abs(F.col("v") - F.col("w")), "ratio": F.when(F.least("v", "w") > 0, F.greatest("v", "w") / F.least("v", "w"))})


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Exact median, 95th percentile (interpolated), greatest, mean and share of zeros."""
    x = F.col(column)
    return df.agg(
        F.count(x).alias("n"), F.round(F.percentile(x, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(x, F.lit(0.95)), 6).alias("p95"), F.round(F.max(x), 6).alias("greatest"),
        F.round(F.avg(x), 6).alias("mean"), F.round(F.avg((x == 0).cast("int")) * 100, 6).alias("zero_pct"),
    )


def extreme_rows(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """For each column the row with its greatest value, ties by keys; one pass."""
    rows = [F.max_by(F.struct(*keys, F.col(c).cast("double").alias("value")), F.struct(F.col(c), *[(-F.col(k)) for k in keys])).alias(c) for c in columns]
    wide = df.agg(*rows)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("r")) for c in columns])).alias("x")).select("x.indicator", "x.r.*")


def compare_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys are in both, only left and only right."""
    l, r = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return l.join(r, keys, "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def weighted_centroid(points: DataFrame, by: str, weight: Column, x: str, y: str) -> DataFrame:
    """Weighted mean point per group."""
    return points.groupBy(by).agg(F.round(F.sum(weight * F.col(x)) / F.sum(weight), 6).alias("cx"), F.round(F.sum(weight * F.col(y)) / F.sum(weight), 6).alias("cy"))
