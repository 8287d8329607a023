"""Access points of zones: ranked candidates, diverse triples, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_candidates(candidates: DataFrame, zone: str, node: str, distance: str, depth: int) -> DataFrame:
    """The ``depth`` nearest nodes per zone with a dense rank by (distance, node).

    Spark keeps only the first ``depth`` rows per group while it sorts (a window group
    limit), on either side of the shuffle.
    """
    w = Window.partitionBy(zone).orderBy(distance, node)
    ok = F.col(distance).isNotNull() & ~F.isnan(distance)
    return candidates.where(ok).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def pair_metrics(selected: DataFrame, zone: str, x: str = "x", y: str = "y") -> DataFrame:
    """Least separation of the points of each zone, and the number of pairs."""
    a = selected.select(F.col(zone).alias("z"), F.col("rank").alias("i"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = selected.select(F.col(zone).alias("z"), F.col("rank").alias("j"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    return a.join(b, "z").where("i < j").groupBy(F.col("z").alias(zone)).agg(F.round(F.min(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))), 6).alias("least_separation"), F.count(F.lit(1)).alias("pairs"))


def diverse_triples(ranked: DataFrame, zone: str, node: str, distance: str, separation: float = 100.0, topo: str | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Per zone the first candidate with two others at the smallest feasible depth.

    Feasible: all three at least ``separation`` (less 1e-9) apart and, with ``topo`` (an
    array column), no shared element.  The smallest depth is the least greatest rank of a
    feasible triple; within it the least (greatest distance, sum of distances, negative
    separation, nodes).  Zones without a feasible triple don't appear.  ``ranked`` holds a
    bounded number of candidates per zone, so pairs are bounded too.
    """
    cols = [F.col(zone).alias("z"), F.col("rank").alias("r"), F.col(node).alias("n"), F.col(distance).alias("d"), F.col(x).alias("x"), F.col(y).alias("y")]
    cols.append(F.col(topo).alias("t") if topo else F.array().cast("array<string>").alias("t"))
    p = ranked.select(*cols)
    named = lambda k: p.select("z", F.struct("r", "n", "d", "x", "y", "t").alias(k))
    gap = lambda a, b: F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y"))
    apart = lambda a, b: (gap(a, b) >= separation - 1e-9) & ~F.coalesce(F.arrays_overlap(f"{a}.t", f"{b}.t"), F.lit(False))
    two = named("a").where("a.r = 1").join(named("b"), "z").where("b.r > 1").where(apart("a", "b"))
    three = two.join(named("c"), "z").where("c.r > b.r").where(apart("a", "c") & apart("b", "c"))
    least = F.least(gap("a", "b"), gap("a", "c"), gap("b", "c"))
    order = F.struct(
        F.col("c.r").alias("depth"), F.greatest("b.d", "c.d").alias("far"), (F.col("b.d") + F.col("c.d")).alias("total"), (-least).alias("close"), F.least("b.n", "c.n").alias("n1"), F.greatest("b.n", "c.n").alias("n2")
    )
    best = three.groupBy("z").agg(F.min_by(F.struct("a", "b", "c", least.alias("sep")), order).alias("t"))
    return best.select(
        F.col("z").alias(zone), F.col("t.a.n").alias("node_1"), F.col("t.b.n").alias("node_2"), F.col("t.c.n").alias("node_3"), F.col("t.c.r").alias("depth"), F.round("t.sep", 6).alias("separation"),
        F.array("t.a.d", "t.b.d", "t.c.d").alias("distances"),
    )


def decay_weights(selected: DataFrame, zone: str, distance: str, scale: float | Column = 300.0, extra: list[str] | None = None) -> DataFrame:
    """exp(-(d - least d) / scale), normalised per zone; column lambda."""
    w = Window.partitionBy(zone, *(extra or []))
    raw = F.exp(-(F.col(distance) - F.min(distance).over(w)) / scale)
    return selected.withColumn("_raw", raw).withColumn("lambda", F.col("_raw") / F.sum("_raw").over(w)).drop("_raw")


def effective_number(weights: DataFrame, zone: str) -> DataFrame:
    """1 / sum of squared weights per zone, and how far the sum is from one."""
    return weights.groupBy(zone).agg(F.round(1 / F.sum(F.col("lambda") * F.col("lambda")), 6).alias("effective_n"), (F.abs(F.sum("lambda") - 1) <= 1e-9).alias("sums_to_one"))


def tau_sweep(selected: DataFrame, zone: str, distance: str, taus: list[float]) -> DataFrame:
    """Mean effective number and count of dominant first points for several decay scales."""
    t = selected.withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in taus])))
    w = decay_weights(t, zone, distance, F.col("tau"), ["tau"])
    per = w.groupBy(zone, "tau").agg((1 / F.sum(F.col("lambda") ** 2)).alias("eff"), F.max("lambda").alias("top"))
    return per.groupBy("tau").agg(F.round(F.avg("eff"), 6).alias("mean_effective_n"), F.sum((F.col("top") > 0.5).cast("int")).alias("dominant"))


def anchored_selection(ranked: DataFrame, zone: str, node: str, distance: str, k: int, separation: float, topo: str | None = None, depth: int | None = None, adaptive: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Per zone the first candidate and the best ``k`` - 1 others: nodes, depth, far, total, separation.

    All chosen are at least ``separation`` (less 1e-9) apart and, with ``topo``, share no
    element.  Best is the least (greatest distance, sum of distances, negative separation,
    nodes in order of rank); ``adaptive`` puts the greatest rank first.  ``depth`` bounds the
    candidates.  The choice grows by one point at a time over pairs that go together, so what
    can't be part of any choice is dropped early.  Zones without a choice don't appear; for
    k = 1 the separation is null.
    """
    cols = [F.col(zone).alias("z"), F.col("rank").alias("r"), F.col(node).alias("n"), F.col(distance).alias("d"), F.col(x).alias("x"), F.col(y).alias("y")]
    cols.append((F.col(topo) if topo else F.lit(None).cast("array<string>")).alias("t"))
    p = ranked.where(F.col("rank") <= depth).select(*cols) if depth else ranked.select(*cols)
    chosen = p.where("r = 1").select("z", F.array("n").alias("nodes"), F.col("r").alias("top"), F.col("d").alias("far"), F.col("d").alias("total"), F.lit(None).cast("double").alias("sep"))
    if k > 1:
        a, b = p.select([F.col(c).alias(f"{c}1") for c in p.columns]), p.select([F.col(c).alias(f"{c}2") for c in p.columns])
        gap = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
        apart = a.join(b, F.col("z1") == F.col("z2")).where("r1 < r2").withColumn("gap", gap).where((F.col("gap") >= separation - 1e-9) & ~F.coalesce(F.arrays_overlap("t1", "t2"), F.lit(False)))
        # For every candidate the later ones that go with it, and how far apart they are.
        mates = apart.groupBy("z1", "n1").agg(F.map_from_entries(F.collect_list(F.struct("n2", "gap"))).alias("mates")).select(F.col("z1").alias("z"), F.col("n1").alias("n"), "mates")
        with_mates = lambda c: mates.select("z", F.col("n").alias(c), F.col("mates").alias(f"m_{c}"))
        later = p.where("r > 1").select("z", F.col("r").alias("r2"), F.col("n").alias("n2"), F.col("d").alias("d2"))
        chosen = chosen.withColumns({"n": F.col("nodes")[0], "near": F.array().cast("array<map<bigint,double>>")})
        for _ in range(k - 1):
            grown = chosen.join(with_mates("n"), ["z", "n"]).withColumn("near", F.array_append("near", F.col("m_n"))).join(later, "z")
            grown = grown.where((F.col("r2") > F.col("top")) & F.forall("near", lambda m: F.map_contains_key(m, F.col("n2"))))
            least = F.array_min(F.transform("near", lambda m: F.element_at(m, F.col("n2"))))
            chosen = grown.select("z", F.array_append("nodes", F.col("n2")).alias("nodes"), F.col("r2").alias("top"), F.greatest("far", "d2").alias("far"), (F.col("total") + F.col("d2")).alias("total"), F.least("sep", least).alias("sep"), F.col("n2").alias("n"), "near")
    order = F.struct(*([F.col("top")] if adaptive else []), F.col("far"), F.col("total"), (-F.coalesce("sep", F.lit(0.0))).alias("close"), "nodes")
    best = chosen.groupBy("z").agg(F.min_by(F.struct("nodes", "top", "far", "total", "sep"), order).alias("b"))
    return best.select(F.col("z").alias(zone), "b.nodes", F.col("b.top").alias("depth"), "b.far", "b.total", F.col("b.sep").alias("separation"))


def shared_pairs(selected: DataFrame, zone: str, topo: str) -> DataFrame:
    """Pairs of each zone's points, and how many of them share an element of ``topo``."""
    p = selected.select(F.col(zone).alias("z"), "rank", F.col(topo).alias("t"))
    a, b = p.toDF("z", "i", "t1"), p.toDF("z", "j", "t2")
    both = a.join(b, "z").where("i < j")
    return both.groupBy(F.col("z").alias(zone)).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.coalesce(F.arrays_overlap("t1", "t2"), F.lit(False)).cast("int")).alias("shared"))
