"""Path tables: weighted summaries, prefix costs, continuity, exposure of sections, link flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.routing import all_pairs


def access_pairs(accesses: DataFrame, zone: str) -> DataFrame:
    """All access pairs of different zones with the product of their weights.

    The access table has a fixed few rows per zone; it is joined to both ends of the grid of zones.
    """
    a = accesses.select(F.col(zone).alias("zone"), "node", "lambda")
    end = lambda z, n, w: a.select(F.col("zone").alias(z), F.col("node").alias(n), F.col("lambda").alias(w))
    grid = all_pairs(a, "zone").withColumnsRenamed({"source": "o", "target": "d"})
    pairs = grid.join(end("o", "source", "lo"), "o").join(end("d", "target", "ld"), "d")
    return pairs.select("o", "d", "source", "target", (F.col("lo") * F.col("ld")).alias("weight"))


def weighted_summary(paths: DataFrame) -> DataFrame:
    """Per (o, d): weighted, least and greatest cost, spread, best path by (cost, source, target)."""
    g = paths.groupBy("o", "d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("cost")).alias("weighted"), F.min("cost").alias("least"), F.max("cost").alias("greatest"),
        F.min(F.struct("cost", "source", "target")).alias("b"),
    )
    return g.select("o", "d", "n", F.round("weight", 6).alias("weight"), F.round("weighted", 6).alias("weighted"), F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"), F.round(F.col("greatest") - F.col("least"), 6).alias("spread"), F.col("b.source").alias("best_source"), F.col("b.target").alias("best_target"))


def prefix_cost(slots: DataFrame, keys: list[str], pos: str, cost: str) -> DataFrame:
    """Running cost along each path."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return slots.withColumn("so_far", F.sum(cost).over(w))


def continuity(slots: DataFrame, keys: list[str], pos: str, start: str, end: str) -> DataFrame:
    """One row: places where an element doesn't start where the one before ended, paths, elements."""
    w = Window.partitionBy(*keys).orderBy(pos)
    broken = F.lag(end).over(w).isNotNull() & (F.lag(end).over(w) != F.col(start))
    first = F.lag(F.lit(1)).over(w).isNull()
    return slots.select(broken.cast("int").alias("b"), first.cast("int").alias("f")).agg(F.sum("b").alias("breaks"), F.sum("f").alias("paths"), F.count(F.lit(1)).alias("elements"))


def section_hits(slots: DataFrame, section_edges: DataFrame, path: list[str], section: str) -> DataFrame:
    """Distinct (path, section) where the path uses any edge of the section."""
    return slots.join(section_edges.select(section, "edge_id").distinct(), "edge_id").select(*path, section).distinct()


def exposure(hits: DataFrame, weights: DataFrame, path: list[str], section: str) -> DataFrame:
    """(section, o, d, paths, p): summed weight of the paths that hit, at most one."""
    return hits.join(weights, path).groupBy(section, "o", "d").agg(F.count(F.lit(1)).alias("paths"), F.least(F.sum("weight"), F.lit(1.0)).alias("p"))


def link_flow(exposures: DataFrame, flows: DataFrame, section: str, flow: str) -> DataFrame:
    """Sum of p times flow per section."""
    return exposures.join(flows.select("o", "d", flow), ["o", "d"]).groupBy(section).agg(F.sum(F.col("p") * F.col(flow)).alias("flow"))


def exposure_label(sections: DataFrame, exposures: DataFrame, section: str) -> DataFrame:
    """How far each section is represented: NOT_REPRESENTED, PARTIAL (every p below 1) or FULL."""
    g = exposures.groupBy(section).agg(F.max("p").alias("top"), F.count(F.lit(1)).alias("pairs"))
    label = F.when(F.col("top").isNull(), "NOT_REPRESENTED").when(F.col("top") < 1 - 1e-9, "PARTIAL").otherwise("FULL")
    return sections.select(section).distinct().join(g, section, "left").select(section, F.coalesce("pairs", F.lit(0)).alias("pairs"), label.alias("label"))


def owner_of_position(positions: DataFrame, owners: DataFrame, pos: str, start: str, end: str, owner: str, width: int = 1024) -> DataFrame:
    """Interval join: the owner whose half-open range start..end holds a position.

    Ranges are cut into buckets of ``width`` so that the join is one of equality.
    """
    o = owners.where(F.col(end) > F.col(start)).select(owner, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("_b"))
    p = positions.withColumn("_b", F.floor(F.col(pos) / width))
    return p.join(o, "_b").where((F.col(pos) >= F.col("_s")) & (F.col(pos) < F.col("_e"))).drop("_b", "_s", "_e")


def edge_use(slots: DataFrame, weights: DataFrame, path: list[str]) -> DataFrame:
    """Per edge the number of distinct paths over it and their summed weight."""
    one = slots.select(*path, "edge_id").distinct()
    return one.join(weights, path).groupBy("edge_id").agg(F.count(F.lit(1)).alias("paths"), F.round(F.sum("weight"), 6).alias("weight"))


def path_sanity(paths: DataFrame, hit: str, reported: DataFrame | None = None) -> DataFrame:
    """(o, d, n, hits, hit_weight[, delta]): how many of a pair's paths hit, their weight, and how far that is from a reported exposure."""
    on = F.col(hit)
    g = paths.groupBy("o", "d").agg(F.count(F.lit(1)).alias("n"), F.sum(on.cast("int")).alias("hits"), F.coalesce(F.sum(F.when(on, F.col("weight"))), F.lit(0.0)).alias("hit_weight"))
    if reported is None:
        return g
    return g.join(reported.select("o", "d", "p"), ["o", "d"], "left").withColumn("delta", F.least("hit_weight", F.lit(1.0)) - F.coalesce("p", F.lit(0.0))).drop("p")
