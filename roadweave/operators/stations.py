"""Traffic-count stations: match to segments, carriageways of a section, last known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.codes import ref_matches
from roadweave.functions.geo import point_segment_distance


def match_segments(stations: DataFrame, segments: DataFrame, reach: float = 500.0, ref_reach: float = 300.0) -> DataFrame:
    """Per station the segment it counts: the nearest with its road's reference within ``ref_reach``, else the nearest.

    ``stations``: section_id, road, x, y; ``segments``: segment_uid, ref, x_u, y_u, x_v, y_v in
    the same plane.  Candidates come from an equality join of cells as wide as ``reach``; a
    segment lies in every cell that its box, widened by the reach, touches.
    """
    cell = lambda c: F.floor(c / reach)
    s = stations.where("x is not null and y is not null").withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    span = lambda a: F.sequence(cell(F.least(f"{a}_u", f"{a}_v") - reach), cell(F.greatest(f"{a}_u", f"{a}_v") + reach))
    g = segments.where("x_u is not null and x_v is not null").withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    d = point_segment_distance(F.col("x"), F.col("y"), F.col("x_u"), F.col("y_u"), F.col("x_v"), F.col("y_v"))
    near = s.join(g, ["cx", "cy"]).withColumn("dist", d).where(F.col("dist") <= reach).withColumn("same_ref", ref_matches(F.col("road"), F.col("ref")))
    rank = F.struct((~(F.col("same_ref") & (F.col("dist") <= ref_reach))).alias("other"), "dist", "segment_uid")
    best = near.groupBy("section_id").agg(F.min_by(F.struct("segment_uid", "dist", "same_ref"), rank).alias("b"), F.count(F.lit(1)).alias("candidates"), F.sum((F.col("dist") <= 100).cast("int")).alias("within_100"))
    status = F.when(F.col("b.same_ref") & (F.col("b.dist") <= ref_reach), "REF_CONFIRMED").otherwise("NEAREST_ONLY_REF_NOT_CONFIRMED")
    return best.select("section_id", "b.segment_uid", F.round("b.dist", 4).alias("distance"), status.alias("status"), "candidates", "within_100")


def measurement_operator(edges: DataFrame) -> DataFrame:
    """BIDIRECTIONAL_SUM per segment whose two edges have swapped ends, else UNRESOLVED."""
    g = edges.groupBy("segment_uid").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("edge_id", "u", "v"))).alias("e"))
    swapped = (F.col("e")[0]["u"] == F.col("e")[1]["v"]) & (F.col("e")[0]["v"] == F.col("e")[1]["u"])
    ok = F.when(F.col("n") == 2, swapped).otherwise(F.lit(False))
    return g.select("segment_uid", "n", F.when(F.coalesce(ok, F.lit(False)), "BIDIRECTIONAL_SUM").otherwise("UNRESOLVED").alias("operator"))


def edges_of_segments(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges per wanted segment, and whether there is exactly one per direction."""
    e = edges.groupBy("segment_uid").agg(F.countDistinct("way_direction").alias("directions"), F.count(F.lit(1)).alias("edges"))
    return segments.join(e, "segment_uid", "left").na.fill(0, ["directions", "edges"]).withColumn("one_each", F.col("directions") == F.col("edges"))


def carried_forward(df: DataFrame, by: str, order: list[str], value: str, into: str) -> DataFrame:
    """The last known value up to each row, and where it came from."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(value, ignorenulls=True).over(w)
    return df.withColumns({into: known, "origin": F.when(F.col(value).isNotNull(), "observed").when(known.isNotNull(), "carried").otherwise("unusable")})


def corridor_windows(sites: DataFrame, corridor: str, place: str, longest: float) -> DataFrame:
    """Gaps between consecutive sites of a corridor, and whether each is within the norm."""
    w = Window.partitionBy(corridor).orderBy(place)
    t = sites.withColumn("gap", F.col(place) - F.lag(place).over(w))
    return t.where("gap is not null").groupBy(corridor).agg(F.count(F.lit(1)).alias("gaps"), F.round(F.max("gap"), 6).alias("widest"), F.sum((F.col("gap") > longest).cast("int")).alias("too_wide"))


def linspace_rows(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """``n`` rows evenly spread over the sorted table (a sampling operator)."""
    total = df.agg((F.count(F.lit(1)) - 1).alias("_last"))
    places = total.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.round(k * F.col("_last") / max(1, n - 1)).cast("bigint")))).alias("_place"))
    from roadweave.runtime import Scratch, grouped_rank

    ranked = grouped_rank(df.withColumn("_all", F.lit(0)), ["_all"], order, "_rank", Scratch(df.sparkSession, "linspace"), few_groups=True)
    return ranked.join(F.broadcast(places), F.col("_rank") == F.col("_place")).drop("_all", "_place")
