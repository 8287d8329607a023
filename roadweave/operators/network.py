"""Road network tables: segments, directed edges, degrees, structural nodes, runs of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions import codes


def segments(way_nodes: DataFrame, nodes: DataFrame, least_m: float = 0.01) -> DataFrame:
    """Consecutive node pairs of every way with their length in the plane.

    ``way_nodes``: way_id, seq, node_id; ``nodes``: node_id, x, y, one row each.  The uid is
    'way:seq' of the start.  Pairs without coordinates or not longer than ``least_m`` are
    rejected: flag ``kept``.
    """
    w = Window.partitionBy("way_id").orderBy("seq")
    pairs = way_nodes.withColumn("v", F.lead("node_id").over(w)).where("v is not null and node_id is not null").withColumnRenamed("node_id", "u")
    at = lambda p: nodes.select(F.col("node_id").alias(p), F.col("x").alias(f"x_{p}"), F.col("y").alias(f"y_{p}"))
    s = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left")
    length = F.hypot(F.col("x_v") - F.col("x_u"), F.col("y_v") - F.col("y_u"))
    return s.select(F.format_string("%d:%d", "way_id", "seq").alias("segment_uid"), "way_id", "seq", "u", "v", length.alias("length_m"), F.coalesce(length > least_m, F.lit(False)).alias("kept"))


def directed_edges(segments: DataFrame) -> DataFrame:
    """0 to 2 directed edges per segment from the codes of its two directions.

    Needs segment_uid, u, v, length_m, forward_code, backward_code, speed_kmh.  Code 1 gives
    a core edge, 2 one for local access only, anything else none.
    """
    one = lambda way, a, b, code: F.struct(F.lit(way).alias("way_direction"), F.col(a).alias("u"), F.col(b).alias("v"), F.col(code).alias("routing_code"))
    e = segments.select("segment_uid", "length_m", "speed_kmh", F.explode(F.array(one("FORWARD", "u", "v", "forward_code"), one("BACKWARD", "v", "u", "backward_code"))).alias("e")).select("segment_uid", "length_m", "speed_kmh", "e.*")
    e = e.where("routing_code in (1, 2)")
    return e.select(
        F.concat_ws(":", "segment_uid", F.substring("way_direction", 1, 1)).alias("edge_uid"), "segment_uid", "u", "v", "way_direction", "length_m", "speed_kmh",
        codes.base_time_s(F.col("length_m"), F.col("speed_kmh")).alias("time_s"), "routing_code", (F.col("routing_code") == 1).cast("int").alias("core_eligible"),
    )


def codes_of_direction(direction_code: str = "direction_code") -> tuple:
    """Forward and backward routing codes of a direction code '0', '1' or '-1'; unknown opens none."""
    c = F.col(direction_code)
    return F.when(c.isin("0", "1"), 1).otherwise(0), F.when(c.isin("0", "-1"), 1).otherwise(0)


def numbered(df: DataFrame, order: list[str], name: str, scratch) -> DataFrame:
    """A dense number from 0 in a global order, without gathering the rows in one task."""
    from roadweave.runtime import grouped_rank

    return grouped_rank(df.withColumn("_all", F.lit(0)), ["_all"], order, name, scratch, few_groups=True).drop("_all")


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and undirected degree (distinct neighbours, loops aside) per node, in one aggregation."""
    ends = edges.where("u is not null and v is not null").select("u", "v").distinct()
    both = ends.select(F.col("u").alias("node_id"), F.col("v").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(ends.select("v", "u", F.lit(0), F.lit(1)))
    links = both.groupBy("node_id", "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return links.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum((F.col("node_id") != F.col("other")).cast("int")).alias("undirected_degree"))


def dead_ends(degree: DataFrame) -> DataFrame:
    """Counts of nodes by kind: source only, sink only, dangling, other."""
    kind = F.when(F.col("in_degree") == 0, "source_only").when(F.col("out_degree") == 0, "sink_only").when(F.col("undirected_degree") == 1, "dangling").otherwise("other")
    return degree.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Ordered node pairs that more than one edge links, with the number and the shortest."""
    e = edges.where("u is not null and v is not null").groupBy("u", "v").agg(F.countDistinct("edge_id").alias("edges"), F.min("length_m").alias("shortest_m"))
    return e.where("edges > 1")


def structural_nodes(edges: DataFrame, way: str = "way_id") -> DataFrame:
    """Nodes with an undirected degree other than 2 or with two or more ways."""
    ways = edges.select(F.col("u").alias("node_id"), way).union(edges.select("v", way)).where("node_id is not null").groupBy("node_id").agg(F.countDistinct(way).alias("ways"))
    return degrees(edges).join(ways, "node_id").where("undirected_degree <> 2 or ways >= 2").select("node_id", "undirected_degree", "ways")


def topo_segments(segments: DataFrame, structural: DataFrame) -> DataFrame:
    """Runs of segments of a way between structural nodes: one row per run.

    A run breaks where seq jumps, where a segment doesn't start at the end of the one
    before, and after a segment that ends at a structural node.
    """
    s = segments.join(structural.select(F.col("node_id").alias("v"), F.lit(1).alias("cut")), "v", "left")
    w = Window.partitionBy("way_id").orderBy("seq")
    breaks = F.coalesce((F.col("seq") != F.lag("seq").over(w) + 1) | (F.col("u") != F.lag("v").over(w)) | F.lag("cut").over(w).isNotNull(), F.lit(True))
    runs = s.withColumn("b", breaks.cast("int")).withColumn("run", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy("way_id", "run").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("u", "seq").alias("start_node"), F.max_by("v", "seq").alias("end_node"), F.count(F.lit(1)).alias("n"), F.round(F.sum("length_m"), 6).alias("length_m")
    )
    return g.withColumn("topo_id", F.format_string("%d:%d-%d", "way_id", "first_seq", "last_seq")).drop("run")


def incident_topo(topo: DataFrame) -> DataFrame:
    """Per node the sorted set of runs that start or end there."""
    ends = topo.select(F.col("start_node").alias("node_id"), "topo_id").union(topo.select("end_node", "topo_id"))
    return ends.groupBy("node_id").agg(F.array_sort(F.collect_set("topo_id")).alias("topo_ids"))


def neighbourhood(segments: DataFrame, wanted: DataFrame, reach: int = 2) -> DataFrame:
    """Segments of the same way within ``reach`` places, or that share a node with, a wanted one."""
    seeds = wanted.select("segment_uid").distinct().join(segments, "segment_uid").select("way_id", "seq", "u", "v")
    places = seeds.select("way_id", F.explode(F.sequence(F.col("seq") - reach, F.col("seq") + reach)).alias("seq")).distinct()
    near = segments.join(places, ["way_id", "seq"], "left_semi").select("segment_uid")
    ends = seeds.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    touch = segments.select("segment_uid", F.explode(F.array("u", "v")).alias("n")).join(ends, "n", "left_semi").select("segment_uid")
    return near.union(touch).distinct().join(wanted.select("segment_uid"), "segment_uid", "left_anti")


def contracted_chains(segments: DataFrame, segment: str = "segment_uid") -> DataFrame:
    """(chain, segments, length_m): segments joined across nodes where exactly two ends meet, whatever their ways.

    A chain is named after its least segment; a ring of such nodes is one chain.  Loops and
    segments without ends stand alone.
    """
    from roadweave.operators.closure import weak_components

    s = segments.where(F.col(segment).isNotNull())
    ids = s.select(F.col(segment).alias("s"), "u", "v", "length_m", F.xxhash64(segment).alias("h"))
    ends = ids.where("u <> v").select("s", "h", F.explode(F.array("u", "v")).alias("n")).where("n is not null")
    loops = ids.where("u = v").select(F.col("u").alias("n")).distinct()
    meet = ends.join(loops, "n", "left_anti").groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.min("h").alias("a"), F.max("h").alias("b")).where("k = 2 and a <> b")
    labels = weak_components(meet.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(ids.select("h", "h")))
    return ids.join(labels.select(F.col("node_id").alias("h"), "component"), "h").groupBy("component").agg(F.min("s").alias("chain"), F.count(F.lit(1)).alias("segments"), F.sum("length_m").alias("length_m")).drop("component")
