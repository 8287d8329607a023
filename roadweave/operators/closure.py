"""Connectivity of a graph held in DataFrames: components, reachability, giant sets.

Components use alternating large-star and small-star steps: in each, every node links its
neighbourhood to the smallest node in it, which shrinks any graph to stars in a number of
rounds that grows with the logarithm of its size.  Every round is a fixed number of
shuffles over the links, cut by a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators import routing
from roadweave.runtime import Scratch, ship

#: Nodes of the part of a graph, with their arcs, that one task floods.
KERNEL_ARCS = routing.PART_NODES
#: The same where only the nodes are asked for, not the hops: an arc then takes some thirty bytes.
FLOOD_NODES = 1_000_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v).

    Large star: each node sees all neighbours and links the greater ones to the least of the
    neighbourhood and itself.  Small star: each node sees its lesser neighbours only and
    links them and itself to the least.
    """
    if large:
        seen = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = seen.join(least, "u")
    moved = joined.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def weak_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node_id, component): the least node linked with each node; a loop or lone end is its own."""
    scratch = Scratch(edges.sparkSession, "stars")
    links, last = scratch.cut_with(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct()), None
    links, state = links
    for _ in range(max_rounds):
        nxt, now = scratch.cut_with(_star(_star(links, True), False), digest=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        scratch.drop(links)
        links = nxt
        if last is not None and now["digest"] == last["digest"] and now["rows"] == last["rows"]:
            break
        last = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node_id")).where("node_id is not null").distinct()
    return nodes.join(links.select(F.col("u").alias("node_id"), F.col("v").alias("m")), "node_id", "left").select("node_id", F.coalesce("m", "node_id").alias("component"))


def reachable(edges: DataFrame, start: DataFrame, forward: bool = True, part_nodes: int = KERNEL_ARCS) -> DataFrame:
    """(node_id, hops) of all nodes reached from the start nodes.

    The graph is flooded part by part: rounds follow the parts that a way crosses, not its
    hops, and a graph of any size or depth ends.  ``part_nodes`` below 1 counts as 1.
    """
    a, b = ("u", "v") if forward else ("v", "u")
    arcs = edges.where("u is not null and v is not null and u <> v").select(F.col(a).alias("s"), F.col(b).alias("d")).distinct().withColumns({"w": F.lit(1.0), "edge_id": F.lit(0).cast("bigint")})
    return routing.spread(arcs, start, part_nodes=max(1, part_nodes)).select(F.col("node").alias("node_id"), F.col("cost").cast("int").alias("hops"))


def mutual_set(edges: DataFrame, anchor: DataFrame) -> DataFrame:
    """Nodes that the anchor reaches and that reach it, with hops each way."""
    f = reachable(edges, anchor).withColumnRenamed("hops", "hops_from")
    return f.join(reachable(edges, anchor, forward=False).withColumnRenamed("hops", "hops_to"), "node_id")


_FLOOD = "part int, node bigint, reached binary"


def _flood_part(todo: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """One part: take in nodes sent here, spread, keep all that is reached and send on what leaves."""
    if not len(todo):
        return pd.DataFrame({"part": [], "node": [], "reached": []})
    here = int(todo["part"].iloc[0])
    old = np.concatenate([np.empty(0, "i8"), *[np.frombuffer(x, "i8") for x in todo["reached"] if x is not None]])
    sent = todo["node"][todo["reached"].isna()].to_numpy("i8")
    s, d, inside = arcs["s"].to_numpy("i8"), arcs["d"].to_numpy("i8"), arcs["dpart"].to_numpy() == here
    nodes = np.unique(np.concatenate([old, sent, s, d[inside]]))
    seen = np.zeros(len(nodes), bool)
    seen[np.searchsorted(nodes, old)] = True
    before = seen.copy()
    begin, end = np.searchsorted(nodes, s[inside]), np.searchsorted(nodes, d[inside])
    end = end[np.argsort(begin, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(begin, minlength=len(nodes)))])
    front = np.unique(np.searchsorted(nodes, sent))
    front = front[~seen[front]]
    while front.size:
        seen[front] = True
        n = at[front + 1] - at[front]
        k = np.repeat(at[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
        front = np.unique(end[k])
        front = front[~seen[front]]
    fresh = seen & ~before
    leaves = ~inside & fresh[np.searchsorted(nodes, s)]
    out = pd.DataFrame({"part": arcs["dpart"][leaves], "node": d[leaves]}).drop_duplicates()
    return pd.DataFrame({"part": [here, *out["part"].tolist()], "node": [-1, *out["node"].tolist()], "reached": [nodes[seen].tobytes(), *[None] * len(out)]})


def _flooded(arcs: DataFrame, begin: DataFrame, scratch: Scratch) -> DataFrame:
    """(node_id) of all that ``begin`` (part, node) reaches over ``arcs`` (s, d, part, dpart)."""
    todo, n = scratch.cut_with(begin.select("part", "node", F.lit(None).cast("binary").alias("reached")))
    known = None
    while n["rows"]:
        keys = todo.select("part").distinct()
        work = todo if known is None else todo.unionByName(known.join(keys, "part", "left_semi"))
        mine = arcs.join(keys, "part", "left_semi")
        out, n = scratch.cut_with(work.groupBy("part").cogroup(mine.groupBy("part")).applyInPandas(_flood_part, _FLOOD), rows=F.sum(F.col("reached").isNull().cast("int")))
        kept = out.where("reached is not null")
        known = kept if known is None else scratch.cut(kept.unionByName(known.join(keys, "part", "left_anti")))
        todo = out.where("reached is null").distinct()

    def rows(batches):
        for pdf in batches:
            for x in pdf["reached"]:
                yield pd.DataFrame({"node_id": np.frombuffer(x, "i8")})

    return begin.select(F.col("node").alias("node_id")).limit(0) if known is None else known.select("reached").mapInPandas(rows, "node_id bigint")


def mutual_nodes(edges: DataFrame, anchor: DataFrame, order: DataFrame | None = None, part_nodes: int = FLOOD_NODES) -> DataFrame:
    """(node_id) of the nodes that the anchor reaches and that reach it, itself among them.

    As ``mutual_set`` without the hops, so a node is settled when it is first met.  ``order`` as
    in ``routing.route``.
    """
    ship(edges.sparkSession)
    scratch = Scratch(edges.sparkSession, "mutual")
    whole = lambda c: F.col(c).cast("bigint")
    links = scratch.cut(edges.where("u is not null and v is not null and u <> v").select(whole("u").alias("u"), whole("v").alias("v")).distinct())
    first = scratch.cut(anchor.select(whole(anchor.columns[0]).alias("node")).where("node is not null").distinct())
    part = routing._parts(links.select(F.explode(F.array("u", "v")).alias("node")).unionAll(first).distinct(), order, max(1, part_nodes), scratch)
    at = lambda c, p: part.select(F.col("node").alias(c), F.col("part").alias(p))
    placed = scratch.cut(links.join(at("u", "upart"), "u").join(at("v", "vpart"), "v"))
    begin = scratch.cut(first.join(part, "node"))
    ahead = placed.select(F.col("u").alias("s"), F.col("v").alias("d"), F.col("upart").alias("part"), F.col("vpart").alias("dpart"))
    back = placed.select(F.col("v").alias("s"), F.col("u").alias("d"), F.col("vpart").alias("part"), F.col("upart").alias("dpart"))
    return _flooded(ahead, begin, scratch).join(_flooded(back, begin, scratch), "node_id")


def component_sizes(labels: DataFrame, component: str = "component") -> DataFrame:
    """Size per component and whether it is the giant one (greatest, ties by label)."""
    g = labels.groupBy(component).agg(F.count(F.lit(1)).alias("size"))
    top = g.agg(F.max_by(component, F.struct("size", -F.col(component))).alias("giant"))
    return g.join(F.broadcast(top)).select(component, "size", (F.col(component) == F.col("giant")).alias("is_giant"))


def cluster_points(points: DataFrame, item: str, x: str, y: str, within: float) -> DataFrame:
    """Points chained by distances of at most ``within``: cluster id (least member) and mean place.

    Candidates come from an equality join of grid cells as wide as the distance.
    """
    p = points.select(F.col(item).cast("bigint").alias("i"), F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    cell = lambda c: F.floor(F.col(c) / within)
    around = p.withColumn("cx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
    other = p.select(F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("cx"), cell("y").alias("cy"))
    links = around.join(other, ["cx", "cy"]).where((F.col("i") < F.col("j")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= within)).select(F.col("i").alias("u"), F.col("j").alias("v"))
    labels = weak_components(links.unionAll(p.select("i", F.col("i"))))
    return p.join(labels.withColumnRenamed("node_id", "i"), "i").groupBy(F.col("component").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))
