"""Turn restrictions as edge sequences, and the prefix automaton that enforces them.

A sequence is an array of edge ids.  ``no`` rules forbid the last edge after all before it;
``only`` rules demand, after every proper prefix, its next edge.  States of the turn-aware
graph are the nodes themselves (base states) and the prefixes; after an edge the state is
the longest suffix of the travelled edges that is a known prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators import routing
from roadweave.runtime import Scratch, grouped_rank


def rule_kind(value: str = "restriction_value"):
    """NO_SEQUENCE for no_*, ONLY_SEQUENCE for only_*, else null."""
    return F.when(F.col(value).startswith("no_"), "NO_SEQUENCE").when(F.col(value).startswith("only_"), "ONLY_SEQUENCE")


def via_node_sequences(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """(relation_id, seq): each edge of the from way into the via node with each of the to way out of it.

    ``relations``: relation_id, from_way, via_node, to_way; ``edges``: edge_id, way_id, u, v.
    """
    into = edges.select(F.col("edge_id").alias("e1"), F.col("way_id").alias("from_way"), F.col("v").alias("via_node"))
    out = edges.select(F.col("edge_id").alias("e2"), F.col("way_id").alias("to_way"), F.col("u").alias("via_node"))
    hit = relations.join(into, ["from_way", "via_node"]).join(out, ["to_way", "via_node"])
    return hit.select("relation_id", F.array("e1", "e2").alias("seq")).distinct()


def via_way_sequences(relations: DataFrame, edges: DataFrame, max_variants: int = 20) -> DataFrame:
    """(relation_id, seq, ambiguous): chains over one via way, from way to to way.

    ``relations``: relation_id, from_way, via_way, to_way.  The via way is followed edge by
    edge in one direction from where the from way ends to where the to way starts, however
    long it is: no edge is used twice, so the walk ends.  Relations with more than
    ``max_variants`` chains are marked ``ambiguous``, not cut.  ``restrictions`` compiles
    chains over several via ways.
    """
    scratch = Scratch(edges.sparkSession, "chains")
    e = edges.select("edge_id", "way_id", "u", "v", "way_direction")
    first = e.select(F.col("edge_id").alias("e1"), F.col("way_id").alias("from_way"), F.col("v").alias("at"))
    chain = relations.join(first, "from_way").select("relation_id", "via_way", "to_way", "at", F.array("e1").alias("seq"), F.lit(None).cast("string").alias("dir"))
    step = scratch.cut(e.select(F.col("edge_id").alias("en"), F.col("way_id").alias("via_way"), F.col("u").alias("at"), F.col("v").alias("to"), "way_direction"))
    last = scratch.cut(e.select(F.col("edge_id").alias("e2"), F.col("way_id").alias("to_way"), F.col("u").alias("at")))
    done = []
    while True:
        more = chain.join(step, ["via_way", "at"]).where("(dir is null or dir = way_direction) and not array_contains(seq, en)")
        chain, n = scratch.cut_with(more.select("relation_id", "via_way", "to_way", F.col("to").alias("at"), F.array_append("seq", F.col("en")).alias("seq"), F.col("way_direction").alias("dir")))
        if not n["rows"]:
            break
        done.append(chain.join(last, ["to_way", "at"]).select("relation_id", F.array_append("seq", F.col("e2")).alias("seq")))
    found = scratch.cut(reduce(DataFrame.unionAll, done).distinct()) if done else chain.select("relation_id", "seq")
    n = found.groupBy("relation_id").agg((F.count(F.lit(1)) > max_variants).alias("ambiguous"))
    return found.join(n, "relation_id")


def prefixes(sequences: DataFrame) -> DataFrame:
    """Distinct proper prefixes of the sequences: prefix, prefix_len, last_edge."""
    p = sequences.where(F.size("seq") >= 2).select(F.explode(F.sequence(F.lit(1), F.size("seq") - 1)).alias("prefix_len"), "seq")
    return p.select(F.slice("seq", 1, F.col("prefix_len")).alias("prefix"), "prefix_len").distinct().withColumn("last_edge", F.element_at("prefix", -1))


def no_rules(sequences: DataFrame) -> DataFrame:
    """(prefix, forbidden_edge_id) of the NO_SEQUENCE rules."""
    return sequences.where("rule_kind = 'NO_SEQUENCE' and size(seq) >= 2").select(F.slice("seq", F.lit(1), F.size("seq") - 1).alias("prefix"), F.element_at("seq", -1).alias("forbidden_edge_id")).distinct()


def only_rules(sequences: DataFrame) -> DataFrame:
    """(prefix, relation_id, allowed_edge_id) at every proper prefix of the ONLY_SEQUENCE rules."""
    s = sequences.where("rule_kind = 'ONLY_SEQUENCE' and size(seq) >= 2").select("relation_id", "seq", F.explode(F.sequence(F.lit(1), F.size("seq") - 1)).alias("k"))
    return s.select(F.slice("seq", 1, F.col("k")).alias("prefix"), "relation_id", F.expr("seq[k]").alias("allowed_edge_id")).distinct()


def suffixes(array_col: str):
    """All non-empty suffixes of an array, longest first."""
    n = F.size(array_col)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(array_col, i, n - i + 1))


def state_transitions(sequences: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_state, edge_id, to_state): the turn-aware graph; a state is the array of its edges.

    Base states are written as empty arrays with ``node``; ``edges``: edge_id, u, v of the core
    edges.  An edge is blocked from a prefix state if some suffix of the state forbids it, or
    some mandatory relation on a suffix allows others but not it.
    """
    pre = prefixes(sequences).select("prefix", "last_edge")
    e = edges.select("edge_id", "u", "v")
    empty = F.array().cast("array<bigint>")
    # From the base state of every node: into the one-edge prefix of the edge if that is known.
    one = pre.where(F.size("prefix") == 1).select(F.col("last_edge").alias("edge_id"), F.col("prefix").alias("known"))
    base = e.join(one, "edge_id", "left").select(F.col("u").alias("from_node"), empty.alias("from_prefix"), "edge_id", F.col("v").alias("to_node"), F.coalesce("known", empty).alias("to_prefix"))
    # From prefix states: candidates leave the node where the last edge ends.
    at = pre.join(e.select(F.col("edge_id").alias("last_edge"), F.col("v").alias("node")), "last_edge").select("prefix", "node")
    cand = at.join(e.select("edge_id", F.col("u").alias("node"), F.col("v").alias("to_node")), "node").select("prefix", F.col("node").alias("from_node"), "edge_id", "to_node")
    suffix = at.select("prefix", F.explode(suffixes("prefix")).alias("suffix"))
    banned = suffix.join(no_rules(sequences).withColumnRenamed("prefix", "suffix"), "suffix").select("prefix", F.col("forbidden_edge_id").alias("edge_id")).distinct()
    rules = suffix.join(only_rules(sequences).withColumnRenamed("prefix", "suffix"), "suffix").groupBy("prefix", "suffix", "relation_id").agg(F.collect_set("allowed_edge_id").alias("allowed"))
    free = cand.join(banned, ["prefix", "edge_id"], "left_anti")
    wrong = free.join(rules.select("prefix", "allowed"), "prefix").where("not array_contains(allowed, edge_id)").select("prefix", "edge_id").distinct()
    free = free.join(wrong, ["prefix", "edge_id"], "left_anti").withColumn("path", F.array_append("prefix", F.col("edge_id")))
    known = pre.select(F.col("prefix").alias("suffix"))
    longest = free.select("prefix", "edge_id", F.explode(suffixes("path")).alias("suffix")).join(known, "suffix").groupBy("prefix", "edge_id").agg(F.max_by("suffix", F.size("suffix")).alias("next"))
    more = free.join(longest, ["prefix", "edge_id"], "left").select("from_node", F.col("prefix").alias("from_prefix"), "edge_id", "to_node", F.coalesce("next", empty).alias("to_prefix"))
    return base.unionAll(more)


def state_graph(sequences: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, transitions) of the turn-aware graph, with dense state ids.

    states: state_id, node_id, prefix (empty for the base state of a node).  Base states come
    first, by node, then prefixes in their order.  ``edges``: core edges edge_id, u, v and
    time_s, length_m.  transitions: src, dst, edge_id, time_s, length_m.
    """
    scratch = Scratch(edges.sparkSession, "states")
    moves = scratch.cut(state_transitions(sequences, edges))
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id")).where("node_id is not null").distinct()
    last = edges.select(F.col("edge_id").alias("last_edge"), F.col("v").alias("node_id"))
    held = prefixes(sequences).join(last, "last_edge").select("node_id", "prefix")
    named = ends.select("node_id", F.array().cast("array<bigint>").alias("prefix")).unionByName(held).distinct()
    named = named.withColumns({"_kind": (F.size("prefix") > 0).cast("int"), "_all": F.lit(0), "_first": F.when(F.size("prefix") == 0, F.col("node_id"))})
    ranked = grouped_rank(named, ["_all"], ["_kind", "_first", "prefix", "node_id"], "state_id", scratch, few_groups=True)
    states = scratch.cut(ranked.select("state_id", "node_id", "prefix"))
    at = lambda n, p, out: states.select(F.col("node_id").alias(n), F.col("prefix").alias(p), F.col("state_id").alias(out))
    t = moves.join(at("from_node", "from_prefix", "src"), ["from_node", "from_prefix"]).join(at("to_node", "to_prefix", "dst"), ["to_node", "to_prefix"])
    return states, scratch.cut(t.select("src", "dst", "edge_id").join(edges.select("edge_id", "time_s", "length_m"), "edge_id"))


def repeated_transitions(transitions: DataFrame) -> DataFrame:
    """(src, dst, n) of transitions that aren't unique; the graph is sound if there is none."""
    return transitions.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def turn_paths(states: DataFrame, transitions: DataFrame, pairs: DataFrame, order: DataFrame | None = None, part_nodes: int = routing.PART_NODES) -> DataFrame:
    """(source, target, time_s, length_m, state_id, edges) of node pairs over the turn-aware graph.

    A path starts in the base state of its source and may end in any state of its target; of
    states that cost within 1e-12 of the least the one with the least id counts.  The length is
    summed along the path that is best in time.  Pairs without a way have nulls.
    """
    base = states.where("size(prefix) = 0").select(F.col("node_id").alias("source"), F.col("state_id").alias("s"))
    ends = states.select(F.col("node_id").alias("target"), F.col("state_id").alias("e"))
    wanted = pairs.select("source", "target").distinct()
    asked = wanted.join(base, "source").join(ends, "target")
    arcs = transitions.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("time_s").alias("w"), "edge_id")
    near = None if order is None else states.join(order, "node_id").select(F.col("state_id").alias("node"), *[c for c in order.columns if c != "node_id"])
    found = routing.route(arcs, asked.select(F.col("s").alias("source"), F.col("e").alias("target")), near, part_nodes).where("cost is not null")
    back = found.select(F.col("source").alias("s"), F.col("target").alias("e"), "cost", "edges").join(base, "s").join(ends, "e")
    least = back.groupBy("source", "target").agg(F.min("cost").alias("least"))
    best = back.join(least, ["source", "target"]).where("cost <= least + 1e-12").groupBy("source", "target").agg(F.min_by(F.struct("cost", "e", "edges"), "e").alias("b"))
    legs = best.select("source", "target", F.posexplode("b.edges").alias("pos", "edge_id")).join(transitions.select("edge_id", "length_m").dropDuplicates(["edge_id"]), "edge_id")
    length = legs.groupBy("source", "target").agg(F.sum("length_m").alias("length_m"))
    out = wanted.join(best, ["source", "target"], "left").join(length, ["source", "target"], "left")
    return out.select("source", "target", F.col("b.cost").alias("time_s"), F.when(F.col("b").isNotNull(), F.coalesce("length_m", F.lit(0.0))).alias("length_m"), F.col("b.e").alias("state_id"), F.col("b.edges").alias("edges"))


def turn_totals(states: DataFrame, transitions: DataFrame, nodes: DataFrame, order: DataFrame | None = None, part_nodes: int = routing.PART_NODES) -> DataFrame:
    """(source, target, time_s, length_m, hops, first_edge, last_edge) of every two different ``nodes`` with a way between them.

    The rules of ``turn_paths``, without the paths: their sums and ends are carried by the
    routing itself, and pairs without a way are left out.
    """
    scratch = Scratch(states.sparkSession, "totals")
    wanted = nodes.select(F.col(nodes.columns[0]).alias("node_id")).where("node_id is not null").distinct()
    held = scratch.cut(states.join(wanted, "node_id").select("node_id", "state_id", (F.size("prefix") == 0).alias("starts")))
    arcs = transitions.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("time_s").alias("w"), "edge_id", F.col("length_m").alias("length"))
    near = None if order is None else states.join(order, "node_id").select(F.col("state_id").alias("node"), *[c for c in order.columns if c != "node_id"])
    found = routing.among(arcs, held.select(F.col("state_id").alias("node"), "starts"), near, part_nodes)
    at = lambda state, node: held.select(F.col("state_id").alias(state), F.col("node_id").alias(node))
    named = found.withColumnsRenamed({"source": "s", "target": "e"}).join(at("s", "source"), "s").join(at("e", "target"), "e").where("source <> target")
    each = named.groupBy("source", "target").agg(F.collect_list(F.struct("e", "cost", "length", "hops", "first", "last")).alias("l"), F.min("cost").alias("least"))
    best = each.select("source", "target", F.array_min(F.expr("filter(l, x -> x.cost <= least + 1e-12)")).alias("b"))
    return best.select("source", "target", F.col("b.cost").alias("time_s"), F.col("b.length").alias("length_m"), F.col("b.hops").alias("hops"), F.col("b.first").alias("first_edge"), F.col("b.last").alias("last_edge"))
