"""Groups of records linked directly or indirectly, and of mutually reachable ones.

Undirected groups: deterministic Borůvka hooking.  Every component picks its smallest
neighbour, the resulting trees collapse by pointer doubling, edges are relabelled and
deduplicated, until none remain.  Because each pick is the smallest neighbour, the root of a
tree (the smaller end of its one two-cycle) is its smallest member, so labels end as the
smallest id of the group.  The number of components at least halves in a round, and the
per-round label maps are composed from the last, small one to the first.

Mutually reachable groups: links that run both ways are collapsed by the same hooking.  Of
the one-way links that remain, each round removes nodes without a way in or out, and hooks
nodes with a single way out (or in) to that neighbour, with a test kept for later: such a
node belongs to the neighbour's group exactly if the group also holds a node at its other
side.  When at most ``finish_arcs`` links are left, one task of that fixed size labels
them by depth-first search; then the tests are answered from the last round to the first.
If rounds stall, every node's smallest way out defines cycles, found by pointer doubling,
which are merged.  Where that doesn't help, as in an acyclic rest, nodes are coloured by the
least label upstream and, inside a colour, downstream, in a random order of labels: links
between colours are dropped, and the node with the least label of all always leaves with all
its links, so the result is exact at any size and the loop ends on every graph.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.runtime import Scratch, ship

#: Links up to which the one-way remainder is finished in one task.
FINISH_ARCS = 20_000


def _collapse(pairs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(x, label) for every node of the undirected ``pairs`` (a < b, distinct); label is the least id."""
    maps: list[DataFrame] = []
    edges, n = scratch.cut_with(pairs)
    owned = edges
    while n["rows"]:
        both = owned.select(F.col("a").alias("x"), F.col("b").alias("p")).unionAll(owned.select(F.col("b"), F.col("a")))
        label = _roots(_broken(both.groupBy("x").agg(F.min("p").alias("p"))), scratch)
        maps.append(label)
        to = lambda end: label.select(F.col("x").alias(end), F.col("label").alias(f"l{end}"))
        moved_edges = owned.join(to("a"), "a").join(to("b"), "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        nxt, n = scratch.cut_with(moved_edges)
        scratch.drop(owned)
        owned = nxt
    scratch.drop(owned)
    if not maps:
        return None
    done = maps.pop()
    while maps:
        earlier = maps.pop()
        later = done.select(F.col("x").alias("label"), F.col("label").alias("_to"))
        joined = scratch.cut(earlier.join(later, "label", "left").select("x", F.coalesce("_to", "label").alias("label")))
        scratch.drop(earlier, done)
        done = joined
    return done


def _broken(picks: DataFrame) -> DataFrame:
    """The picks with each two-cycle broken: its smaller end points at itself and is a root."""
    there = picks.select(F.col("x").alias("p"), F.col("p").alias("pp"))
    return picks.join(there, "p").select("x", F.when(F.col("pp") == F.col("x"), F.least("x", "p")).otherwise(F.col("p")).alias("p"))


def _roots(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, label): every node's root, by pointer jumps of the nodes that haven't met theirs.

    Each pass follows three pointers.  A node that meets a root is final and takes part in
    no later pass but as a pointer of others, so a root that nearly all nodes point at is
    no join key again.
    """
    label = scratch.cut(pointers.select("x", F.col("p").alias("label"), (F.col("x") != F.col("p")).alias("open")))
    moved = 1
    while moved:
        there = label.where("x <> label").select(F.col("x").alias("p"), F.col("label").alias("pp"))
        first = label.where("open").select("x", F.col("label").alias("p")).join(there, "p", "left")
        # A node whose parent is a root needs no second look: its key is spread, and no match counts.
        second = first.withColumn("k", F.coalesce("pp", -F.pmod(F.xxhash64("x"), F.lit(1 << 20))))
        far = there.select(F.col("p").alias("k"), F.col("pp").alias("ppp"))
        ppp = F.when(F.col("pp").isNotNull(), F.col("ppp"))
        jumped = second.join(far, "k", "left").select("x", F.coalesce(ppp, "pp", "p").alias("label"), ppp.isNotNull().alias("open"))
        nxt, seen = scratch.cut_with(label.where("not open").unionByName(jumped), moved=F.sum(F.col("open").cast("int")))
        scratch.drop(label)
        label, moved = nxt, seen["moved"]
    return label.select("x", "label")


def _tarjan(src: list[int], dst: list[int]) -> dict[int, int]:
    """Node to least member, for nodes in a strong component of two or more."""
    out: dict[int, list[int]] = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    stack, on, found = [], set(), {}
    for root in out:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        work = [(root, iter(out[root]))]
        while work:
            x, rest = work[-1]
            for y in rest:
                if y not in order:
                    order[y] = low[y] = len(order)
                    stack.append(y)
                    on.add(y)
                    work.append((y, iter(out.get(y, ()))))
                    break
                if y in on:
                    low[x] = min(low[x], order[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == order[x]:
                    members = [stack.pop()]
                    while members[-1] != x:
                        members.append(stack.pop())
                    on.difference_update(members)
                    if len(members) > 1:
                        found.update(dict.fromkeys(members, min(members)))
    return found


def _finish(arcs: DataFrame) -> DataFrame:
    """Strong components of a bounded number of arcs, in one task."""

    def solve(batches):
        src, dst = [], []
        for pdf in batches:
            src += pdf["s"].tolist()
            dst += pdf["d"].tolist()
        found = _tarjan(src, dst)
        yield pd.DataFrame({"x": pd.Series(list(found), dtype="int64"), "label": pd.Series(list(found.values()), dtype="int64")})

    ship(arcs.sparkSession)
    return arcs.coalesce(1).mapInPandas(solve, "x bigint, label bigint")


def _hooks(arcs: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """(x, to, kind) of the nodes that leave this round; kind ``drop`` has no target."""
    outs = arcs.groupBy(F.col("s").alias("x")).agg(F.count(F.lit(1)).alias("n_out"), F.min("d").alias("one_out"))
    ins = arcs.groupBy(F.col("d").alias("x")).agg(F.count(F.lit(1)).alias("n_in"), F.min("s").alias("one_in"))
    back = arcs.select(F.col("d").alias("s"), F.col("s").alias("d"))
    two_way = arcs.join(back, ["s", "d"], "left_semi").groupBy(F.col("s").alias("x")).agg(F.min("d").alias("mate"))
    node = outs.join(ins, "x", "full").join(two_way, "x", "left")
    kind = (
        F.when(F.col("n_in").isNull() | F.col("n_out").isNull(), "drop")
        .when(F.col("mate").isNotNull(), "merge")
        .when(F.col("n_out") == 1, "out")
        .when(F.col("n_in") == 1, "in")
    )
    to = F.when(kind == "merge", F.col("mate")).when(kind == "out", F.col("one_out")).when(kind == "in", F.col("one_in"))
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 1
    wish = scratch.cut(node.select("x", to.alias("to"), kind.alias("kind")).where("kind is not null"))
    target = wish.select(F.col("x").alias("to"), F.col("kind").alias("to_kind"))
    free = F.col("to_kind").isNull() | ((F.col("to_kind") != "drop") & coin(F.col("x")) & ~coin(F.col("to")))
    hooks = wish.join(target, "to", "left").where((F.col("kind") == "drop") | free).select("x", "to", "kind")
    out = scratch.cut(hooks)
    scratch.drop(wish)
    return out


def _cycles(arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, to, kind) that merges every cycle of the smallest ways out into its least node."""
    state = scratch.cut(arcs.groupBy(F.col("s").alias("x")).agg(F.min("d").alias("f")).withColumn("low", F.least("x", "f")))
    reach, n = 1, state.count()
    while reach < n:
        there = state.select(F.col("x").alias("f"), F.col("f").alias("ff"), F.col("low").alias("flow"))
        nxt = scratch.cut(state.join(there, "f").select("x", F.col("ff").alias("f"), F.least("low", "flow").alias("low")))
        scratch.drop(state)
        state, reach = nxt, reach * 2
    on_cycle = state.select(F.col("f").alias("x")).distinct()
    return scratch.cut(state.join(on_cycle, "x", "left_semi").where("x <> low").select("x", F.col("low").alias("to"), F.lit("merge").alias("kind")))


def _upstream(arcs: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """(x, f): the least label of the nodes that reach ``x``, itself included.

    Labels are nodes in an order drawn from ``turn``.  Besides one link, each step looks at an
    ancestor ``p`` whose distance doubles; every eighth step takes the best one anew.
    """
    nodes = arcs.select(F.col("s").alias("x")).unionAll(arcs.select("d")).distinct()
    state = scratch.cut(nodes.select("x", F.struct(F.xxhash64("x", F.lit(turn)).alias("h"), F.col("x")).alias("f"), F.col("x").alias("p")))
    step, moved = 0, 1
    while moved:
        nxt = state.withColumn("was", F.col("f"))
        for _ in range(2):
            best = arcs.join(nxt.select(F.col("x").alias("s"), F.col("f").alias("fs")), "s").groupBy(F.col("d").alias("x")).agg(F.min(F.struct("fs", "s")).alias("m"))
            there = nxt.select(F.col("x").alias("p"), F.col("f").alias("fp"), F.col("p").alias("pp"))
            p = F.coalesce("m.s", "x") if step % 8 == 0 else F.col("pp")
            nxt = nxt.join(there, "p").join(best, "x", "left").select("x", F.least("f", "m.fs", "fp").alias("f"), p.alias("p"), "was")
            step += 1
        nxt, seen = scratch.cut_with(nxt, moved=F.sum((F.col("f") != F.col("was")).cast("int")))
        scratch.drop(state)
        state, moved = nxt, seen["moved"]
    return state.select("x", "f")


def _coloured(arcs: DataFrame, turn: int, scratch: Scratch) -> tuple[DataFrame, dict, DataFrame]:
    """Links left by forward-backward colouring, their measures, and the tests of merged nodes.

    Nodes of one strong component have the same least label upstream (f) and, over the links
    inside f, downstream (b).  If both are equal, node and label reach each other.
    """
    forward = _upstream(arcs, turn, scratch)
    at = lambda t, c, e: t.select(F.col("x").alias(e), F.col("f").alias(f"{c}{e}"))
    inside = scratch.cut(arcs.join(at(forward, "f", "s"), "s").join(at(forward, "f", "d"), "d").where("fs = fd").select("s", "d", F.col("fs").alias("f")))
    back = _upstream(inside.select(F.col("d").alias("s"), F.col("s").alias("d")), turn, scratch)
    merged = back.withColumnRenamed("f", "b").join(forward, "x").where("b = f and x <> f.x")
    tests = scratch.cut(merged.select("x", F.col("f.x").alias("y"), F.col("f.x").alias("n")))
    left = inside.join(at(back, "b", "s"), "s").join(at(back, "b", "d"), "d").where("bs = bd and bs <> f").select("s", "d")
    return *scratch.cut_with(left), tests


def _strong(arcs: DataFrame, scratch: Scratch, finish_arcs: int) -> DataFrame:
    """(x, label) of nodes in strong components of two or more; label is the least member."""
    arcs, n = scratch.cut_with(arcs)
    tests: list[DataFrame] = []
    turn, stalled = 0, 0
    while n["rows"] > max(0, finish_arcs):
        if stalled > 3:
            nxt, n, merged = _coloured(arcs, turn, scratch)
            tests.append(merged)
            scratch.drop(arcs)
            arcs, turn, stalled = nxt, turn + 1, 0
            continue
        hooks = _cycles(arcs, scratch) if stalled == 3 else _hooks(arcs, turn, scratch)
        end = lambda e: hooks.select(F.col("x").alias(e), F.col("to").alias(f"to_{e}"), F.col("kind").alias(f"kind_{e}"))
        moved = arcs.join(end("s"), "s", "left").join(end("d"), "d", "left").where("coalesce(kind_s, '') <> 'drop' and coalesce(kind_d, '') <> 'drop'")
        moved = scratch.cut(moved.withColumns({"ns": F.coalesce("to_s", "s"), "nd": F.coalesce("to_d", "d")}))
        test = lambda x, y, other: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(other).alias("n"))
        kept = F.array_compact(F.array(
            F.when(F.col("kind_d") == "out", test("d", "to_d", "ns")), F.when(F.col("kind_s") == "in", test("s", "to_s", "nd")),
            F.when(F.col("kind_s") == "merge", test("s", "to_s", "to_s")), F.when(F.col("kind_d") == "merge", test("d", "to_d", "to_d")),
        ))
        tests.append(scratch.cut(moved.select(F.explode(kept).alias("t")).select("t.*").distinct()))
        nxt, after = scratch.cut_with(moved.where("ns <> nd").select(F.col("ns").alias("s"), F.col("nd").alias("d")).distinct())
        stalled = stalled + 1 if after["rows"] > 0.98 * n["rows"] else 0
        scratch.drop(arcs, hooks, moved)
        arcs, n, turn = nxt, after, turn + 1
    labels = scratch.cut(_finish(arcs) if n["rows"] else arcs.select(F.col("s").alias("x"), F.col("d").alias("label")).limit(0))
    for t in reversed(tests):
        of = lambda c: labels.select(F.col("x").alias(c), F.col("label").alias(f"l{c}"))
        both = t.join(of("y"), "y", "left").join(of("n"), "n", "left").withColumns({"ly": F.coalesce("ly", "y"), "ln": F.coalesce("ln", "n")})
        labels = scratch.cut(labels.unionByName(both.where("ly = ln").select("x", F.col("ly").alias("label")).distinct()))
    scratch.drop(*tests)
    if not tests:
        return labels
    least = labels.groupBy("label").agg(F.least(F.min("x"), F.col("label")).alias("least"))
    ends = labels.unionByName(labels.select(F.col("label").alias("x"), "label")).distinct()
    return scratch.cut(ends.join(least, "label").select("x", F.col("least").alias("label")))


def components(edges: DataFrame, u: str = "u", v: str = "v", finish_arcs: int = FINISH_ARCS) -> DataFrame:
    """(node_id, wcc_rep, scc_rep) for each id that is a non-null end of any row.

    A row with both ends links ``u`` to ``v``.  ``wcc_rep`` is the least id linked directly
    or indirectly whatever the direction, ``scc_rep`` the least id that both reaches the
    node and is reached from it.  Loops, repeated rows and rows with one null end add their
    ids and nothing else; an empty table gives no rows; further columns are ignored.  Ends
    must be integers.
    """
    spark: SparkSession = edges.sparkSession
    scratch = Scratch(spark, "components")
    ends = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v"))
    linked = ends.where("u is not null and v is not null and u <> v")
    pairs = scratch.cut(
        linked.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max(F.col("u") < F.col("v")).alias("fwd"), F.max(F.col("u") > F.col("v")).alias("bwd"))
    )
    two_way = _collapse(pairs.where("fwd and bwd").select("a", "b"), scratch)
    if two_way is None:
        two_way = scratch.cut(pairs.limit(0).select(F.col("a").alias("x"), F.col("b").alias("label")))
    to = lambda e: two_way.select(F.col("x").alias(e), F.col("label").alias(f"l{e}"))
    single = pairs.where("not (fwd and bwd)").select(F.when(F.col("fwd"), F.col("a")).otherwise(F.col("b")).alias("s"), F.when(F.col("fwd"), F.col("b")).otherwise(F.col("a")).alias("d"))
    single = single.join(to("s"), "s", "left").join(to("d"), "d", "left").select(F.coalesce("ls", "s").alias("s"), F.coalesce("ld", "d").alias("d")).where("s <> d").distinct()
    arcs = scratch.cut(single)
    weak = _collapse(arcs.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct(), scratch)
    strong = _strong(arcs, scratch, finish_arcs).withColumnRenamed("label", "strong")
    over = strong.withColumn("weak", F.lit(None).cast("bigint")) if weak is None else weak.withColumnRenamed("label", "weak").join(strong, "x", "full")
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node_id")).where("node_id is not null").distinct()
    mid = nodes.join(two_way.withColumnRenamed("x", "node_id"), "node_id", "left").select("node_id", F.coalesce("label", "node_id").alias("x"))
    return mid.join(over, "x", "left").select("node_id", F.coalesce("weak", "x").alias("wcc_rep"), F.coalesce("strong", "x").alias("scc_rep"))
