"""Shortest paths from many sources over a graph of any size.

The graph is cut into parts of a bounded number of nodes, near ones together where the caller
gives an order of place.  A task holds one part and a few sources: it settles all labels
inside the part by Dijkstra's rule and sends the labels that leave it to the parts they
enter.  Rounds go on until no part gets a better label, so their number is that of the parts
a path crosses, not of its edges, and a graph that fits one part takes one round.  Arcs reach
the tasks by a shuffle; neither the driver nor a broadcast ever holds the graph.

Labels of one source in one part are kept as one row of packed arrays.  Paths are read back
from the targets: each task follows the predecessors inside its part and passes the rest on.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.runtime import Scratch, grouped_rank, ship

#: Nodes of one part: with their arcs some tens of megabytes in a task.
PART_NODES = 100_000
#: Sources that a task routes together over its copy of a part.
GROUP_SOURCES = 8

_LABEL = "part int, grp int, source bigint, state bigint, cost double, pred bigint, edge bigint, states binary, costs binary, preds binary, edges binary"
_COLUMNS = [c.split()[0] for c in _LABEL.split(", ")]


def cheapest_arcs(edges: DataFrame, cost: str) -> DataFrame:
    """One arc per ordered node pair: the cheapest, ties by edge id."""
    e = edges.where(f"u is not null and v is not null and {cost} is not null and not isnan({cost}) and {cost} >= 0")
    return e.groupBy("u", "v").agg(F.min(F.struct(F.col(cost).alias("cost"), "edge_id")).alias("b")).select("u", "v", "b.cost", "b.edge_id")


def relax(edges: DataFrame, sources: DataFrame, cost: str, max_rounds: int = 100_000) -> DataFrame:
    """(source, node_id, cost) of the cheapest way from each source to every node it reaches."""
    scratch = Scratch(edges.sparkSession, "relax")
    arcs = scratch.cut(cheapest_arcs(edges, cost).select("u", "v", "cost"))
    best = scratch.cut(sources.select(F.col(sources.columns[0]).alias("source")).distinct().select("source", F.col("source").alias("node_id"), F.lit(0.0).alias("cost")))
    frontier = best
    for _ in range(max_rounds):
        steps = frontier.withColumnRenamed("cost", "so_far").join(arcs, F.col("node_id") == F.col("u")).select("source", F.col("v").alias("node_id"), (F.col("so_far") + F.col("cost")).alias("cost"))
        steps = steps.groupBy("source", "node_id").agg(F.min("cost").alias("cost"))
        merged = best.withColumnRenamed("cost", "old").join(steps, ["source", "node_id"], "full")
        improved = F.col("cost").isNotNull() & (F.col("old").isNull() | (F.col("cost") < F.col("old")))
        new, n = scratch.cut_with(merged.select("source", "node_id", F.when(improved, F.col("cost")).otherwise(F.col("old")).alias("cost"), improved.alias("open")), open=F.sum(F.col("open").cast("int")))
        scratch.drop(best)
        best = new
        if not n["open"]:
            return best.select("source", "node_id", "cost")
        frontier = best.where("open").select("source", "node_id", "cost")
    raise RuntimeError("labels did not settle")


class _Part:
    """The arcs of one part by their start, as arrays."""

    def __init__(self, arcs: pd.DataFrame):
        arcs = arcs.sort_values(["s", "d", "edge_id"], kind="stable")
        self.starts, first = np.unique(arcs["s"].to_numpy(), return_index=True)
        self.at = {s: (a, b) for s, a, b in zip(self.starts.tolist(), first.tolist(), [*first.tolist()[1:], len(arcs)])}
        self.d, self.w, self.e, self.to = arcs["d"].tolist(), arcs["w"].tolist(), arcs["edge_id"].tolist(), arcs["dpart"].tolist()


def _settle(part: _Part, here: int, labels: dict[int, tuple], fresh: list[tuple]) -> dict[int, tuple]:
    """Spread better labels (cost, pred, edge) inside a part; return the labels that leave it, with their part.

    Equal costs prefer the lesser predecessor, then the lesser edge, but for arcs without
    cost and labels from other parts, which could close a circle of predecessors.
    """
    heap, out = [], {}
    for state, *label in fresh:
        old = labels.get(state)
        if old is None or label[0] < old[0]:
            heap.append((label[0], state))
            labels[state] = tuple(label)
    heapq.heapify(heap)
    while heap:
        c, x = heapq.heappop(heap)
        if c > labels[x][0]:
            continue
        a, b = part.at.get(x, (0, 0))
        for k in range(a, b):
            y, n = part.d[k], c + part.w[k]
            if part.to[k] == here:
                old = labels.get(y)
                if old is None or n < old[0]:
                    labels[y] = (n, x, part.e[k])
                    heapq.heappush(heap, (n, y))
                elif n == old[0] and part.w[k] > 0 and (x, part.e[k]) < old[1:]:
                    labels[y] = (n, x, part.e[k])
            else:
                new = (n, x, part.e[k])
                if y not in out or new < out[y][:3]:
                    out[y] = (*new, part.to[k])
    return out


def _unpack(row) -> dict[int, tuple]:
    parts = [np.frombuffer(row[c], t).tolist() for c, t in (("states", "i8"), ("costs", "f8"), ("preds", "i8"), ("edges", "i8"))]
    return {s: (c, p, e) for s, c, p, e in zip(*parts)}


def _round(todo: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """One part and group of sources: take in labels sent here, settle, keep the part's labels, send on what leaves."""
    if not len(todo):
        return pd.DataFrame(columns=_COLUMNS)
    here, grp = int(todo["part"].iloc[0]), int(todo["grp"].iloc[0])
    part, rows = _Part(arcs), []
    for source, mine in todo.groupby("source", sort=True):
        kept = mine[mine["states"].notna()]
        labels = _unpack(kept.iloc[0]) if len(kept) else {}
        sent = mine[mine["states"].isna()]
        fresh = list(zip(sent["state"].tolist(), sent["cost"].tolist(), sent["pred"].tolist(), sent["edge"].tolist()))
        out = _settle(part, here, labels, fresh)
        cols = list(zip(*[(s, *label) for s, label in sorted(labels.items())]))
        rows.append((here, grp, source, -1, 0.0, -1, -1, *[np.array(c, t).tobytes() for c, t in zip(cols, ("i8", "f8", "i8", "i8"))]))
        rows += [(int(to), grp, source, y, c, p, e, None, None, None, None) for y, (c, p, e, to) in out.items()]
    return pd.DataFrame(rows, columns=_COLUMNS)


def _sound(arcs: DataFrame, *more: str) -> DataFrame:
    good = arcs.where("s is not null and d is not null and w is not null and not isnan(w) and w >= 0 and edge_id is not null")
    return good.select(F.col("s").cast("bigint").alias("s"), F.col("d").cast("bigint").alias("d"), F.col("w").cast("double").alias("w"), F.col("edge_id").cast("bigint").alias("edge_id"), *more)


def _parts(nodes: DataFrame, order: DataFrame | None, part_nodes: int, scratch: Scratch) -> DataFrame:
    """(node, part) of distinct nodes, in the order of place."""
    by = []
    if order is not None:
        by = [F.col(c) for c in order.columns if c != "node"]
        nodes = nodes.join(order.dropDuplicates(["node"]), "node", "left")
    placed = grouped_rank(nodes.select("node", F.lit(0).alias("_all"), *[c.alias(f"_o{k}") for k, c in enumerate(by)]), ["_all"], [*[f"_o{k}" for k in range(len(by))], "node"], "_rank", scratch, few_groups=True)
    return scratch.cut(placed.select("node", F.floor(F.col("_rank") / part_nodes).cast("int").alias("part")))


def _labels(good: DataFrame, part: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Settled labels, packed per part and source, from ``starts``: source, grp, node."""
    at = lambda c, p: part.select(F.col("node").alias(c), F.col("part").alias(p))
    cut = scratch.cut(good.join(at("s", "part"), "s").join(at("d", "dpart"), "d"))
    null = {c: F.lit(None).cast("binary").alias(c) for c in ("states", "costs", "preds", "edges")}
    first = starts.join(at("node", "part"), "node").select("part", "grp", "source", F.col("node").alias("state"), F.lit(0.0).alias("cost"), F.lit(-1).cast("bigint").alias("pred"), F.lit(-1).cast("bigint").alias("edge"), *null.values())
    todo, n = scratch.cut_with(first)
    labels = None
    while n["rows"]:
        keys = todo.select(F.col("part").alias("kpart"), F.col("grp").alias("kgrp")).distinct()
        here = lambda t: (t["part"] == F.col("kpart")) & (t["grp"] == F.col("kgrp"))
        work = todo if labels is None else todo.unionByName(labels.join(keys, here(labels), "left_semi"))
        mine = cut.join(keys, F.col("part") == F.col("kpart")).select(F.col("kpart").alias("part"), F.col("kgrp").alias("grp"), "s", "d", "w", "edge_id", "dpart")
        out = scratch.cut(work.groupBy("part", "grp").cogroup(mine.groupBy("part", "grp")).applyInPandas(_round, _LABEL))
        kept = out.where("states is not null")
        labels = kept if labels is None else scratch.cut(kept.unionByName(labels.join(keys, here(labels), "left_anti")))
        better = out.where("states is null").groupBy("part", "grp", "source", "state").agg(F.min(F.struct("cost", "pred", "edge")).alias("b"))
        todo, n = scratch.cut_with(better.select("part", "grp", "source", "state", "b.cost", "b.pred", "b.edge", *null.values()))
    return labels


def route(arcs: DataFrame, pairs: DataFrame, order: DataFrame | None = None, part_nodes: int = PART_NODES, group_sources: int = GROUP_SOURCES) -> DataFrame:
    """(source, target, cost, edges): the cheapest path of each pair as an array of edge ids.

    ``arcs``: s, d, w (not negative), edge_id; ``pairs``: source, target.  ``order``: node and
    any sortable columns that put near nodes side by side; without it nodes go by number.  A
    pair without a way has null cost and edges; a node to itself costs 0.  Parallel arcs are
    allowed.  Null ends, null, NaN or negative costs and null pairs are left out; repeated
    pairs count once; no rows give no rows.
    """
    ship(arcs.sparkSession)
    scratch = Scratch(arcs.sparkSession, "route")
    good = _sound(arcs)
    pairs = scratch.cut(pairs.select(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target")).where("source is not null and target is not null").distinct())
    part = _parts(good.select(F.col("s").alias("node")).unionAll(good.select("d")).unionAll(pairs.select("source")).unionAll(pairs.select("target")).distinct(), order, part_nodes, scratch)
    one = pairs.select("source").distinct().withColumn("_all", F.lit(0))
    sources = scratch.cut(grouped_rank(one, ["_all"], ["source"], "_n", scratch, few_groups=True).select("source", F.floor(F.col("_n") / group_sources).cast("int").alias("grp")))
    labels = _labels(good, part, sources.withColumn("node", F.col("source")), scratch)
    if labels is None:
        return pairs.select("source", "target", F.lit(None).cast("double").alias("cost"), F.lit(None).cast("array<bigint>").alias("edges"))
    return _read_back(labels, pairs, part, sources, scratch)


def spread(arcs: DataFrame, starts: DataFrame, order: DataFrame | None = None, part_nodes: int = PART_NODES) -> DataFrame:
    """(node, cost) of every node that some start reaches, with the least cost from any of them.

    As ``route`` with all starts as one source; ``starts`` has one column.
    """
    ship(arcs.sparkSession)
    scratch = Scratch(arcs.sparkSession, "spread")
    good = _sound(arcs)
    begin = scratch.cut(starts.select(F.col(starts.columns[0]).cast("bigint").alias("node")).where("node is not null").distinct())
    part = _parts(good.select(F.col("s").alias("node")).unionAll(good.select("d")).unionAll(begin.select("node")).distinct(), order, part_nodes, scratch)
    labels = _labels(good, part, begin.select("node", F.lit(0).cast("bigint").alias("source"), F.lit(0).alias("grp")), scratch)
    if labels is None:
        return begin.select("node", F.lit(0.0).alias("cost"))

    def rows(batches):
        for pdf in batches:
            for states, costs in zip(pdf["states"], pdf["costs"]):
                yield pd.DataFrame({"node": np.frombuffer(states, "i8"), "cost": np.frombuffer(costs, "f8")})

    return labels.select("states", "costs").mapInPandas(rows, "node bigint, cost double")


_ASK = "source bigint, target bigint, leg int, state bigint, total double, open boolean, edges array<bigint>"


def _walk(asked: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
    """Follow predecessors inside one part for each request; an open one goes on from ``state`` in another part."""
    rows = []
    have = {r.source: r for r in labels.itertuples()}
    for source, mine in asked.groupby("source", sort=True):
        known = _unpack(have[source]._asdict()) if source in have else {}
        for r in mine.itertuples():
            x, path = int(r.state), []
            if r.leg == 0 and x not in known:
                continue
            total = known[x][0] if r.leg == 0 else r.total
            while x != source and x in known:
                _, x, e = known[x]
                path.append(e)
            rows.append((source, r.target, r.leg, x, total, x != source, path[::-1]))
    return pd.DataFrame(rows, columns=["source", "target", "leg", "state", "total", "open", "edges"])


def _read_back(labels: DataFrame, pairs: DataFrame, part: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    legs: list[DataFrame] = []
    ask = pairs.select("source", "target", F.lit(0).alias("leg"), F.col("target").alias("state"), F.lit(0.0).alias("total"))
    while True:
        at = ask.join(part.select(F.col("node").alias("state"), "part"), "state").join(sources, "source")
        done, n = scratch.cut_with(at.groupBy("part", "grp").cogroup(labels.groupBy("part", "grp")).applyInPandas(_walk, _ASK), open=F.sum(F.col("open").cast("int")))
        legs.append(done)
        if not n["open"]:
            break
        ask = done.where("open").select("source", "target", (F.col("leg") + 1).alias("leg"), "state", "total")
    whole = legs[0]
    for more in legs[1:]:
        whole = whole.unionByName(more)
    paths = whole.groupBy("source", "target").agg(F.max("total").alias("cost"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("leg")).alias("o"), "edges"))), lambda x: x["edges"])).alias("edges"))
    return pairs.join(paths, ["source", "target"], "left")


#: A node is taken out of a graph if that adds at most so many arcs.
FILL = 64
#: Sources that a task routes together over a reduced graph.
REDUCED_SOURCES = 64
#: A round that leaves more than this share of the nodes is the last.
LEAST_SHRINK = 0.7

_SUM = "s bigint, d bigint, w double, length double, hops bigint, first bigint, last bigint, sterm boolean, dterm boolean"
_SUM_COLUMNS = [c.split()[0] for c in _SUM.split(", ")]
_TOTAL = "part int, grp int, source bigint, state bigint, cost double, length double, hops bigint, first bigint, last bigint, kept boolean"
_TOTAL_COLUMNS = [c.split()[0] for c in _TOTAL.split(", ")]


def _reduce(arcs: pd.DataFrame) -> pd.DataFrame:
    """The arcs of one part without its inner nodes: those taken out leave arcs that carry the sums of the ways over them.

    Nodes go in the order of the arcs that this adds, ties by number.  Terminals and nodes with
    an arc to or from another part stay.
    """
    here = int(arcs["part"].iloc[0])
    out: dict[int, dict[int, tuple]] = {}
    into: dict[int, set[int]] = {}
    stays, terms, across = set(), set(), []
    arcs = arcs.sort_values(["s", "d", "w", "hops", "first", "last"], kind="stable")
    cols = [arcs[c].tolist() for c in ("s", "d", "w", "length", "hops", "first", "last", "sterm", "dterm", "spart", "dpart")]
    for s, d, w, length, hops, first, last, sterm, dterm, spart, dpart in zip(*cols):
        if sterm:
            terms.add(s)
        if dterm:
            terms.add(d)
        if spart != dpart:
            stays.add(s if spart == here else d)
            if spart == here:
                across.append((s, d, w, length, hops, first, last, sterm, dterm))
        elif s != d:
            known = out.setdefault(s, {})
            if d not in known:  # the first is the least
                known[d] = (w, length, hops, first, last)
                into.setdefault(d, set()).add(s)
    stays |= terms
    nodes = out.keys() | into.keys()
    for x in nodes:
        out.setdefault(x, {})
        into.setdefault(x, set())
    added = lambda x: len(into[x]) * len(out[x]) - len(into[x]) - len(out[x])
    heap = [(added(x), x) for x in nodes if x not in stays]
    heapq.heapify(heap)
    while heap:
        f, x = heapq.heappop(heap)
        if f > FILL:
            break
        if x not in out or f != added(x):
            continue
        before, after = sorted(into.pop(x)), out.pop(x)
        for q in after:
            into[q].discard(x)
        for p in before:
            from_p = out[p]
            w, length, hops, first, _ = from_p.pop(x)
            for q, (w2, length2, hops2, _, last2) in after.items():
                if q != p:
                    old = from_p.get(q)
                    if old is None:
                        into[q].add(p)
                    if old is None or w + w2 < old[0]:
                        from_p[q] = (w + w2, length + length2, hops + hops2, first, last2)
        for y in {*before, *after}:
            if y not in stays:
                heapq.heappush(heap, (added(y), y))
    rows = across + [(s, d, *a, s in terms, d in terms) for s, to in out.items() for d, a in to.items()]
    return pd.DataFrame(rows, columns=_SUM_COLUMNS)


def _reduced(arcs: DataFrame, order: DataFrame | None, part_nodes: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(arcs, parts) of a graph with the same least costs between terminals and far fewer nodes.

    Every round cuts what is left into parts anew, so a part covers more of the map each time;
    the rounds end with a graph that was one part, or where they take out little more.
    """
    while True:
        nodes = arcs.select(F.explode(F.array("s", "d")).alias("node")).distinct()
        part = _parts(nodes, order, part_nodes, scratch)
        size = part.agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("p")).first()
        at = lambda c, p: part.select(F.col("node").alias(c), F.col("part").alias(p))
        placed = arcs.join(at("s", "spart"), "s").join(at("d", "dpart"), "d")
        if size["n"] <= part_nodes:
            each = placed.withColumn("part", F.lit(0))
        else:
            each = placed.withColumn("part", F.explode(F.array_distinct(F.array("spart", "dpart"))))
        arcs = scratch.cut(each.groupBy("part").applyInPandas(_reduce, _SUM))
        left = arcs.select(F.explode(F.array("s", "d")).alias("node")).distinct()
        if size["n"] <= part_nodes or left.count() > LEAST_SHRINK * size["n"]:
            return arcs, _parts(left, order, part_nodes, scratch)


def _totals(todo: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """One part and group of sources: settle the labels sent here; keep those of terminals and of nodes entered, send on what leaves."""
    if not len(todo):
        return pd.DataFrame(columns=_TOTAL_COLUMNS)
    here, grp = int(todo["part"].iloc[0]), int(todo["grp"].iloc[0])
    arcs = arcs.sort_values(["s", "d"], kind="stable")
    leaving: dict[int, list] = {}
    steps: dict[int, list] = {}
    terms = set(arcs["d"][arcs["dterm"].astype(bool) & (arcs["dpart"] == here)].tolist())
    for s, d, to, *a in zip(*[arcs[c].tolist() for c in ("s", "d", "dpart", "w", "length", "hops", "first", "last")]):
        (steps if to == here else leaving).setdefault(s, []).append((d, a[0], a) if to == here else (d, a[0], a, to))
    done: list[list] = [[] for _ in _TOTAL_COLUMNS]

    def add(*row):
        for c, x in zip(done, row):
            c.append(x)

    fields = ["state", "cost", "length", "hops", "first", "last", "kept"]
    for source, mine in todo.groupby("source", sort=True):
        sums: dict[int, tuple] = {}
        fresh = []
        for y, c, length, hops, first, last, kept in sorted(zip(*[mine[f].tolist() for f in fields]), key=lambda r: not r[6]):
            if y not in sums or c < sums[y][0]:
                sums[y] = (c, length, hops, first, last)
                if not kept:
                    fresh.append((c, y))
        keep = terms | sums.keys()
        best = {y: x[0] for y, x in sums.items()}
        came: dict[int, tuple] = {}
        out: dict[int, tuple] = {}
        heap = fresh
        heapq.heapify(heap)
        while heap:
            c, x = heapq.heappop(heap)
            if c > best[x]:
                continue
            if x in came:  # settled now, so its way is final
                p, a = came.pop(x)
                _, length, hops, first, _ = sums[p]
                sums[x] = (c, length + a[1], hops + a[2], first if hops else a[3], a[4])
            for y, w, a in steps.get(x, ()):
                n = c + w
                if n < best.get(y, np.inf):
                    best[y] = n
                    came[y] = (x, a)
                    heapq.heappush(heap, (n, y))
            if x in leaving:
                _, length, hops, first, _ = sums[x]
                for y, w, a, to in leaving[x]:
                    if y not in out or c + w < out[y][0]:
                        out[y] = (c + w, length + a[1], hops + a[2], first if hops else a[3], a[4], to)
        for y, x in sums.items():
            if y in keep:
                add(here, grp, source, y, *x, True)
        for y, (*x, to) in out.items():
            add(to, grp, source, y, *x, False)
    return pd.DataFrame(dict(zip(_TOTAL_COLUMNS, done)))


def among(arcs: DataFrame, terminals: DataFrame, order: DataFrame | None = None, part_nodes: int = PART_NODES, group_sources: int = REDUCED_SOURCES) -> DataFrame:
    """(source, target, cost, length, hops, first, last) of the cheapest path from each source to every terminal that it reaches.

    ``arcs``: s, d, w (not negative), edge_id, length; ``terminals``: node and whether it is a
    source (``starts``).  ``length`` and ``hops`` are summed along the path, ``first`` and
    ``last`` are its ends' edges.  The graph is first reduced part by part to one with the same
    least costs between terminals (see ``_reduce``), so sums are carried instead of paths and
    pairs without a way are never listed.  A source itself isn't among its targets.
    """
    ship(arcs.sparkSession)
    scratch = Scratch(arcs.sparkSession, "among")
    ends = scratch.cut(terminals.select(F.col("node").cast("bigint").alias("node"), F.col("starts").cast("boolean").alias("starts")).where("node is not null").groupBy("node").agg(F.max("starts").alias("starts")))
    good = _sound(arcs.select("s", "d", "w", "edge_id", "length"), "length").where("s <> d").groupBy("s", "d").agg(F.min(F.struct("w", "edge_id", "length")).alias("b"))
    is_end = lambda c, t: ends.select(F.col("node").alias(c), F.lit(True).alias(t))
    flagged = good.join(is_end("s", "sterm"), "s", "left").join(is_end("d", "dterm"), "d", "left")
    start = scratch.cut(flagged.select("s", "d", "b.w", F.col("b.length").cast("double").alias("length"), F.lit(1).cast("bigint").alias("hops"), F.col("b.edge_id").alias("first"), F.col("b.edge_id").alias("last"), F.coalesce("sterm", F.lit(False)).alias("sterm"), F.coalesce("dterm", F.lit(False)).alias("dterm")))
    core, part = _reduced(start, order, part_nodes, scratch)
    at = lambda c, p: part.select(F.col("node").alias(c), F.col("part").alias(p))
    cut, shut = scratch.cut_with(core.drop("sterm").join(at("s", "part"), "s").join(at("d", "dpart"), "d"), across=F.sum((F.col("part") != F.col("dpart")).cast("int")))
    one = ends.where("starts").select(F.col("node").alias("source")).withColumn("_all", F.lit(0))
    grouped = grouped_rank(one, ["_all"], ["source"], "_n", scratch, few_groups=True).select("source", F.floor(F.col("_n") / group_sources).cast("int").alias("grp"))
    zero = [F.lit(0.0).alias("cost"), F.lit(0.0).alias("length"), F.lit(0).cast("bigint").alias("hops"), F.lit(-1).cast("bigint").alias("first"), F.lit(-1).cast("bigint").alias("last"), F.lit(False).alias("kept")]
    todo, n = scratch.cut_with(grouped.join(at("source", "part"), "source").select("part", "grp", "source", F.col("source").alias("state"), *zero))
    labels = None
    while n["rows"]:
        keys = todo.select(F.col("part").alias("kpart"), F.col("grp").alias("kgrp")).distinct()
        here = lambda t: (t["part"] == F.col("kpart")) & (t["grp"] == F.col("kgrp"))
        work = todo if labels is None else todo.unionByName(labels.join(keys, here(labels), "left_semi"))
        mine = cut.join(keys, F.col("part") == F.col("kpart")).select(F.col("kpart").alias("part"), F.col("kgrp").alias("grp"), "s", "d", "w", "length", "hops", "first", "last", "dterm", "dpart")
        out, n = scratch.cut_with(work.groupBy("part", "grp").cogroup(mine.groupBy("part", "grp")).applyInPandas(_totals, _TOTAL), rows=F.sum((~F.col("kept")).cast("int")))
        kept = out.where("kept")
        labels = kept if labels is None else scratch.cut(kept.unionByName(labels.join(keys, here(labels), "left_anti")))
        if n["rows"]:
            row = ["cost", "length", "hops", "first", "last"]
            better = out.where("not kept").groupBy("part", "grp", "source", "state").agg(F.min(F.struct(*row)).alias("b"))
            todo = scratch.cut(better.select("part", "grp", "source", "state", *[f"b.{c}" for c in row], F.lit(False).alias("kept")))
    names = ["source", "state", "cost", "length", "hops", "first", "last"]
    found = todo.select(*names).limit(0) if labels is None else labels.select(*names)
    if shut["across"]:  # nodes entered from other parts were kept beside the terminals
        found = found.join(ends.select(F.col("node").alias("state")), "state", "left_semi")
    return found.where("state <> source").withColumnRenamed("state", "target").select("source", "target", *names[2:])


def tree_paths(edges: DataFrame, pairs: DataFrame, cost: str, order: DataFrame | None = None, part_nodes: int = PART_NODES) -> DataFrame:
    """(source, target, cost, edges) over the cheapest edge of each ordered node pair; see ``route``."""
    arcs = cheapest_arcs(edges, cost).select(F.col("u").alias("s"), F.col("v").alias("d"), F.col("cost").alias("w"), "edge_id")
    return route(arcs, pairs, order, part_nodes)


def all_pairs(nodes: DataFrame, node: str) -> DataFrame:
    """(source, target) of every two different nodes: the grid that a travel-time matrix is.

    Each node is repeated once per place in a dense numbering and joined by that place, so
    no task holds the list of nodes.  The numbering is named as the side to hash: Spark takes
    the repeated side for as small as its nodes and would broadcast all pairs.
    """
    scratch = Scratch(nodes.sparkSession, "pairs")
    one = nodes.select(F.col(node).alias("n")).where("n is not null").distinct().withColumn("_all", F.lit(0))
    ranked, n = scratch.cut_with(grouped_rank(one, ["_all"], ["n"], "k", scratch, few_groups=True).select("n", "k"))
    grid = ranked.select(F.col("n").alias("source"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, n["rows"] - 1)).cast("bigint"))).alias("k"))
    return grid.join(ranked.select(F.col("n").alias("target"), "k").hint("shuffle_hash"), "k").where("source <> target").select("source", "target")


def slots(paths: DataFrame) -> DataFrame:
    """One row per place of a path: source, target, pos, edge_id."""
    return paths.where("edges is not null").select("source", "target", F.posexplode("edges").alias("pos", "edge_id"))


def unreachable(costs: DataFrame) -> DataFrame:
    """Counts of pairs: reached, unreachable, zero off the diagonal, negative."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = F.col("cost")
    return costs.agg(n(c.isNotNull()).alias("reached"), n(c.isNull()).alias("unreachable"), n((c == 0) & (F.col("source") != F.col("target"))).alias("zero_off_diagonal"), n(c < 0).alias("negative"))
