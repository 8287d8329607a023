import random

from roadweave.operators import closure, network, routing, turns


def edges_df(spark, rows):
    return spark.createDataFrame([(i, u, v, float(w)) for i, (u, v, w) in enumerate(rows)], "edge_id long, u long, v long, length_m double")


def flood(rows, start, forward=True):
    seen, todo = {start: 0}, [start]
    while todo:
        x = todo.pop(0)
        for u, v, _ in rows:
            a, b = (u, v) if forward else (v, u)
            if a == x and b is not None and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    return seen


ROWS = [(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 2), (4, 5, 1), (5, 3, 5), (6, 7, 1), (None, 8, 1), (9, None, 1), (10, 10, 1), (5, 11, 1)]


def test_reachability_both_ways(spark):
    df, start = edges_df(spark, ROWS), spark.createDataFrame([(3,)], "n long")
    for forward in (True, False):
        want = flood(ROWS, 3, forward)
        for kernel in (closure.KERNEL_ARCS, 0):
            assert {r["node_id"]: r["hops"] for r in closure.reachable(df, start, forward, kernel).collect()} == want
    assert {r["node_id"] for r in closure.mutual_set(df, start).collect()} == {1, 2, 3, 4, 5}


def test_components_random(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(80), rng.randrange(80), 1) for _ in range(60)] + [(200 + i, 201 + i, 1) for i in range(50)]
    nodes = {x for u, v, _ in rows for x in (u, v)}
    want = {}
    for n in sorted(nodes):
        if n not in want:
            both = rows + [(v, u, w) for u, v, w in rows]
            want.update(dict.fromkeys(flood(both, n), n))
    got = {r["node_id"]: r["component"] for r in closure.weak_components(edges_df(spark, rows)).collect()}
    assert got == want
    giant = [r for r in closure.component_sizes(closure.weak_components(edges_df(spark, rows))).collect() if r["is_giant"]]
    assert len(giant) == 1 and giant[0]["size"] == max(sum(c == x for c in want.values()) for x in want.values())


def test_paths_agree(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(25), rng.randrange(25), rng.randint(1, 9)) for _ in range(80)]
    df = edges_df(spark, rows)
    sources = spark.createDataFrame([(0,), (3,)], "n long")
    labels = {(r["source"], r["node_id"]): r["cost"] for r in routing.relax(df, sources, "length_m").collect()}
    pairs = spark.createDataFrame([(s, t) for s in (0, 3) for t in range(25)], "source long, target long")
    got = routing.tree_paths(df, pairs, "length_m").collect()
    assert {(r["source"], r["target"]): r["cost"] for r in got if r["cost"] is not None} == labels
    for r in got:
        if r["edges"]:
            at, cost = r["source"], 0
            for e in r["edges"]:
                assert rows[e][0] == at
                at, cost = rows[e][1], cost + rows[e][2]
            assert at == r["target"] and cost == r["cost"]
    u = routing.unreachable(spark.createDataFrame(got)).first()
    assert u["reached"] + u["unreachable"] == 50 and u["negative"] == 0


def walk_states(seqs, edges):
    """The turn-aware graph by stepping through every state."""
    pre = {s[:k] for _, kind, s in seqs for k in range(1, len(s))}
    ban = {(s[:-1], s[-1]) for _, kind, s in seqs if kind == "NO_SEQUENCE"}
    only = [(r, s[:k], s[k]) for r, kind, s in seqs if kind == "ONLY_SEQUENCE" for k in range(1, len(s))]
    out = set()
    ends = {e: v for e, u, v in edges}
    for state in [()] + sorted(pre):
        for e, u, v in edges:
            if state and u != ends.get(state[-1]):
                continue
            if state and state[-1] not in ends:
                continue
            sufs = [state[i:] for i in range(len(state))]
            if any((s, e) in ban for s in sufs):
                continue
            if any(p in sufs and all((r2, p2, x2) != (r, p, e) for r2, p2, x2 in only) for r, p, _ in only):
                continue
            path = state + (e,)
            nxt = next((path[i:] for i in range(len(path)) if path[i:] in pre), ())
            out.add((u, state, e, v, nxt))
    return out


def test_turn_states(spark):
    edges = [(1, 10, 20), (2, 20, 30), (3, 20, 40), (4, 30, 20), (5, 20, 10), (6, 40, 20), (7, 30, 40)]
    seqs = [(1, "NO_SEQUENCE", (1, 2)), (2, "ONLY_SEQUENCE", (4, 3, 6)), (3, "NO_SEQUENCE", (2, 7, 6)), (4, "ONLY_SEQUENCE", (6, 5)), (5, "ONLY_SEQUENCE", (6, 2))]
    s = spark.createDataFrame([(r, k, list(q)) for r, k, q in seqs], "relation_id long, rule_kind string, seq array<bigint>")
    e = spark.createDataFrame(edges, "edge_id long, u long, v long")
    got = {(r["from_node"], tuple(r["from_prefix"]), r["edge_id"], r["to_node"], tuple(r["to_prefix"])) for r in turns.state_transitions(s, e).collect()}
    assert got == walk_states(seqs, edges)


def test_via_way(spark):
    e = spark.createDataFrame([(1, 100, 10, 20, "FORWARD"), (2, 200, 20, 30, "FORWARD"), (3, 200, 30, 40, "FORWARD"), (4, 200, 30, 20, "BACKWARD"), (5, 300, 40, 50, "FORWARD"), (6, 300, 20, 60, "FORWARD")], "edge_id long, way_id long, u long, v long, way_direction string")
    rel = spark.createDataFrame([(7, 100, 200, 300)], "relation_id long, from_way long, via_way long, to_way long")
    assert {tuple(r["seq"]) for r in turns.via_way_sequences(rel, e).collect()} == {(1, 2, 3, 5)}


def test_neighbourhood_and_runs(spark):
    s = spark.createDataFrame([(f"1:{i}", 1, i, i, i + 1, 1.0) for i in range(8)] + [("2:0", 2, 0, 3, 99, 1.0), ("3:0", 3, 0, 50, 51, 1.0)], "segment_uid string, way_id long, seq int, u long, v long, length_m double")
    got = {r[0] for r in network.neighbourhood(s, spark.createDataFrame([("1:3",)], "segment_uid string")).collect()}
    assert got == {"1:1", "1:2", "1:4", "1:5", "2:0"}
    topo = network.topo_segments(s, spark.createDataFrame([(4,)], "node_id long"))
    assert {r["topo_id"] for r in topo.collect()} == {"1:0-3", "1:4-7", "2:0-0", "3:0-0"}
    inc = {r["node_id"]: r["topo_ids"] for r in network.incident_topo(topo).collect()}
    assert inc[4] == ["1:0-3", "1:4-7"]


def test_parts_of_any_size_give_the_same_paths(spark):
    """Paths over one part, tiny parts and a brute Dijkstra; zero costs, loops, parallel arcs, unknown nodes."""
    import heapq

    rng = random.Random(17)
    arcs = [(rng.randrange(40), rng.randrange(40), rng.choice([0.0, 1.0, 2.5, 4.0]), 1000 + i) for i in range(110)] + [(1, 2, None, 5), (None, 2, 1.0, 6), (3, 4, float("nan"), 7), (3, 4, -1.0, 8)]
    good = [a for a in arcs if a[0] is not None and a[2] is not None and a[2] >= 0]

    def brute(s):
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            c, x = heapq.heappop(heap)
            for u, v, w, _ in good:
                if u == x and c == best[x] and c + w < best.get(v, 1e9):
                    best[v] = c + w
                    heapq.heappush(heap, (c + w, v))
        return best

    df = spark.createDataFrame(arcs, "s long, d long, w double, edge_id long")
    asked = [(s, t) for s in (0, 7, 900) for t in [*range(40), 901]] + [(0, 1), (None, 3)]
    pairs = spark.createDataFrame(asked, "source long, target long")
    by = {a[3]: a for a in good}
    for size, group in ((100, 8), (7, 1)):
        got = routing.route(df, pairs, part_nodes=size, group_sources=group).collect()
        assert len(got) == 3 * 41
        for r in got:
            want = brute(r["source"]).get(r["target"])
            assert r["cost"] == want, (size, r, want)
            if want is not None:
                at = r["source"]
                for e in r["edges"]:
                    assert by[e][0] == at
                    at = by[e][1]
                assert at == r["target"] and abs(sum(by[e][2] for e in r["edges"]) - want) < 1e-9
    assert routing.route(df.limit(0), pairs.limit(0)).count() == 0
    assert {(r["source"], r["target"]) for r in routing.all_pairs(spark.createDataFrame([(1,), (2,), (2,), (None,), (5,)], "n long"), "n").collect()} == {(a, b) for a in (1, 2, 5) for b in (1, 2, 5) if a != b}


def test_reduced_graph_keeps_costs_and_sums(spark):
    """Least costs, lengths, hops and ends between terminals against plain paths, over one part and over tiny ones."""
    rng = random.Random(23)
    arcs = [(i, i + 1, rng.uniform(1, 2), rng.uniform(1, 2)) for i in range(60)] + [(i + 1, i, rng.uniform(1, 2), rng.uniform(1, 2)) for i in range(60)]
    arcs += [(rng.randrange(70), rng.randrange(70), rng.uniform(3, 20), rng.uniform(1, 2)) for _ in range(40)] + [(3, 3, 0.0, 1.0), (3, 4, None, 1.0), (3, 4, -1.0, 1.0)]
    arcs = [(*a, 1000 + i) for i, a in enumerate(arcs)]
    df = spark.createDataFrame(arcs, "s long, d long, w double, length double, edge_id long")
    ends = [(0, True), (17, True), (44, False), (60, True), (66, False), (900, True), (901, False)]
    terminals = spark.createDataFrame(ends, "node long, starts boolean")
    pairs = spark.createDataFrame([(s, t) for s, starts in ends if starts for t, _ in ends if s != t], "source long, target long")
    by = {a[4]: a for a in arcs}
    want = {}
    for r in routing.route(df, pairs).where("cost is not null").collect():
        e = r["edges"]
        want[r["source"], r["target"]] = (round(r["cost"], 6), round(sum(by[x][3] for x in e), 6), len(e), e[0], e[-1])
    assert len(want) > 8
    for size, group in ((1000, 8), (25, 2)):
        got = routing.among(df, terminals, part_nodes=size, group_sources=group).collect()
        assert {(r["source"], r["target"]): (round(r["cost"], 6), round(r["length"], 6), r["hops"], r["first"], r["last"]) for r in got} == want, size
        assert len(got) == len(want)
    assert routing.among(df.limit(0), terminals).count() == 0


def test_mutual_nodes_over_parts(spark):
    """The nodes of mutual_set whatever the parts; a null end, a loop, an anchor without edges."""
    df = edges_df(spark, ROWS + [(12, 1, 1), (2, 13, 1), (13, 14, 1), (14, 2, 1)])
    for anchor, want in ((3, {1, 2, 3, 4, 5, 13, 14}), (12, {12}), (77, {77})):
        start = spark.createDataFrame([(anchor,)], "n long")
        assert sorted(r[0] for r in closure.mutual_nodes(df, start).collect()) == sorted(want)
    assert sorted(r[0] for r in closure.mutual_nodes(df, spark.createDataFrame([(3,)], "n long"), part_nodes=3).collect()) == [1, 2, 3, 4, 5, 13, 14]


def test_all_pairs_are_not_broadcast(spark):
    """The repeated side looks as small as its nodes; a broadcast of it would bring every pair to the driver."""
    plan = routing.all_pairs(spark.range(50), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan.split("ShuffledHashJoin")[0] and "ShuffledHashJoin" in plan
