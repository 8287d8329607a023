import itertools
import random

from roadweave.operators import restrictions as rs


def world(rng):
    """Ways over few nodes (some ways meet a node twice) and their directed edges, some left out."""
    ways = {w: [rng.randrange(14) for _ in range(rng.randint(2, 6))] for w in range(1, 12)}
    ways[12] = list(range(14))
    edges, n = [], 100000
    for w, nodes in ways.items():
        for i, (a, b) in enumerate(zip(nodes, nodes[1:])):
            for u, v, way in ((a, b, "FORWARD"), (b, a, "BACKWARD")):
                if rng.random() < 0.85:
                    n += 1
                    edges.append((n, w, i, u, v, way))
    return ways, edges


def paths_on(ways, edges, way, start, end):
    """Edge sequences along a way, read off its node list."""
    look = {(w, i, way_): e for e, w, i, _, _, way_ in edges}
    nodes, out = ways[way], set()
    for i, a in enumerate(nodes):
        for j, b in enumerate(nodes):
            if i != j and a == start and b == end:
                steps = [(way, k, "FORWARD") for k in range(i, j)] if i < j else [(way, k, "BACKWARD") for k in range(i - 1, j - 1, -1)]
                if all(x in look for x in steps):
                    out.add(tuple(look[x] for x in steps))
    return out


def compiled(ways, edges, value, via_class, node, chain):
    kind = "NO_SEQUENCE" if (value or "").startswith("no_") else "ONLY_SEQUENCE" if (value or "").startswith("only_") else "UNSUPPORTED"
    if kind == "UNSUPPORTED":
        return "UNSUPPORTED_RESTRICTION_VALUE", set()
    into = lambda w, n: [e for e, x, _, _, v, _ in edges if x == w and v == n]
    out = lambda w, n: [e for e, x, _, u, _, _ in edges if x == w and u == n]
    if via_class == "VIA_NODE":
        found = set(itertools.product(into(chain[0], node), out(chain[-1], node)))
    elif via_class != "VIA_WAY":
        return "UNSUPPORTED_VIA_CLASS", set()
    else:
        joints = [sorted(set(ways[a]) & set(ways[b])) for a, b in zip(chain, chain[1:])]
        if not all(joints):
            return "NO_SHARED_NODE", set()
        combos = list(itertools.product(*joints))
        if len(combos) > rs.MOST_COMBINATIONS:
            return "AMBIGUOUS_CONNECTIONS", set()
        found = set()
        for at in combos:
            options = [paths_on(ways, edges, w, a, b) for w, a, b in zip(chain[1:-1], at, at[1:])]
            if any(len(o) > rs.MOST_VARIANTS for o in options):
                return "AMBIGUOUS_VIA_WAY_PATH", set()
            for a, b in itertools.product(into(chain[0], at[0]), out(chain[-1], at[-1])):
                found |= {(a, *sum(mid, ()), b) for mid in itertools.product(*options)} if all(options) else set()
    return ("COMPILED" if found else "NO_ROUTABLE_SEQUENCE"), found


def test_compiler_against_brute_force(spark):
    rng = random.Random(6)
    ways, edges = world(rng)
    relations = []
    for i in range(120):
        via = rng.choice(["VIA_NODE", "VIA_WAY", "VIA_WAY", "VIA_WAY", "NO_VIA"])
        chain = [rng.randint(1, 11) for _ in range(2 if via != "VIA_WAY" else rng.randint(3, 5))]
        if i % 17 == 0 and via == "VIA_WAY":
            chain = [12, 12, 12, 12]
        relations.append((i, rng.choice(["no_left_turn", "only_straight_on", "no_u_turn", "maybe", None]), via, rng.randrange(14) if via == "VIA_NODE" else None, chain))
    r = spark.createDataFrame(relations, "relation_id long, restriction_value string, via_class string, via_node long, ways array<long>")
    n = spark.createDataFrame([(w, i, x) for w, nodes in ways.items() for i, x in enumerate(nodes)], "way_id long, seq int, node_id long")
    e = spark.createDataFrame(edges, "edge_id long, way_id long, seq int, u long, v long, way_direction string")
    sequences, summary = rs.compile_relations(r, n, e)
    got: dict = {}
    for x in sequences.collect():
        got.setdefault(x["relation_id"], []).append(tuple(x["seq"]))
    status = {x["relation_id"]: (x["compile_status"], x["sequences"]) for x in summary.collect()}
    seen = set()
    for i, value, via, node, chain in relations:
        want, found = compiled(ways, edges, value, via, node, chain)
        seen.add(want)
        assert status[i] == (want, len(found)), (i, via, chain)
        assert sorted(got.get(i, [])) == sorted(found)
    assert {"COMPILED", "NO_SHARED_NODE", "AMBIGUOUS_CONNECTIONS", "NO_ROUTABLE_SEQUENCE", "UNSUPPORTED_VIA_CLASS", "UNSUPPORTED_RESTRICTION_VALUE"} <= seen
    assert rs.compile_relations(r.limit(0), n, e)[1].count() == 0


def test_a_long_via_way_is_not_cut(spark):
    n = 80
    nodes = spark.createDataFrame([(2, i, i) for i in range(n)] + [(1, 0, 900), (1, 1, 0), (3, 0, n - 1), (3, 1, 901)], "way_id long, seq int, node_id long")
    edges = spark.createDataFrame([(1000 + i, 2, i, i, i + 1, "FORWARD") for i in range(n - 1)] + [(1, 1, 0, 900, 0, "FORWARD"), (3, 3, 0, n - 1, 901, "FORWARD")], "edge_id long, way_id long, seq int, u long, v long, way_direction string")
    r = spark.createDataFrame([(7, "no_left_turn", "VIA_WAY", None, [1, 2, 3])], "relation_id long, restriction_value string, via_class string, via_node long, ways array<long>")
    seq = rs.compile_relations(r, nodes, edges)[0].first()["seq"]
    assert seq == [1, *range(1000, 1000 + n - 1), 3]
