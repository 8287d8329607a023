import os
import random
import signal
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from roadweave.llm import components as cp  # noqa: E402


def run(spark, rows, **kw):
    df = spark.createDataFrame([(u, v, "x") for u, v in rows], "u long, v long, label string")
    return {r["node_id"]: (r["wcc_rep"], r["scc_rep"]) for r in cp.components(df, **kw).collect()}


def test_tarjan_against_search():
    rng = random.Random(3)
    for _ in range(100):
        n = rng.randint(2, 12)
        arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 25))]
        want = {k: s for k, (_, s) in brute.components(arcs).items()}
        got = cp._tarjan([a for a, b in arcs if a != b], [b for a, b in arcs if a != b])
        sizes = {s: sum(x == s for x in want.values()) for s in want.values()}
        assert got == {k: s for k, s in want.items() if sizes[s] > 1}


def test_fixture(spark):
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (5, None), (None, 6), (None, None), (7, 7), (9, 8), (8, 9), (9, 8), (10, 9)]
    assert run(spark, rows) == brute.components(rows)
    assert run(spark, []) == {}


@pytest.mark.parametrize("finish", [cp.FINISH_ARCS, 0])
def test_random_graph(spark, finish):
    rng = random.Random(11)
    rows = [(i, i + 1) for i in range(40)] + [(40, 0)]  # a one-way ring
    rows += [(100 + i, 101 + i) for i in range(30)] + [(500, x) for x in range(100, 130)]  # a chain and a hub
    rows += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(90)]
    assert run(spark, rows, finish_arcs=finish) == brute.components(rows)


def test_stalled_core(spark):
    """Every node has two ways out and two in, none of them two-way, so only cycles can be merged."""
    n = 15
    rows = [(i, (i + k) % n) for i in range(n) for k in (1, 3)] + [(100 + i, 100 + (i + k) % n) for i in range(n) for k in (1, 3)] + [(3, 104)]
    assert run(spark, rows, finish_arcs=0) == brute.components(rows)


def test_layered_rest_ends(spark):
    """An acyclic rest of many layers shrinks by under 2% a round and holds no cycle to merge."""
    signal.signal(signal.SIGALRM, lambda *_: pytest.fail("doesn't end"))
    signal.alarm(600)
    try:
        layers = 250
        rows = [(8 * k + i, 8 * k + 8 + (i + j) % 4) for k in range(layers) for i in range(4) for j in (0, 1)]
        rows += [(9000 + i, 9000 + (i + j) % 15) for i in range(15) for j in (1, 3)] + [(8 * 100 + 1, 9003), (9007, 8 * 140 + 2)]
        assert run(spark, rows, finish_arcs=0) == brute.components(rows)
    finally:
        signal.alarm(0)
