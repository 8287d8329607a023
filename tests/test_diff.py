import itertools
import random

from pyspark.sql import functions as F

from roadweave.operators import diff


def brute(left, right):
    """Least total of differing fields over all pairings of the shorter side."""
    if len(left) > len(right):
        left, right = right, left
    cost = lambda a, b: sum(x != y for x, y in zip(a, b))
    return min(sum(cost(a, b) for a, b in zip(left, p)) for p in itertools.permutations(right, len(left)))


def test_assignment_is_least():
    rng = random.Random(4)
    for _ in range(60):
        a = [tuple(rng.choice("xyz") for _ in range(3)) for _ in range(rng.randint(1, 5))]
        b = [tuple(rng.choice("xyz") for _ in range(3)) for _ in range(rng.randint(1, 5))]
        pairs = diff.pair_leftovers(a, b)
        assert sorted(i for i, _ in pairs if i is not None) == list(range(len(a)))
        assert sorted(j for _, j in pairs if j is not None) == list(range(len(b)))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert len(both) == min(len(a), len(b))
        assert sum(x != y for i, j in both for x, y in zip(a[i], b[j])) == brute(a, b)


def run(spark, left, right):
    schema = "k int, a string, b string, extra string"
    l, r = spark.createDataFrame([(*x, "l") for x in left], schema), spark.createDataFrame([(*x, "r") for x in right], schema)
    out = diff.diff_copies(l, r, "k", {"A": (F.col("a"), F.col("a")), "B": (F.col("b"), F.col("b"))}, ("one", "two"))
    return sorted(((r["k"], r["diff"], r["field"], r["value_left"], r["value_right"], r["n"]) for r in out.collect()), key=str)


def test_cases(spark):
    left = [(1, "x", "y"), (2, "x", None), (3, "p", "q"), (3, "p", "q"), (3, "m", "n"), (4, "only", "left"), (None, "a", "b")]
    right = [(1, "x", "y"), (2, "x", ""), (3, "p", "q"), (3, "m", "N"), (5, "only", "right"), (None, "a", "c")]
    got = run(spark, left, right)
    assert (2, "value", "B", None, "", 1) in got
    assert (3, "value", "B", "n", "N", 1) in got and (3, "only_in_one", "", None, None, 1) in got
    assert (4, "only_in_one", "", None, None, 1) in got and (5, "only_in_two", "", None, None, 1) in got
    assert (None, "value", "B", "b", "c", 1) in got
    assert not any(g[0] == 1 for g in got) and len(got) == 6


def test_empty_and_hot_key(spark):
    assert run(spark, [], []) == []
    assert len(run(spark, [(1, "a", "b")], [])) == 1
    n = 2 * diff.MAX_EXACT + 300  # one key beyond the exact size, every row differs in one field
    left, right = [(7, f"v{i:05}", "l") for i in range(n)], [(7, f"v{i:05}", "r") for i in range(n)]
    assert sum(g[5] for g in run(spark, left, right)) == n


def test_many_copies(spark):
    got = run(spark, [(1, "a", "b")] * 900, [(1, "a", "c")] * 700)
    assert got == [(1, "only_in_one", "", None, None, 200), (1, "value", "B", "b", "c", 700)]


def test_exact_beyond_the_old_block_size():
    left = [(f"l{i}", str(i), "x") for i in range(900)]
    right = [(f"r{i}", str(i), "x") for i in range(900)]
    pairs = diff.pair_leftovers(left, right[450:] + right[:450])
    assert sum(x != y for i, j in pairs for x, y in zip(left[i], (right[450:] + right[:450])[j])) == 900


def test_parts_of_a_large_key(spark):
    """Stages and parts keep every row, and the total meets the bound where rows differ in one or two fields."""
    rng = random.Random(3)
    left = [(7, f"v{i:04}", f"w{i % 50}") for i in range(300)] + [(None, "p", "q"), (None, "p", "q")]
    right = [(7, a, b + "!") if rng.random() < 0.5 else (7, "z" + a, b) for _, a, b in left[:300]] + [(None, "p", "Q"), (None, "R", "q"), (None, "s", "t")]
    rng.shuffle(right)
    schema = "k int, a string, b string"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    fields = {"A": (F.col("a"), F.col("a")), "B": (F.col("b"), F.col("b"))}
    out = diff.diff_copies(l, r, "k", fields, exact_rows=1).cache()
    total = {x["k"]: x["differing"] for x in diff.pairing_total(out, "k").collect()}
    bound = {x["k"]: (x["pairs"], x["least"]) for x in diff.pairing_bound(l, r, "k", fields).collect()}
    assert total[7] == 300 and bound[7] == (300, 300)
    assert total[None] == 2 and bound[None] == (2, 2)
    assert [(x["k"], x["n"]) for x in out.where("diff <> 'value'").collect()] == [(None, 1)]
    whole = diff.diff_copies(l, r, "k", fields)
    assert {x["k"]: x["differing"] for x in diff.pairing_total(whole, "k").collect()} == total


def traps(number):
    """Groups of two rows a side where pairing the two that differ least (1 + 5) isn't the least in all (2 + 2)."""
    left, right = [], []
    for t in range(number):
        x, y = [f"x{t}.{f}" for f in range(5)], [f"y{t}.{f}" for f in range(5)]
        left += [(7, *x), (7, *y[:3], *x[3:])]
        right += [(7, y[0], *x[1:]), (7, *x[:3], *y[3:])]
    return left, right


def test_least_whatever_the_size(spark):
    """One result on either side of MAX_EXACT leftovers and of exact_rows."""
    schema = "k int, a string, b string, c string, d string, e string"
    fields = {c: (F.col(c), F.col(c)) for c in "abcde"}
    for number in (2, diff.MAX_EXACT // 2 + 50):
        l, r = (spark.createDataFrame(x, schema) for x in traps(number))
        out = diff.diff_copies(l, r, "k", fields)
        assert [tuple(x) for x in diff.pairing_total(out, "k").collect()] == [(7, 4 * number)]
    rng = random.Random(5)
    row = lambda k: (k, *[rng.choice(["p", "q", "", None]) for _ in range(5)])
    left, right = [[row(k) for k in (1, 1, 1, None) for _ in range(n)] for n in (20, 25)]
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    whole, small = (sorted(map(tuple, diff.diff_copies(l, r, "k", fields, exact_rows=n).collect()), key=str) for n in (diff.MAX_EXACT, 0))
    assert whole == small and sum(x[5] for x in whole if x[1] == "only_in_right") == 20


def test_partners_found_either_way():
    """Comparing pairs and trying all sets of fields give the same pairs, the least by brute force."""
    rng = random.Random(6)
    for _ in range(40):
        a, b = ([tuple(rng.choice("xyz") for _ in range(4)) for _ in range(rng.randint(1, 6))] for _ in range(2))
        pairs = diff.pair_leftovers(a, b)
        assert pairs == diff.pair_leftovers(a, b, most=0)
        assert sum(x != y for i, j in pairs if i is not None and j is not None for x, y in zip(a[i], b[j])) == brute(a, b)
