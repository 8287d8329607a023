import random

import pytest

from roadweave.llm import mixing, packing
from roadweave.llm.tokens import DEFAULT_TOKENIZER, encoding


def test_plan_uses_everything_once():
    rng = random.Random(8)
    for _ in range(40):
        cap = rng.choice([10, 64, 2048])
        counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        used: dict = {}
        for times, filling in packing.plan_containers(counts, cap):
            assert times >= 1 and sum(s * k for s, k in filling) <= cap
            for s, k in filling:
                used[s] = used.get(s, 0) + times * k
        assert used == counts


def test_complete_is_least_waste():
    rng = random.Random(9)
    for _ in range(150):
        room = rng.randint(5, 40)
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        sums = {0}
        for s, k in counts.items():
            sums = {x + s * j for x in sums for j in range(k + 1) if x + s * j <= room}
        got = packing.complete(room, counts, sorted(counts, reverse=True))
        assert all(k <= counts[s] for s, k in got) and sum(s * k for s, k in got) == max(sums)


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc long, text string, source string, piece int")


def test_pack(spark):
    enc = encoding(DEFAULT_TOKENIZER)
    rows = [(i, "word " * n, "a", 0) for i, n in enumerate([1, 3, 9, 30, 30, 30, 31, 64, 200])] + [(50, None, "a", 0), (51, "", "a", 0), (52, "hello", None, 0), (52, "hello", None, 0)]
    out = packing.pack(texts(spark, rows), "doc", "text", 64).collect()
    sizes = {}
    for r in out:
        if r["container_id"] is not None:
            sizes[r["container_id"]] = sizes.get(r["container_id"], 0) + r["n_tokens"]
    assert max(sizes.values()) <= 64 and sorted(sizes) == list(range(len(sizes)))
    per = {}
    for r in out:
        per.setdefault(r["doc"], []).append((r["first_token"], r["n_tokens"]))
    for doc, text, _, _ in rows:
        n = len(enc.encode_ordinary(text or ""))
        copies = sum(1 for r in rows if r[0] == doc)
        assert sum(k for _, k in per[doc]) == n * copies
        if n <= 64:
            assert len(per[doc]) == copies  # never split
    assert packing.pack(texts(spark, []), "doc", "text", 64).count() == 0
    assert packing.pack(texts(spark, rows), "doc", "text", 64).orderBy("doc", "piece", "container_id").collect() == sorted(out, key=lambda r: (r["doc"], r["piece"], r["container_id"] is not None, r["container_id"] or 0))


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i} " + "word " * rng.randint(1, 40), s, 0) for i, s in enumerate(["big"] * 400 + ["mid"] * 80 + ["few"] * 12 + ["none"] * 5)]
    rows += [(900, rows[3][1], "few", 0), (901, None, "big", 0), (902, "", "few", 0), (903, "x y", None, 0)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.25, 2), ("few", 0.15, 4)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mix(texts(spark, rows), targets, "doc", "text", "source")
    limit = {"big": 1, "mid": 2, "few": 4}
    uses: dict = {}
    for r in copies.collect():
        uses[(r["source"], r["doc"])] = uses.get((r["source"], r["doc"]), 0) + 1
    assert all(n <= limit[s] for (s, _), n in uses.items()) and not any(d in (900, 901, 902, 903) for _, d in uses)
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == set(limit) and abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9
    for s, share in (("big", 0.6), ("mid", 0.25), ("few", 0.15)):
        assert abs(got[s]["actual_share"] - share) < 0.02
    again, _ = mixing.mix(texts(spark, rows[::-1]), targets, "doc", "text", "source")
    assert sorted(again.collect()) == sorted(copies.collect())


def test_mix_refuses(spark):
    t = lambda *r: spark.createDataFrame(list(r), "source string, target_share double, max_repeats int")
    docs = texts(spark, [(1, "a b", "x", 0)])
    with pytest.raises(ValueError):
        mixing.mix(docs, t(("x", 0.5, 1)), "doc", "text", "source")
    with pytest.raises(ValueError):
        mixing.mix(docs, t(("x", 0.5, 1), ("y", 0.5, 1)), "doc", "text", "source")


def least_number(items, capacity):
    """Fewest containers, by dynamic programming over all subsets."""
    best = [None] * (1 << len(items))
    best[0] = (1, 0)
    for m, state in enumerate(best):
        for i, s in enumerate(items):
            if not m >> i & 1:
                one = (state[0], state[1] + s) if state[1] + s <= capacity else (state[0] + 1, s)
                if best[m | 1 << i] is None or one < best[m | 1 << i]:
                    best[m | 1 << i] = one
    return best[-1][0]


def test_small_cases_are_least():
    rng = random.Random(12)
    cases = [([18, 15, 13, 13, 8, 7, 7, 5, 4], 30)]
    for _ in range(3000):
        cap = rng.randint(8, 40)
        cases.append(([rng.randint(rng.choice([1, cap // 6 + 1]), rng.choice([cap // 2, cap])) for _ in range(rng.randint(1, 8))], cap))
    for items, cap in cases:
        counts = {s: items.count(s) for s in items}
        p = packing.plan(counts, cap)
        assert p.containers == least_number(items, cap) and p.proven and p.bound <= p.containers, (items, cap)
        used: dict = {}
        for times, filling in p.fillings:
            assert sum(s * k for s, k in filling) <= cap
            for s, k in filling:
                used[s] = used.get(s, 0) + times * k
        assert used == counts


def test_report_states_the_gap(spark):
    rows = [(i, "word " * 40, "a", 0) for i in range(5)]
    r = packing.report(texts(spark, rows), "doc", "text", 64).first()
    assert (r["containers"], r["bound"], r["gap"], r["proven"]) == (5, 5, 0, True)
    assert packing.plan({40: 5, 23: 3}, 64, budget=1).containers == 5


def test_best_fit_at_any_number_of_items():
    """Best fit for all containers of a room at once needs as many as item by item, and is tried whatever the number of items."""
    from bisect import bisect_left, insort

    import roadweave.llm.packing as p

    rng = random.Random(31)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        counts = {s: rng.randint(1, 9) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
        rooms: list[int] = []
        n = 0
        for s in sorted((s for s, k in counts.items() for _ in range(k)), reverse=True):
            at = bisect_left(rooms, s)
            n += at == len(rooms)
            insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - s)
        got = p._best_fit(counts, capacity)
        assert sum(t for t, _ in got) == n
        assert all(sum(s * k for s, k in f) <= capacity for _, f in got)
        assert {s: sum(t * k for t, f in got for x, k in f if x == s) for s in counts} == counts
    tried = []
    old, p._best_fit = p._best_fit, lambda *a: tried.append(1) or old(*a)
    try:
        p.plan({6: 5, 5: 5, 3: 7, 2: 1}, 10, 3)  # more items than search nodes
        assert not tried or len(tried) == 1
        p.plan({6: 10, 4: 3, 3: 19}, 10, 1)
    finally:
        p._best_fit = old
    assert tried
