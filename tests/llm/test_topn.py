import math
import random
import struct

from pyspark.sql import functions as F

from roadweave.llm import topn

ODD = [0.0, -0.0, 1.0, -1.0, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1 / 3, 1024.0, 1023.9999999999999, 3e-310]


def test_code_is_the_bit_pattern(spark):
    rng = random.Random(2)
    xs = ODD + [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    xs = [x for x in xs if not math.isnan(x)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(topn.score_code(F.col("x"))).collect()]
    bits = lambda x: struct.unpack("q", struct.pack("d", abs(x)))[0] * (-1 if x < 0 else 1)
    assert got == [bits(x) for x in xs]
    assert spark.createDataFrame([(None,), (math.nan,)], "x double").select(topn.score_code(F.col("x")).alias("c")).where("c is not null").count() == 0


def want(rows, n, ascending=True):
    best = {}
    for g, i, s in rows:
        if i is None or s is None or math.isnan(s):
            continue
        k = (g, i)
        best[k] = s if k not in best else (min if ascending else max)(best[k], s)
    out = {}
    for (g, i), s in best.items():
        out.setdefault(g, []).append((s if ascending else -s, i))
    return {(g, r, i) for g, xs in out.items() for r, (_, i) in enumerate(sorted(xs)[:n], 1)}


def check(spark, rows, n, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, i long, s double, lo string")
    got = {(r["g"], r["rank"], r["i"]) for r in topn.top_n(df, ["g"], "s", "i", n, **kw).collect()}
    assert got == want(rows, n, kw.get("ascending", True))


def test_random_ties_and_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", i, rng.choice([1.5, 2.5, rng.random() * 10])) for i in range(3000)]
    rows += [("ties", i, 7.0) for i in range(500)] + [("big", -(2**63) + i, 1.0) for i in range(20)] + [("big", 2**63 - 1 - i, 1.0) for i in range(20)]
    rows += [(f"g{k}", i, rng.choice(ODD + [math.nan, None])) for k in range(60) for i in range(rng.randint(1, 12))]
    rows += [(None, 4, 2.0), (None, None, 1.0), ("hot", 5, -3.0), ("hot", 5, -3.0), ("nan", 1, math.nan)]
    rng.shuffle(rows)
    check(spark, rows, 5)
    check(spark, rows, 3, ascending=False)


def test_empty(spark):
    check(spark, [], 5)
    check(spark, [("a", 1, None)], 1)
