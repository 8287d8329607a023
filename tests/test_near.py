import math
import random

from roadweave.operators import near


def sphere(a, b):
    la, oa, lb, ob = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 2 * near.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def check(spark, left, right, radius):
    l = spark.createDataFrame([(i, *p, 1) for i, p in left], "a long, lat double, lon double, b int")
    r = spark.createDataFrame([(i, *p, 1) for i, p in right], "b long, lat double, lon double, a int")
    got = {(x["p"], x["q"]) for x in near.near_pairs(l.withColumnRenamed("a", "p"), r.withColumnRenamed("b", "q"), "p", "q", ("lat", "lon"), ("lat", "lon"), radius).collect()}
    ok = lambda p: all(v is not None and math.isfinite(v) for v in p)
    want = {(i, j) for i, p in left for j, q in right if i is not None and j is not None and ok(p) and ok(q) and sphere(p, q) <= radius}
    assert got == want
    return got


def test_random_poles_and_seam(spark):
    rng = random.Random(1)
    spots = [(46.5, 13.5), (89.999, 0.0), (-90.0, 10.0), (0.0, 179.9995), (0.0, -179.9995), (464.2, 13.9)]
    pts = lambda n: [(i, (s[0] + rng.gauss(0, 0.002), s[1] + rng.gauss(0, 0.002))) for i in range(n) for s in [rng.choice(spots)]]
    assert len(check(spark, pts(120), pts(150), 150.0)) > 50
    check(spark, pts(40), pts(40), 30_000.0)
    check(spark, pts(30), pts(30), 0.0)


def test_odd_rows(spark):
    same = (46.5, 13.5)
    left = [(1, same), (1, same), (2, (None, 13.5)), (3, (float("nan"), 1.0)), (None, same), (4, (0.0, 0.0)), (1, (46.6, 13.6))]
    right = [(9, same), (9, same), (8, (46.6, 13.6)), (7, (None, None)), (6, (float("inf"), 0.0))]
    assert check(spark, left, right, 150.0) == {(1, 9), (1, 8)}
    assert check(spark, [], right, 150.0) == set()


def test_regions(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    far = [(100.0, 100.0), (101.0, 100.0), (100.0, 101.0), (100.0, 100.0)]
    regions = spark.createDataFrame([("s", square), ("f", far), ("bad", [(0.0, 0.0)])], "r string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 11.0, 5.0), (3, 13.0, 5.0), (4, None, 1.0), (5, 100.2, 100.2), (6, -1.0, -1.0)], "p int, px double, py double")
    got = {tuple(x) for x in near.in_regions(points, regions, "p", "r", "px", "py", "ring", buffer=2.0).collect()}
    assert got == {(1, "s"), (2, "s"), (5, "f"), (6, "s")}
