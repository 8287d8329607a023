import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import codes, geo
from roadweave.operators import demand, od, quality, stations
from roadweave.runtime import Scratch, grouped_rank, latest_by
from roadweave.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_codes(spark):
    lit = F.lit
    assert one(spark, codes.normal_code(lit(" 9624.0 "))) == "009624" and one(spark, codes.normal_code(lit("1234567"))) == "1234567" and one(spark, codes.normal_code(lit(""))) is None
    assert [one(spark, codes.osm_id(lit(x))) for x in ("12", "way/12", "w12", "x/", "1-2")] == [12, 12, 12, None, None]
    assert one(spark, codes.finite(lit("inf"))) is None and one(spark, codes.positive(lit("-1"))) is None and one(spark, codes.bounded_code(lit("7"))) is None
    assert one(spark, codes.split_list(lit("a | b||c"))) == ["a", "b", "c"]
    assert one(spark, codes.ref_matches(lit("SS 13"), lit("A4; ss13"))) and not one(spark, codes.ref_matches(lit("SS13"), lit(None).cast("string")))
    assert one(spark, codes.fold_name(lit("  Šan  Vìto "))) == "san vito"
    tags = F.create_map(lit("restriction"), lit("a"), lit("restriction:motorcar"), lit("b"))
    assert one(spark, codes.first_tag(tags, "restriction:motorcar", "restriction")) == "b"
    assert one(spark, codes.tokens_overlap(lit("Bus; motorcar"), ["motorcar"]))
    assert math.isinf(one(spark, codes.half_life(lit(0.0)))) and one(spark, codes.percent_delta(lit(3.0), lit(2.0))) == 50.0 and one(spark, codes.percent_delta(lit(3.0), lit(0.0))) is None
    assert [one(spark, codes.direction_code(lit(o).cast("string"), lit(j).cast("string"), lit(h))) for o, j, h in (("yes", None, "primary"), ("-1", None, "primary"), (None, "roundabout", "primary"), (None, None, "motorway"), (None, None, "primary"), ("reversible", None, "x"))] == [1, -1, 1, 1, 0, None]


def test_utm_known_point(spark):
    e, n = geo.utm(F.lit(9.0), F.lit(45.0))  # on the central meridian
    assert abs(one(spark, e) - 500000.0) < 1e-6 and abs(one(spark, n) - 4982950.400) < 0.01


def test_delimited_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿OR_PROCOM;TEP_TOT ;NOTE\n009624; 16,96 ;\"x;y\"\n000001;;z\n".encode())
    df = files.read_delimited(spark, str(p), decimal_comma=("TEP_TOT",), provenance="file")
    rows = df.orderBy("OR_PROCOM").collect()
    assert df.columns == ["OR_PROCOM", "TEP_TOT", "NOTE", "file"] and rows[1]["OR_PROCOM"] == "009624" and rows[1]["TEP_TOT"] == 16.96 and rows[1]["NOTE"] == "x;y" and rows[0]["TEP_TOT"] is None
    assert rows[0]["file"].endswith("a.csv")
    assert files.resolve_column(["Pro Com", "x"], ["PRO_COM"], "code") == "Pro Com"
    with pytest.raises(ValueError):
        files.resolve_column(["a", "A "], ["a"], "twice")
    assert files.first_column(["ID", "b"], ["id"], "id") == "ID"
    with pytest.raises(ValueError):
        files.require_columns(df, "missing")
    (tmp_path / "b.csv").write_text("a;a\n1;2\n")
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(tmp_path / "b.csv"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, o string")
    files.write_shards(df, str(tmp_path / "s"), "o")
    files.write_shards(df.where("o = 'b'").withColumn("k", F.lit(9)), str(tmp_path / "s"), "o")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r["k"], r["o"]) for r in back.collect()} == {(1, "a"), (3, "a"), (9, "b")}
    assert files.not_done(df, back, ["k"]).count() == 1
    up = files.upsert(df, spark.createDataFrame([(1, "z"), (7, "n")], "k int, o string"), ["k"])
    assert {tuple(r) for r in up.collect()} == {(1, "z"), (2, "b"), (3, "a"), (7, "n")}
    assert files.content_hash(df).collect() == files.content_hash(df.orderBy(F.desc("k")).repartition(3)).collect()
    files.write_csv(df, str(tmp_path / "c"), ["k"], exclusive=True)
    with pytest.raises(Exception):
        files.write_csv(df, str(tmp_path / "c"), ["k"], exclusive=True)


def test_rank_and_latest(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    got = {r["i"]: r["n"] for r in grouped_rank(df, ["g"], ["x", "i"], "n", Scratch(spark, "t")).collect()}
    for g in "abc":
        for k, (_, i) in enumerate(sorted((x, i) for h, x, i in rows if h == g)):
            assert got[i] == k
    t = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, None, "z"), (2, None, "n")], "k int, o int, v string")
    assert {tuple(r) for r in latest_by(t, ["k"], "o", ["v"]).collect()} == {(1, "b"), (2, "n")}


def test_one_to_one_join_refuses_repeats(spark):
    l, r = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception):
        od.join_one_to_one(l, r, ["k"]).collect()
    assert {(x["k"], x["matched"]) for x in od.join_one_to_one(l, r.limit(1), ["k"]).collect()} == {(1, True), (2, False)}


def model(spark):
    rng = random.Random(2)
    pairs = [(o, d, (o + 1) / 15, (d + 1) / 15, float(5 + (o * 7 + d * 3) % 20)) for o in range(5) for d in range(5) if o != d]
    shares = [(s, o, d, rng.choice([0.3, 1.0])) for s in range(3) for o, d, *_ in pairs if (o + d + s) % 3 == 0]
    obs = [(s, 100.0 + 10 * s, 20.0) for s in range(3)]
    return pairs, shares, obs, (spark.createDataFrame(pairs, "o int, d int, p double, a double, c double"), spark.createDataFrame(shares, "section int, o int, d int, share double"), spark.createDataFrame(obs, "section int, y double, base double"))


def plain_profile(pairs, shares, obs, n, beta, constrained=False):
    w = {(o, d): (1 if constrained else p) * a * c**n * math.exp(-beta * c) for o, d, p, a, c in pairs}
    p_of = {o: p for o, _, p, _, _ in pairs}
    down = lambda o: sum(v for (x, _), v in w.items() if x == o or not constrained)
    g = {s: sum(sh * w[o, d] / down(o) * (p_of[o] if constrained else 1) for t, o, d, sh in shares if t == s) for s, *_ in obs}
    q = max(0.0, sum(g[s] * (y - b) for s, y, b in obs) / sum(g[s] ** 2 for s, *_ in obs))
    return q, sum((y - b - q * g[s]) ** 2 for s, y, b in obs)


@pytest.mark.parametrize("constrained", [False, True])
def test_profile_against_formula(spark, constrained):
    pairs, shares, obs, dfs = model(spark)
    grid = [(0.0, 0.01), (0.0, 0.08), (1.2, 0.05)]
    for r in demand.profile(*dfs, grid, constrained=constrained).collect():
        q, j = plain_profile(pairs, shares, obs, r["n"], r["beta"], constrained)
        assert math.isclose(r["q"], q, rel_tol=1e-9) and math.isclose(r["j"], j, rel_tol=1e-6, abs_tol=1e-6)


def test_refinement_and_identifiability(spark):
    pairs, shares, obs, dfs = model(spark)
    b, q, j = demand.refine(*dfs, 0.0, 0.2, rounds=5)
    x, v = demand.golden_section(lambda t: plain_profile(pairs, shares, obs, 0.0, t)[1], 0.0, 0.2)
    assert j <= v + 1e-3
    eps = 1e-6
    s = {r["section"]: r for r in demand.sensitivities(dfs[0], dfs[1], 0.05, 100.0).collect()}
    hi = {r["section"]: r["value"] for r in demand.sensitivities(dfs[0], dfs[1], 0.05 + eps, 100.0).collect()}
    for k, r in s.items():
        assert math.isclose((hi[k] - r["value"]) / eps, r["d_beta"], rel_tol=1e-3, abs_tol=1e-3)
    i = demand.identifiability(np.array([[1.0, 0.0], [0.0, 2.0]]))
    assert i["rank"] == 2 and i["condition"] == 2.0 and i["cosine"] == 0.0
    h = demand.hessian(lambda x, y: x * x + 3 * x * y + 2 * y * y, 1.0, 1.0, 0.1, 0.1) / 0.01
    assert np.allclose(h, [[2, 3], [3, 4]])


def test_balanced_and_minima(spark):
    pairs, _, _, dfs = model(spark)
    t = demand.balance(dfs[0], 60, 0.05).groupBy("o").agg(F.sum("f").alias("f"), F.first("p").alias("p")).collect()
    assert all(math.isclose(r["f"], r["p"], rel_tol=1e-9) for r in t)
    grid = spark.createDataFrame([(i, k, float((i - 2) ** 2 + (k - 3) ** 2)) for i in range(6) for k in range(6)], "i int, k int, j double")
    assert [(r["i"], r["k"]) for r in demand.surface_minima(grid, "i", "k", "j").collect()] == [(2, 3)]


def test_gates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, -1.0), (2, None)], "k int, x double")
    g = quality.report(quality.violations(df, {"negative": F.col("x") < 0}), quality.unique_gate(df, ["k"], "unique"), quality.conservation_gate(df, df, "x", "total"), quality.dense_gate(spark.range(3), "id", "dense"), quality.regression_gate(df, df.limit(1), ["k"], "x", "frozen", 1e-9))
    assert {r["check"]: r["status"] for r in g.collect()} == {"negative": "CHECK_REQUIRED", "unique": "CHECK_REQUIRED", "total": "PASS", "dense": "PASS", "frozen": "CHECK_REQUIRED"}
    assert quality.verdict(g).first()["verdict"] == "CHECK_REQUIRED"


def test_station_match(spark):
    s = spark.createDataFrame([("A", "SS1", 0.0, 0.0), ("B", "SS9", 0.0, 0.0), ("C", "SS1", 9e5, 9e5)], "section_id string, road string, x double, y double")
    g = spark.createDataFrame([("near", "SP2", -10.0, 20.0, 10.0, 20.0), ("ref", "SS1", -600.0, 200.0, 600.0, 200.0)], "segment_uid string, ref string, x_u double, y_u double, x_v double, y_v double")
    got = {r["section_id"]: (r["segment_uid"], r["distance"], r["status"]) for r in stations.match_segments(s, g).collect()}
    assert got == {"A": ("ref", 200.0, "REF_CONFIRMED"), "B": ("near", 20.0, "NEAREST_ONLY_REF_NOT_CONFIRMED")}
