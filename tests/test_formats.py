import hashlib
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import codes
from roadweave.operators import access, demand, misc
from roadweave.sources import files, formats


def test_sqlite_reads_odd_tables(spark, tmp_path):
    at = f"{tmp_path}/x.sqlite"
    with sqlite3.connect(at) as c:
        c.execute('create table "a b" (id integer, v real, t text, "select" blob)')
        c.executemany('insert into "a b" values (?, ?, ?, ?)', [(i, i / 2, f"t{i}", b"z") for i in range(25)] + [(None, "word", 7, None), (2**60, None, "", b"")])
        c.execute("create table none (id integer, t text)")
        c.execute('create view v as select id from "a b" where id < 3')
    assert formats.sqlite_schema(at)["a b"] == {"id": "bigint", "v": "double", "t": "string", "select": "binary"}
    rows = formats.read_sqlite(spark, at, "a b", range_rows=4).collect()
    assert len(rows) == 27 and sum(r["id"] or 0 for r in rows) == sum(range(25)) + 2**60
    assert [tuple(r)[:3] for r in rows if r["id"] is None] == [(None, None, "7")]
    assert formats.read_sqlite(spark, at, "none").count() == 0
    assert sorted(r[0] for r in formats.read_sqlite(spark, at, "v", ["id"]).collect()) == [0, 1, 2]
    assert formats.find_database([at], {"id", "v"}) == (at, "a b")
    (tmp_path / "no.sqlite").write_bytes(b"not a database at all, but long enough to be one" * 40)
    with pytest.raises(ValueError):
        formats.find_database([str(tmp_path / "no.sqlite"), at], {"nothing"})


def test_sqlite_write_modes(spark, tmp_path):
    at = f"{tmp_path}/w.sqlite"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, s string")
    assert formats.write_sqlite(rows((1, "a"), (2, None)), at, "t", ["k"]) == 2
    assert formats.write_sqlite(rows((2, "b"), (3, "c")), at, "t", ["k"], "ignore") == 3
    assert formats.write_sqlite(rows((3, "d")), at, "t", ["k"]) == 3
    assert sorted(map(tuple, formats.read_sqlite(spark, at, "t").collect())) == [(1, "a"), (2, None), (3, "d")]


def test_arrays_and_sparse(spark, tmp_path):
    m = np.arange(12).reshape(4, 3)
    np.save(f"{tmp_path}/m.npy", m)
    got = {(r["i"], r["k"]): r["value"] for r in formats.read_array(spark, f"{tmp_path}/m.npy", range_rows=3).collect()}
    assert got == {(i, k): int(m[i, k]) for i in range(4) for k in range(3)}
    np.save(f"{tmp_path}/none.npy", np.array([], dtype=float))
    assert formats.read_array(spark, f"{tmp_path}/none.npy").count() == 0
    with pytest.raises(ValueError):
        np.save(f"{tmp_path}/t.npy", np.array(["a"]))
        formats.read_array(spark, f"{tmp_path}/t.npy")
    formats.write_csr(spark.createDataFrame([(0, 1, 2.0), (3, 0, 1.5), (3, 0, 0.5)], "i long, k long, value double"), f"{tmp_path}/s.npz", 5, 2)
    assert sorted(map(tuple, formats.read_csr(spark, f"{tmp_path}/s.npz").collect())) == [(0, 1, 2.0), (3, 0, 2.0)]


def test_copies_hashes_and_atomic_files(spark, tmp_path):
    src = tmp_path / "src" / "deep"
    src.mkdir(parents=True)
    (src / "a.bin").write_bytes(b"abc")
    got = formats.copy_verified(str(tmp_path / "src"), str(tmp_path / "dst"))
    assert got == {"deep/a.bin": hashlib.sha256(b"abc").hexdigest()} and (tmp_path / "dst" / "deep" / "a.bin").read_bytes() == b"abc"
    with pytest.raises(FileExistsError):
        formats.copy_verified(str(tmp_path / "src"), str(tmp_path / "dst"))
    assert not (tmp_path / "dst.staged").exists()
    assert [tuple(r) for r in formats.file_hash(spark, f"file://{src}").collect()] == [("a.bin", 3, got["deep/a.bin"])]
    formats.atomic_write(str(tmp_path / "f"), b"1")
    formats.atomic_write(str(tmp_path / "f"), b"2")
    assert (tmp_path / "f").read_bytes() == b"2" and not (tmp_path / "f.part").exists()
    with pytest.raises(FileExistsError):
        formats.atomic_write(str(tmp_path / "f"), b"3", exclusive=True)


def test_shards_resume(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    s = formats.Shards(spark, f"file://{tmp_path}/s", "v1")
    assert s.done() == set()
    s.write("a", df)
    s.write("b", df.limit(1))
    assert s.done(verify=True) == {"a", "b"} and formats.Shards(spark, f"file://{tmp_path}/s", "v2").done() == set()
    df.unionAll(df).write.mode("overwrite").parquet(f"file://{tmp_path}/s/b")  # changed behind the manifest
    assert s.done(verify=True) == {"a"} and s.merged().count() == 6
    lengths = spark.createDataFrame([(3, 5), (1, 2), (2, 0)], "p int, n long")
    assert {r["p"]: r["offset"] for r in formats.rebased(lengths, ["p"], "n").collect()} == {1: 0, 2: 2, 3: 2}


def test_reload_and_fallback(spark, tmp_path):
    (tmp_path / "f.csv").write_text("﻿a;b\n1;x\n2;y\n", encoding="utf-8")
    got = files.read_delimited(spark, f"file://{tmp_path}/f.csv", sep=",", types={"a": "int"})
    assert got.columns == ["a", "b"] and got.count() == 2
    assert files.reload(got, ["a"], 2).count() == 2
    for keys, n in ((["a"], 3), (["zz"], None)):
        with pytest.raises(ValueError):
            files.reload(got, keys, n)
    with pytest.raises(ValueError):
        files.reload(got.unionAll(got), ["a"])


def test_small_operators_on_odd_rows(spark):
    t = spark.createDataFrame([(1, "b"), (2, None), (3, "b"), (4, "a")], "i int, k string")
    index = misc.dense_index(t, "k")
    assert {r["k"]: r["idx"] for r in index.collect()} == {"a": 0, "b": 1}
    assert sorted((r["i"], r["k"]) for r in misc.encode(t, ["k"], index, "k").collect()) == [(1, 1), (2, None), (3, 1), (4, 0)]
    with pytest.raises(Exception):
        misc.encode(t, ["k"], index.where("k = 'a'"), "k").collect()
    assert misc.dense_index(t.limit(0), "k").count() == 0
    ring = spark.createDataFrame([("t", [(1e7, 0.0), (1e7 + 3, 0.0), (1e7, 3.0)]), ("flat", [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0)])], "r string, ring array<struct<x:double,y:double>>")
    got = {r["r"]: (round(r["cx"], 6), round(r["cy"], 6), round(r["area"], 6)) for r in misc.ring_centroid(ring, "r", "ring").collect()}
    assert got == {"t": (1e7 + 1, 1.0, 4.5), "flat": (2.0, 0.0, 0.0)}
    tags = spark.createDataFrame([({"access": "no", "motorcar:forward": "Destination "},), ({"vehicle": "odd"},), ({},), (None,)], "t map<string,string>")
    assert [r[0] for r in tags.select(codes.access_class(F.col("t"), "forward")).collect()] == ["local_restricted", "prohibited", "open", "open"]
    assert [r[0] for r in tags.select(codes.access_class(F.col("t"))).collect()] == ["prohibited", "prohibited", "open", "open"]


def test_selection_sizes_and_surface(spark):
    pts = spark.createDataFrame([(1, r, n, float(r), x, 0.0, t) for r, n, x, t in [(1, 11, 0.0, ["a"]), (2, 12, 50.0, ["b"]), (3, 13, 120.0, ["a"]), (4, 14, 130.0, ["c"]), (5, 15, 300.0, None)]], "z int, rank int, n long, d double, x double, y double, t array<string>")
    pick = lambda k, sep, topo="t", **kw: [r["nodes"] for r in access.anchored_selection(pts, "z", "n", "d", k, sep, topo, **kw).collect()]
    assert pick(1, 100.0) == [[11]] and pick(2, 100.0) == [[11, 14]] and pick(2, 100.0, None) == [[11, 13]]
    assert pick(3, 100.0) == [[11, 14, 15]] and pick(3, 100.0, depth=4) == [] and pick(5, 200.0) == []
    pairs = spark.createDataFrame([(o, d, 0.1 * o, 0.2 * d, 1.0 + o + 2 * d) for o in range(1, 5) for d in range(1, 5)], "o int, d int, p double, a double, c double")
    seen = spark.createDataFrame([("s", 1, 2, 0.5), ("s", 3, 1, 0.7), ("r", 2, 4, 1.0)], "section string, o int, d int, share double")
    obs = spark.createDataFrame([("s", 10.0, 2.0), ("r", 5.0, 1.0), ("unseen", 3.0, 0.0)], "section string, y double, base double")
    ns, bs = [0.0, 0.7, 2.0], [0.0, 0.05, 0.2]
    want = {(round(r["n"], 9), round(r["beta"], 9)): (r["q"], r["j"], r["rel_j"]) for r in demand.profile(pairs, seen, obs, [(n, b) for n in ns for b in bs]).collect()}
    got = {(round(r["n"], 9), round(r["beta"], 9)): (r["q"], r["j"], r["rel_j"]) for r in demand.surface(pairs, seen, obs, ns, bs).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
    _, rounds, gap = demand.balance_until(pairs.withColumns({"p": F.lit(0.25), "a": F.lit(0.25)}), 0.1)
    assert rounds >= 4 and gap <= 1e-9
    j = np.array([[1e6, 2.0], [3e6, -1.0], [2e6, 4.0]])
    a, b = demand.identifiability(j), demand.identifiability_of(j.T @ j)
    assert a["rank"] == b["rank"] == 2 and all(np.isclose(a[k], b[k], rtol=1e-6) for k in ("condition", "scaled_condition", "cosine"))
