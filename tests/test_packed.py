from roadweave.operators import packed


def test_segmentation():
    known = packed._automaton([178498, 178499, 123456, 789012, 1234567])
    seg = lambda t: packed.segment(t, known)
    assert seg('"178,498"; "178,499"') == [178498, 178499]
    assert seg("[123456,789012,]") == [123456, 789012]
    assert seg("123,456,789,012") == [123456, 789012]  # known values decide how the groups join
    assert seg("1,234,567|900900") == [1234567, 900900]
    assert seg("'900901';'12345'") == [900901]
    assert seg("") == seg(None) == seg("|") == []
    assert seg("123456" * 2) == [123456123456]
    assert seg("|".join(["900900"] * 5000)) == [900900] * 5000


def test_operator(spark):
    df = spark.createDataFrame([(1, '"178,498"', "x"), (1, '"178,498"', "y"), (2, None, "z"), (None, "123456", "z"), (3, " 123456  900900\n777777", "q")], "k int, f string, field string")
    known = spark.createDataFrame([(178498,), (123456,), (None,)], "id long")
    got = sorted((r["record_key"], r["position"], r["value"]) for r in packed.unpack(df, "k", ["f"], known, "id", bucket_rows=1).collect())
    assert got == [(1, 0, 178498), (3, 0, 123456), (3, 1, 900900), (3, 2, 777777)]
    assert packed.unpack(df.limit(0), "k", ["f"], known, "id").count() == 0
    assert packed.unpack(df, "k", ["f"], known.limit(0), "id").count() == 4


def test_p2_long_grouped_ids(spark, tmp_path):
    """p2 reads ids of seven and more digits as p6 does, whatever way their digits are grouped."""
    from roadweave.plans import problems

    ids = [1007001, 1007002, 123456, 789012, 12345678901]
    plain, grouped = "1007001|12345678901", "'1,007,001';'12,345,678,901'"
    rows = [("1", plain, grouped), ("2", "123456|789012", "123,456,789,012"), ("3", "1007001", "1.007.002"), ("4", None, "1,007,001")]
    for name, role, side in (("station_review", "ROLE_PROPOSAL", 1), ("calibration_mapping", "ROLE", 2)):
        cols = {f: "cast(null as string)" for f in problems.SECTION_FIELDS} | {"TGMA_LIGHT_2024": "1", "PRIMARY_EDGE_IDS": "ids"}
        t = spark.createDataFrame([(r[0], r[side]) for r in rows], "SECTION_ID string, ids string")
        t = t.selectExpr("SECTION_ID", "timestamp'2026-01-01' as loaded_at", *[f"{e} as {role if f == 'ROLE' else f}" for f, e in cols.items()])
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(i,) for i in ids], "edge_id long").write.parquet(f"{tmp_path}/directed_edges.parquet")
    got = sorted((r["section_id"], r["field"], r["value_left"], r["value_right"]) for r in problems.p2_differences(spark, str(tmp_path)).collect())
    assert got == [(3, "PRIMARY_EDGE_IDS", "1007001", "1007002"), (4, "PRIMARY_EDGE_IDS", "", "1007001")]
