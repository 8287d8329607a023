from roadweave.plans import reference


def test_sections_of_the_mapping(spark, tmp_path):
    """All edges of all sections in the mapping count, whatever their numbers; the latest row of a section holds."""
    d = str(tmp_path)
    rows = [("7.0", "100001|100002", 1), ("7", "'100,002';'100003'", 2), (" 900021 ", "1,007,001", 1), ("8", "100009", 1), ("x", "100001", 1)]
    spark.createDataFrame(rows, "SECTION_ID string, RELEVANT_DIRECTED_EDGE_IDS string, n int").selectExpr("SECTION_ID", "RELEVANT_DIRECTED_EDGE_IDS", "timestamp_seconds(n) as loaded_at").write.parquet(f"{d}/calibration_mapping.parquet")
    edges = [(100001, 1), (100002, 1), (100003, 2), (1007001, 2), (100004, 3), (100009, None)]
    columns = "edge_id long, segment_uid string, way_id long, seq int, u long, v long, length_m double, time_s double, way_direction string, core_eligible int"
    spark.createDataFrame([(e, "s", w, 0, 1, 2, 1.0, 1.0, "forward", 1) for e, w in edges], columns).write.parquet(f"{d}/directed_edges.parquet")
    assert sorted((r["section"], r["edge_id"]) for r in reference._sections(spark, d).collect()) == [(7, 100002), (7, 100003), (8, 100009), (900021, 1007001)]
    got = sorted((r["section"], r["o"], r["d"], r["paths"], r["p"]) for r in reference.section_exposure(spark, d).collect())
    assert got == [(7, 1, 0, 1, 0.5), (7, 2, 0, 1, 0.333333), (900021, 2, 0, 1, 0.333333)]
    label = {r["section"]: (r["pairs"], r["label"]) for r in reference.exposure_label(spark, d).collect()}
    assert label == {7: (2, "PARTIAL"), 8: (0, "NOT_REPRESENTED"), 900021: (1, "PARTIAL")}
