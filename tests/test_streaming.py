from datetime import datetime

from roadweave.operators import orphans as op
from roadweave.streaming import orphans, windows

T = lambda m, d=1: datetime(2024, m, d)
REL = op.Relation("child", ("id",), "ref", "parent", "key")


def test_a_followed_stream_is_the_state_of_its_batches(spark, tmp_path):
    at = f"file://{tmp_path}"
    parent, child = "key string, loaded_at timestamp, deleted_at timestamp", "id int, ref string, loaded_at timestamp"
    steps = [
        ([("a", T(1), None)], [(1, "a", T(2)), (2, "b", T(2))]),
        ([("b", T(3), None), ("a", T(1), T(4))], [(3, "zz", T(4)), (4, None, T(4))]),
    ]
    for p, c in steps:
        spark.createDataFrame(p, parent).write.mode("append").parquet(f"{at}/p")
        spark.createDataFrame(c, child).write.mode("append").parquet(f"{at}/c")
        q = orphans.follow(spark.readStream.schema(parent).parquet(f"{at}/p"), spark.readStream.schema(child).parquet(f"{at}/c"), REL, f"{at}/state", f"{at}/mark")
        q.awaitTermination()
    state = op.OrphanState(spark, REL, f"{at}/state")
    got = {(r["child_key"], r["ref_value"], r["kind"]) for r in state.waiting.collect()}
    assert got == {("1", "a", "deleted"), ("2", "b", "late"), ("3", "zz", "missing")}
    assert state.batch >= 2


def test_windows_on_a_stream_agree_with_a_table(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, m)) for m in (1, 5, 29, 31, 59)] + [(2, datetime(2024, 1, 1, 2, 0)), (2, None)]
    df = spark.createDataFrame(rows, "user int, ts timestamp")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/v")
    s = windows.windowed_counts(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/v"), ["user"], "ts")
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("counts").collect()) == sorted(windows.windowed_counts(df, ["user"], "ts").collect())
    assert [r["n"] for r in sorted(spark.table("counts").collect())] == [3, 2, 1]
