from datetime import datetime

from roadweave.operators import orphans as op

REL = op.Relation("child", ("id", "n"), "ref", "parent", "key")
T = lambda m, d=1: datetime(2024, m, d)
PARENTS = [("a", T(1), None), ("b", T(3), None), ("c", T(1), T(2)), ("b", T(4), T(5)), (" d ", T(1), None), (None, T(1), None)]
CHILDREN = [(1, 0, "a", T(2)), (1, 1, "b", T(2)), (2, 0, "b", T(3)), (3, 0, "c", T(2)), (4, 0, "zz", T(6)), (4, 0, "zz", T(6, 9)), (5, 0, " d", T(2)), (6, None, None, T(1)), (7, 0, "", T(1))]
WANT = {("2024-02", "1:1", "b", "late"), ("2024-02", "3:0", "c", "deleted"), ("2024-06", "4:0", "zz", "missing"), ("2024-01", "7:0", "", "missing")}


def tables(spark):
    p = spark.createDataFrame(PARENTS, "key string, loaded_at timestamp, deleted_at timestamp")
    c = spark.createDataFrame(CHILDREN, "id int, n int, ref string, loaded_at timestamp")
    return p, c


def rows(df):
    return {(r["period"], r["child_key"], r["ref_value"], r["kind"]) for r in df.collect()}


def test_any_number_of_increments(spark):
    p, c = tables(spark)
    for n in (1, 2, 5):
        assert rows(op.orphan_cases(spark, {"parent": p, "child": c}, [REL], n)) == WANT


def test_arrival_and_reopening(spark):
    p, c = tables(spark)
    s = op.OrphanState(spark, REL, reopen=True)
    s.advance(p.where("loaded_at < timestamp '2024-02-01'"), c)
    assert ("2024-03", "2:0", "b", "missing") in rows(s.waiting)
    s.advance(p.where("loaded_at >= timestamp '2024-02-01'"))
    assert rows(s.waiting) == WANT
    s.advance(spark.createDataFrame([("a", T(7), T(7))], "key string, loaded_at timestamp, deleted_at timestamp"), closes=True)
    assert rows(s.waiting) == WANT | {("2024-02", "1:0", "a", "deleted")}
    assert {(r["kind"], r["n"]) for r in s.counts().collect()} >= {("late", 1)}


def test_empty(spark):
    p, c = tables(spark)
    assert rows(op.orphan_cases(spark, {"parent": p, "child": c.limit(0)}, [REL])) == set()
    none = op.orphan_cases(spark, {"parent": p.limit(0), "child": c}, [REL])
    assert {k for *_, k in rows(none)} == {"missing"}


def test_state_is_named_and_carried_on(spark, tmp_path):
    """A second object takes up the state by its name; a row withdrawn later reopens its references, a sibling keeps others closed."""
    schema = "key string, loaded_at timestamp, deleted_at timestamp"
    kids = spark.createDataFrame([(1, 0, "a", T(2)), (2, 0, "b", T(2)), (3, 0, "c", T(2))], "id int, n int, ref string, loaded_at timestamp")
    first = op.OrphanState(spark, REL, f"file://{tmp_path}/state")
    first.advance(spark.createDataFrame([("a", T(1), None), ("b", T(1), None), ("b", T(1, 9), None)], schema), kids)
    assert rows(first.waiting) == {("2024-02", "3:0", "c", "missing")}
    later = op.OrphanState(spark, REL, f"file://{tmp_path}/state")
    assert later.batch == 1
    later.advance(spark.createDataFrame([("a", T(1), T(3)), ("b", T(1), T(3)), ("c", T(2, 20), None)], schema))
    assert rows(later.waiting) == {("2024-02", "1:0", "a", "deleted")}
    third = op.OrphanState(spark, REL, f"file://{tmp_path}/state")
    third.advance(spark.createDataFrame([("a", T(5), None)], schema), kids)  # repeated references change nothing
    assert rows(third.waiting) == {("2024-02", "1:0", "a", "late")}
    assert sorted((r["batch"], r["kind"], r["n"]) for r in third.snapshots().collect()) == [(1, "missing", 1), (2, "deleted", 1), (3, "late", 1)]
