"""Lineage cuts and small run-time helpers shared by the iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Needed where the package is on the driver's path only; where it is installed, the copy
    does no harm.
    """
    context = spark.sparkContext
    if getattr(context, "_roadweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="roadweave-")) / "roadweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    context._roadweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` as the cluster names it; only where it is unset and the master
    is local (tests, a laptop) a temporary folder is created and set as the checkpoint
    folder.  On a cluster without that setting a RuntimeError says so: executors couldn't
    read each other's machine-local files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="roadweave-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage between iterations.

    Every table is a complete parquet copy in shared storage, so the loss of an executor
    never costs more than the stage that is running.  ``drop`` removes a table that no
    later step reads; what a returned DataFrame still reads is kept until ``clear``, which
    removes all tables of this object, or the end of the driver's Python process, which
    clears every object left.  A table's path is kept on its DataFrame, so another frame
    can't be mistaken for it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._next = 0
        _LIVE.add(self)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it read back, with no lineage but the files."""
        return self.cut_with(df)[0]

    def cut_with(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """As ``cut``; ``measures`` are aggregates observed during that same write."""
        path = f"{self.root}/{self._next}"
        self._next += 1
        seen = Observation(uuid.uuid4().hex)
        measures.setdefault("rows", F.count(F.lit(1)))
        watched = df.observe(seen, *[c.alias(k) for k, c in measures.items()])
        watched.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._roadweave_path = path
        return back, seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables made by this object; others and None are ignored."""
        for t in tables:
            path = getattr(t, "_roadweave_path", None)
            if path and path.startswith(self.root + "/"):
                self._delete(path)

    def clear(self) -> None:
        """Delete all tables of this object; frames that read them can't be used any more."""
        self._delete(self.root)
        _LIVE.discard(self)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_LIVE: set[Scratch] = set()


@atexit.register
def _clear_all() -> None:
    for s in list(_LIVE):
        try:
            s.clear()
        except Exception:  # noqa: BLE001  the session may have ended before
            _LIVE.discard(s)


def latest_by(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Per key the values of ``columns`` in the row with the greatest ``order``.

    One hash aggregation with map-side combine, no sort.  Rows with equal ``order`` are
    decided by the greatest values of ``columns`` in the given order; a null ``order``
    ranks below all others.
    """
    row = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def grouped_rank(df: DataFrame, groups: list[str], order: list[str], name: str, scratch: Scratch, few_groups: bool = False) -> DataFrame:
    """``df`` with the 0-based rank of each row in its group, in the order of ``order``.

    No group is sorted in one task: rows are range-partitioned by group and order, numbered
    within the partition, and the counts of earlier partitions are added.  ``order`` should
    be unique in the group, rows with equal values stay in one task.  ``few_groups``: their
    number has a fixed bound, so the offsets (at most groups + partitions rows) are broadcast.
    """
    at = F.monotonically_increasing_id()
    keys = [F.col(c) for c in [*groups, *order]]
    flat = scratch.cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)))
    runs = flat.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*groups, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    other = runs.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], F.col("_part").alias("_p"), "_shift")
    same = flat["_part"] == F.col("_p")
    for i, c in enumerate(groups):
        same = same & flat[c].eqNullSafe(F.col(f"_g{i}"))
    return flat.join(F.broadcast(other) if few_groups else other, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
