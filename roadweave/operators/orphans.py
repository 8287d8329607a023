"""References to records that do not exist, kept incrementally.

State is named and lies in a folder: per batch number one version of four tables.  The
parent index holds one entry per parent row (key, load stamp) and whether it is withdrawn;
the reference log holds every reference once it has arrived; the waiting table those that
met no living parent in time; the snapshots the counts of waiting references after every
batch.  ``advance`` takes one batch: new parent rows extend the index, new references
probe it, waiting references of the touched keys are resolved by arrivals, withdrawals
close entries and reopen the logged references of their keys.  A batch writes its version
beside the old one and names it in a last small write, so a run that dies leaves the state
before the batch, and the same batch can be given again.  A later run loads the state by its
name.

Parents are aggregated to one row a key before they are joined, so a key that a third of all
references name is split on the reference side by AQE.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.runtime import Scratch


@dataclass(frozen=True)
class Relation:
    """A child column that names the key of a parent table."""

    child: str
    child_key: tuple[str, ...]
    ref: str
    parent: str
    parent_key: str
    loaded: str = "loaded_at"
    deleted: str = "deleted_at"


def as_ref(c: str | Column) -> Column:
    """A reference as text without outer blanks."""
    return F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("string"), "\\A\\s+|\\s+\\z", "")


def parent_entries(df: DataFrame, key: str, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """Index entries, one per key and load stamp; withdrawn if every such row has a deletion stamp."""
    gone = F.col(deleted).isNotNull() if deleted in df.columns else F.lit(False)
    rows = df.where(F.col(key).isNotNull()).select(as_ref(key).alias("ref_value"), F.col(loaded).alias("loaded"), gone.alias("gone"))
    return rows.groupBy("ref_value", "loaded").agg(F.min("gone").alias("gone"))


def living(entries: DataFrame) -> DataFrame:
    """(ref_value, living_from): per key the first load of an entry that isn't withdrawn, or null."""
    return entries.groupBy("ref_value").agg(F.min(F.when(~F.col("gone"), F.col("loaded"))).alias("living_from"))


def references(df: DataFrame, r: Relation) -> DataFrame:
    """Distinct references of a child table: period, child_key, ref_value."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in r.child_key]
    return df.where(F.col(r.ref).isNotNull()).select(
        F.date_format(r.loaded, "yyyy-MM").alias("period"), F.concat_ws(":", *parts).alias("child_key"), as_ref(r.ref).alias("ref_value")
    )


def probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References without a living parent in time, with their kind.

    ``missing``: no parent row has the key; ``deleted``: all of them have a deletion stamp;
    ``late``: the first living one was loaded in a month after the reference's.  A null
    period is never late.
    """
    hit = refs.join(index.select("ref_value", "living_from", F.lit(True).alias("_known")), "ref_value", "left")
    kind = (
        F.when(F.col("_known").isNull(), "missing")
        .when(F.col("living_from").isNull(), "deleted")
        .when(F.date_format("living_from", "yyyy-MM") > F.col("period"), "late")
    )
    return hit.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*refs.columns, "kind")


class OrphanState:
    """Pending-orphan state of one relation, advanced batch by batch.

    ``path`` names the state: a folder in shared storage, made on the first batch and
    loaded if it exists.  Without it the state lives in the scratch folder and ends with
    the session.  Batches may have any size and order: the waiting references after all of
    them are the same.  Rows delivered twice change nothing.  A withdrawal is a parent row
    given again with its deletion stamp set; with ``closes`` all rows of the batch's keys
    count as withdrawn, whatever their own stamps, and so do the entries loaded before.
    """

    _REFS = ("period", "child_key", "ref_value")
    _TABLES = ("index", "refs", "waiting", "snapshots")

    def __init__(self, spark: SparkSession, relation: Relation, path: str | None = None, reopen: bool = True):
        self.spark, self.relation, self.reopen = spark, relation, reopen
        self.path = path.rstrip("/") if path else Scratch(spark, f"orphans-{relation.child}").root
        self.batch = self._named_version()

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _named_version(self) -> int:
        """The number of the last complete batch: the greatest folder that has its end mark."""
        fs, at = self._fs(self.path)
        done = [int(f.getPath().getName()[1:]) for f in fs.listStatus(at) if f.getPath().getName()[:1] == "v" and fs.exists(self._fs(f"{f.getPath()}/DONE")[1])] if fs.exists(at) else []
        return max(done, default=0)

    def table(self, name: str) -> DataFrame:
        """A table of the state after the last batch: index, refs, waiting or snapshots."""
        return self.spark.read.parquet(*[f"{self.path}/v{v}/{name}" for v in (range(1, self.batch + 1) if name in ("refs", "snapshots") else [self.batch])])

    @property
    def waiting(self) -> DataFrame:
        return self.table("waiting")

    def advance(self, parents: DataFrame, children: DataFrame | None = None, closes: bool = False) -> DataFrame:
        """Take in one batch of parent rows and references; return the waiting references with their kind."""
        r, at = self.relation, f"{self.path}/v{self.batch + 1}"
        keep = lambda df, name: (df.write.mode("overwrite").parquet(f"{at}/{name}"), self.spark.read.schema(df.schema).parquet(f"{at}/{name}"))[1]
        new = parent_entries(parents, r.parent_key, r.loaded, r.deleted)
        new = new.withColumn("gone", F.lit(True)) if closes else new
        index = new
        if self.batch:
            old = self.table("index")
            merged = old.unionByName(new).groupBy("ref_value", "loaded").agg(F.max("gone").alias("gone"))
            if closes:
                ended = new.select("ref_value").distinct().withColumn("_end", F.lit(True))
                merged = merged.join(ended, "ref_value", "left").select("ref_value", "loaded", (F.col("gone") | F.coalesce("_end", F.lit(False))).alias("gone"))
            index = merged
        index = keep(index, "index")
        alive = living(index)
        source = references(children, r) if children is not None else self.spark.createDataFrame([], "period string, child_key string, ref_value string")
        # The log is only for deletions that reopen; without them new references are probed as they come.
        refs = keep(source, "refs") if self.reopen else source
        parts = [probe(refs, alive)]
        if self.batch:
            # Only keys of this batch can resolve or reopen; a key's first living load may have changed either way.
            touched = keep(new.select("ref_value", "gone"), "touched")
            keys, shut = touched.select("ref_value").distinct(), touched.where("gone").select("ref_value").distinct()
            before = self.table("waiting")
            parts.append(before.join(keys, "ref_value", "left_anti"))
            parts.append(probe(before.drop("kind").join(keys, "ref_value", "left_semi"), alive))
            if self.reopen:
                parts.append(probe(self.table("refs").join(shut, "ref_value", "left_semi"), alive))
        waiting = keep(reduce(DataFrame.unionByName, [p.select(*self._REFS, "kind") for p in parts]).distinct(), "waiting")
        keep(waiting.groupBy("period", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(self.batch + 1)), "snapshots")
        fs, mark = self._fs(f"{at}/DONE")
        fs.create(mark, True).close()
        self.batch += 1
        if self.batch > 1:  # the last version's index and waiting are superseded; its log and snapshot stay
            for name in ("index", "waiting", "touched"):
                fs.delete(self._fs(f"{self.path}/v{self.batch - 1}/{name}")[1], True)
        return waiting

    def counts(self) -> DataFrame:
        """Waiting references per period and kind."""
        return self.waiting.groupBy(F.lit(self.relation.child).alias("child_table"), "period", "kind").agg(F.count(F.lit(1)).alias("n"))

    def snapshots(self) -> DataFrame:
        """(child_table, batch, period, kind, n) after every batch."""
        return self.table("snapshots").select(F.lit(self.relation.child).alias("child_table"), "batch", "period", "kind", "n")


def load_cuts(tables: list[DataFrame], loaded: str, increments: int) -> list:
    """Load stamps that cut the tables' whole load range into equal spans."""
    ends = reduce(DataFrame.unionAll, [t.agg(F.min(loaded).alias("a"), F.max(loaded).alias("b")) for t in tables]).agg(F.min("a"), F.max("b")).first()
    if ends[0] is None:
        return []
    return [ends[0] + (ends[1] - ends[0]) * k / increments for k in range(1, increments)]


def _span(at: Column, cuts: list, k: int) -> Column:
    """Whether a stamp belongs to the k-th span; a null stamp belongs to the first."""
    low = F.lit(True) if k == 0 else at > F.lit(cuts[k - 1])
    return low if k == len(cuts) else ((at <= F.lit(cuts[k])) | at.isNull() if k == 0 else low & (at <= F.lit(cuts[k])))


def replay(spark: SparkSession, tables: dict[str, DataFrame], relations: list[Relation], increments: int = 2, path: str | None = None) -> list[OrphanState]:
    """The states of several relations after all rows have arrived, batch by batch as they did.

    A batch holds the rows loaded in its span and, once more with their deletion stamp, the
    rows loaded earlier that were withdrawn in it; a row isn't known as withdrawn before
    (the last batch takes in every deletion stamp).  Relations are independent; two run side
    by side.  ``path`` names the folder of the states; those in it are carried on.
    """
    cuts = load_cuts(list(tables.values()), relations[0].loaded, increments)

    def run(r: Relation) -> OrphanState:
        state, at = OrphanState(spark, r, f"{path}/{r.child}" if path else None), F.col(r.loaded)
        for k in range(len(cuts) + 1):
            parents = tables[r.parent]
            batch = parents.where(_span(at, cuts, k))
            if r.deleted in parents.columns:
                if k < len(cuts):
                    batch = batch.withColumn(r.deleted, F.when(F.col(r.deleted) <= F.lit(cuts[k]), F.col(r.deleted)))
                if k:
                    again = parents.where((at <= F.lit(cuts[k - 1])) | at.isNull()).where((F.col(r.deleted) > F.lit(cuts[k - 1])) & (F.lit(True) if k == len(cuts) else F.col(r.deleted) <= F.lit(cuts[k])))
                    batch = batch.unionByName(again)
            state.advance(batch, tables[r.child].where(_span(at, cuts, k)))
        return state

    # Two at a time: every batch holds some plans in the driver's memory.
    with ThreadPoolExecutor(2) as pool:
        return list(pool.map(run, relations))


def orphan_cases(spark: SparkSession, tables: dict[str, DataFrame], relations: list[Relation], increments: int = 2, path: str | None = None) -> DataFrame:
    """Distinct orphan references of several relations after all rows have arrived."""
    states = replay(spark, tables, relations, increments, path)
    return reduce(DataFrame.unionAll, [s.waiting.select(F.lit(s.relation.child).alias("child_table"), "period", "child_key", "ref_value", "kind") for s in states])


#: The references of the road network and their parents.
NETWORK_RELATIONS = [
    Relation("restriction_sequence_edges", ("sequence_id", "position"), "edge_id", "directed_edges", "edge_id"),
    Relation("way_nodes", ("way_id", "seq"), "node_id", "nodes", "node_id"),
    Relation("directed_edges", ("edge_id",), "segment_uid", "segments", "segment_uid"),
    Relation("prefix_states", ("state_id",), "physical_node_id", "nodes", "node_id"),
]
