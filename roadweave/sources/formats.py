"""Files that Spark doesn't read itself: SQLite databases, array files, sparse matrices; and verified copies and shards.

A SQLite table or an array file is read by its own library in the Python workers, in ranges of
rows of a bounded size, so no task or driver holds a whole file.  Files must lie where every
executor can open them by path.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.runtime import ship

#: Rows of one range of a SQLite table or array file.
RANGE_ROWS = 100_000
_SQLITE_TYPES = {"INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    """A database opened for reading only."""
    return sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)


def sqlite_schema(path: str) -> dict[str, dict[str, str]]:
    """Tables and views of a database with their columns and Spark types; unknown types are text."""
    with closing(_open(path)) as c:
        tables = [r[0] for r in c.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name")]
        return {t: {r[1]: _SQLITE_TYPES.get((r[2] or "").upper().split("(")[0].strip(), "string") for r in c.execute(f"pragma table_info({_quoted(t)})")} for t in tables}


def find_database(paths: list[str], wanted: set[str]) -> tuple[str, str]:
    """(path, table) of the table that has all ``wanted`` columns, among several the one with fewest others, then the first name.

    Files that are no database are passed over.  Raises ValueError if none fits.
    """
    fits = []
    for p in paths:
        try:
            schema = sqlite_schema(p)
        except sqlite3.DatabaseError:
            continue
        fits += [(len(cols), p, t) for t, cols in schema.items() if wanted <= set(cols)]
    if not fits:
        raise ValueError(f"no table has {sorted(wanted)}")
    return min(fits)[1:]


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A SQLite table as a DataFrame, read by row-id ranges in parallel; views and tables without row id in one range.

    Only ``columns`` are read if given.  Values that don't fit the declared type become null.
    """
    ship(spark)
    known = sqlite_schema(path)[table]
    names = columns or list(known)
    with closing(_open(path)) as c:
        view = c.execute("select type from sqlite_master where name = ?", (table,)).fetchone()[0] == "view"
        try:
            # Every range_rows-th row id begins a range, so gaps in the ids cost nothing.
            starts = [] if view else [r[0] for r in c.execute(f"select rowid from (select rowid, row_number() over (order by rowid) as n from {_quoted(table)}) where (n - 1) % ? = 0 order by rowid", (range_rows,))]
            ranges = [(None, None)] if view else [(a, b) for a, b in zip(starts, [*[x - 1 for x in starts[1:]], 2**63 - 1])]
        except sqlite3.OperationalError:
            ranges = [(None, None)]
    kinds = {n: known[n] for n in names}
    sql = f"select {', '.join(_quoted(n) for n in names)} from {_quoted(table)}"

    def convert(value, kind: str):
        try:
            return None if value is None else int(value) if kind == "bigint" else float(value) if kind == "double" else value if kind == "binary" else str(value)
        except (TypeError, ValueError):
            return None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo, hi in zip(pdf["lo"], pdf["hi"]):
                with closing(_open(path)) as c:
                    got = c.execute(sql) if not lo else c.execute(f"{sql} where rowid between ? and ?", (int(lo), int(hi)))
                    while rows := got.fetchmany(10_000):
                        yield pd.DataFrame({n: pd.Series([convert(r[i], k) for r in rows], dtype={"bigint": "Int64", "double": "float64"}.get(k, object)) for i, (n, k) in enumerate(kinds.items())})

    # As text: a null beside them would turn whole numbers into floats.
    work = spark.createDataFrame([(None if a is None else str(a), None if b is None else str(b)) for a, b in ranges], "lo string, hi string").repartition(max(1, min(len(ranges), spark.sparkContext.defaultParallelism)))
    return work.mapInPandas(read, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def write_sqlite(df: DataFrame, path: str, table: str, key: list[str], mode: str = "upsert") -> int:
    """Rows into a SQLite table in batches: ``upsert`` replaces rows of equal key, ``ignore`` keeps them; returns the rows then there.

    A SQLite file has one writer, so rows stream through the driver in batches; meant for
    results of that size, not for corpora.
    """
    types = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    cols = [(f.name, types.get(f.dataType.simpleString(), "TEXT")) for f in df.schema.fields]
    names = ", ".join(_quoted(n) for n, _ in cols)
    keys = ", ".join(_quoted(k) for k in key)
    rest = [n for n, _ in cols if n not in key]
    on = "do nothing" if mode == "ignore" or not rest else "do update set " + ", ".join(f"{_quoted(n)} = excluded.{_quoted(n)}" for n in rest)
    with closing(sqlite3.connect(path)) as c, c:
        c.execute(f"create table if not exists {_quoted(table)} ({', '.join(f'{_quoted(n)} {t}' for n, t in cols)}, primary key ({keys}))")
        batch = []
        insert = f"insert into {_quoted(table)} ({names}) values ({', '.join('?' * len(cols))}) on conflict ({keys}) {on}"
        for r in df.toLocalIterator():
            batch.append(tuple(r))
            if len(batch) >= 10_000:
                c.executemany(insert, batch)
                batch = []
        c.executemany(insert, batch)
        return c.execute(f"select count(*) from {_quoted(table)}").fetchone()[0]


def read_array(spark: SparkSession, path: str, name: str = "value", range_rows: int = RANGE_ROWS) -> DataFrame:
    """A one- or two-dimensional ``.npy`` file as (i, value) or (i, k, value), mapped and read by ranges of rows."""
    ship(spark)
    shape, kind = np.load(path, mmap_mode="r").shape, np.load(path, mmap_mode="r").dtype.kind
    if len(shape) not in (1, 2) or kind not in "iufb":
        raise ValueError("arrays must have one or two dimensions of numbers")
    spark_type = "bigint" if kind in "iub" else "double"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.load(path, mmap_mode="r")
        for pdf in batches:
            for lo in pdf["id"].tolist():
                part = np.asarray(a[lo * range_rows : (lo + 1) * range_rows])
                i = np.arange(len(part)) + lo * range_rows
                if len(shape) == 1:
                    yield pd.DataFrame({"i": i, name: part.astype("int64" if spark_type == "bigint" else "float64")})
                else:
                    yield pd.DataFrame({"i": np.repeat(i, shape[1]), "k": np.tile(np.arange(shape[1]), len(part)), name: part.ravel().astype("int64" if spark_type == "bigint" else "float64")})

    ranges = spark.range(-(-shape[0] // range_rows))
    return ranges.mapInPandas(read, f"i bigint, {'k bigint, ' if len(shape) == 2 else ''}`{name}` {spark_type}")


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """A compressed sparse row matrix (``.npz`` with data, indices, indptr, shape) as (i, k, value).

    The file is opened on one worker, as its arrays are compressed whole.
    """
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            with np.load(path) as z:
                data, indices, indptr = z["data"], z["indices"], z["indptr"]
            rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
            for lo in range(0, len(data), RANGE_ROWS):
                yield pd.DataFrame({"i": rows[lo : lo + RANGE_ROWS], "k": indices[lo : lo + RANGE_ROWS].astype("int64"), "value": data[lo : lo + RANGE_ROWS].astype("float64")})

    return spark.range(1).mapInPandas(read, "i bigint, k bigint, value double")


def write_csr(df: DataFrame, path: str, rows: int, columns: int) -> None:
    """(i, k, value) as a compressed sparse row ``.npz``; equal places add up.  The file is written by the driver, for matrices of that size."""
    t = df.groupBy("i", "k").agg(F.sum("value").alias("value")).orderBy("i", "k").toPandas()
    counts = np.bincount(t["i"].to_numpy(dtype="int64"), minlength=rows)
    np.savez_compressed(path, data=t["value"].to_numpy(), indices=t["k"].to_numpy(dtype="int64"), indptr=np.concatenate([[0], np.cumsum(counts)]), shape=np.array([rows, columns]))


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of every file of a folder, hashed in the JVM where it is read."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _sha256(path: Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def atomic_write(path: str, data: bytes, exclusive: bool = False) -> None:
    """Write beside and rename, so that a reader sees the old or the new file; ``exclusive`` refuses an existing one."""
    if exclusive and os.path.exists(path):
        raise FileExistsError(path)
    beside = f"{path}.part"
    with open(beside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def copy_verified(source: str, target: str) -> dict[str, str]:
    """Copy a folder through a staged one; every file's hash must agree before the folder is renamed.  Returns name to hash.

    Raises FileExistsError for an existing target and leaves no half copy behind.
    """
    if os.path.exists(target):
        raise FileExistsError(target)
    staged = Path(f"{target}.staged")
    shutil.rmtree(staged, ignore_errors=True)
    try:
        shutil.copytree(source, staged)
        hashes = {}
        for f in sorted(Path(source).rglob("*")):
            if f.is_file():
                name = f.relative_to(source).as_posix()
                hashes[name] = _sha256(f)
                if _sha256(staged / name) != hashes[name]:
                    raise OSError(f"{name} differs after the copy")
        os.replace(staged, target)
        return hashes
    finally:
        shutil.rmtree(staged, ignore_errors=True)


class Shards:
    """A resumable set of shards: one parquet folder per value of a key, and a manifest line for each that is whole.

    The manifest is written after the shard, with its rows, its content digest and the
    fingerprint of what made it; a shard without a matching line counts as not done.
    """

    def __init__(self, spark: SparkSession, path: str, fingerprint: str):
        self.spark, self.path, self.fingerprint = spark, path.rstrip("/"), fingerprint

    def _fs(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def write(self, shard: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{shard}")
        row = self._digest(self.spark.read.parquet(f"{self.path}/{shard}"))
        fs, at = self._fs(f"_manifest/{shard}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"shard": shard, **row, "fingerprint": self.fingerprint}).encode()))
        out.close()

    @staticmethod
    def _digest(df: DataFrame) -> dict:
        from roadweave.sources.files import content_hash

        r = content_hash(df).first()
        return {"n": r["n"], "digest": r["digest"]}

    def manifest(self) -> DataFrame:
        schema = "shard string, n bigint, digest string, fingerprint string"
        fs, at = self._fs("_manifest")
        return self.spark.read.schema(schema).json(f"{self.path}/_manifest") if fs.exists(at) else self.spark.createDataFrame([], schema)

    def done(self, verify: bool = False) -> set[str]:
        """Names of whole shards made with this fingerprint; ``verify`` also reads them against their digests."""
        rows = self.manifest().where(F.col("fingerprint") == self.fingerprint).collect()
        return {r["shard"] for r in rows if not verify or self._digest(self.spark.read.parquet(f"{self.path}/{r['shard']}")) == {"n": r["n"], "digest": r["digest"]}}

    def merged(self) -> DataFrame:
        """All whole shards together, with the column ``shard``."""
        names = sorted(self.done())
        if not names:
            raise ValueError("no shard is done")
        parts = [self.spark.read.parquet(f"{self.path}/{n}").withColumn("shard", F.lit(n)) for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def rebased(lengths: DataFrame, order: list[str], length: str) -> DataFrame:
    """``lengths`` with ``offset``: the sum of the lengths before it in a global order, so that merged shards share one numbering.

    Range partitions are summed on their own and shifted by those before, so the order is
    never gathered in one task.  ``order`` should be unique.
    """
    from pyspark.sql import Window

    from roadweave.runtime import Scratch

    keys = [F.col(c) for c in order]
    flat = Scratch(lengths.sparkSession, "rebase").cut(lengths.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    inside = F.sum(length).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = flat.groupBy("_part").agg(F.sum(length).alias("_s"))
    before = sums.alias("a").join(sums.alias("b"), F.col("b._part") < F.col("a._part")).groupBy(F.col("a._part").alias("_part")).agg(F.sum("b._s").alias("_before"))  # one row per partition
    return flat.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "_part", "left").withColumn("offset", F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_part", "_in", "_before")
