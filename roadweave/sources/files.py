"""Delimited files: probing, readers with explicit text columns, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_of(spark: SparkSession, path: str) -> str:
    """The first line of a file or folder, without byte-order mark."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("\ufeff") if first else ""


def detect_separator(header: str, candidates: str = ";,\t|") -> str:
    """The candidate that splits the header most often; the first of equals."""
    return max(candidates, key=lambda c: (header.count(c), -candidates.index(c)))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str | None = None, types: dict[str, str] | None = None, decimal_comma: tuple[str, ...] = (), provenance: str | None = None) -> DataFrame:
    """A delimited file as text columns, with trimmed names, no byte-order mark and chosen types.

    Without ``sep``, or if the header has one column by it, it is taken from the header.  ``types`` casts columns (null if the text
    doesn't convert); ``decimal_comma`` columns become doubles.  ``provenance`` names a column
    for the file path.  Several files must have one header.
    """
    first = path if isinstance(path, str) else path[0]
    header = header_of(spark, first)
    sep = sep or detect_separator(header)
    if sep not in header and detect_separator(header) in header:  # one column by the given separator: the file has another
        sep = detect_separator(header)
    names = [n.strip().strip('"').strip() for n in header.split(sep)]
    if len(set(names)) != len(names):
        raise ValueError(f"header repeats a name: {names}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)
    casts: dict[str, Column] = {c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double") for c in decimal_comma}
    casts |= {c: F.trim(c).try_cast(t) for c, t in (types or {}).items()}
    df = df.withColumns(casts) if casts else df
    return df.withColumn(provenance, F.col("_metadata.file_path")) if provenance else df


def resolve_column(columns: list[str], aliases: list[str], what: str) -> str:
    """The one column whose name is among the aliases, case and blanks aside; raises on none or several."""
    key = lambda s: " ".join(s.lower().replace("_", " ").split())
    wanted = {key(a) for a in aliases}
    hits = [c for c in columns if key(c) in wanted]
    if len(hits) != 1:
        raise ValueError(f"{what}: {len(hits)} columns match {aliases} in {columns}")
    return hits[0]


def first_column(columns: list[str], candidates: list[str], what: str) -> str:
    """The column that stands earliest in an order of preference; letter case doesn't count.

    Raises ValueError if there is none, or if two columns differ in case only.
    """
    place = {n.casefold(): k for k, n in reversed(list(enumerate(candidates)))}
    hits = sorted((place[c.casefold()], c) for c in columns if c.casefold() in place)
    if not hits or sum(k == hits[0][0] for k, _ in hits) > 1:
        raise ValueError(f"{what}: no single column for {candidates} in {columns}")
    return hits[0][1]


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, if it has all columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df


def reload(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """``df``, once its keys are found complete and unique and, if given, its rows as many as they were."""
    missing = F.sum(F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in [*keys, keys[0]]]) > 0, 1).otherwise(0))
    r = require_columns(df, *keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*keys).alias("d"), F.coalesce(missing, F.lit(0)).alias("null")).first()
    if r["null"] or r["d"] != r["n"] or (rows is not None and r["n"] != rows):
        raise ValueError(f"{r['n']} rows, {r['d']} keys, {r['null']} without a key; wanted {rows if rows is not None else 'unique keys'}")
    return df


def find_tables(spark: SparkSession, wanted: dict[str, set[str]]) -> dict[str, str]:
    """For each role the catalog table that has most of its columns, if it has them all."""
    tables = {t.name: {c.name for c in spark.catalog.listColumns(t.name)} for t in spark.catalog.listTables()}
    return {role: max(sorted(fit), key=lambda t: -len(tables[t])) for role, cols in wanted.items() if (fit := [t for t, have in tables.items() if cols <= have])}


def write_csv(df: DataFrame, path: str, keys: list[str], exclusive: bool = False) -> None:
    """Sorted by key, with header; parts follow the key order.  ``exclusive`` refuses an existing path."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists" if exclusive else "overwrite").option("header", True).csv(path)


def write_shards(df: DataFrame, path: str, by: str) -> None:
    """One folder per value of ``by``; only the values in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``work`` whose key isn't finished yet (resumption)."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def content_hash(df: DataFrame) -> DataFrame:
    """One row (n, digest) that doesn't depend on row order or partitioning."""
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))
