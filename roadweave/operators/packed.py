"""Several values packed in one field: one row per value, with its position.

The known whole values (a key column of any size) guide the segmentation.  The work is cut
into bounded buckets of records; each bucket gets, by a join on candidate values, the part
of the dictionary that can occur in its texts, builds one multi-pattern automaton over the
spellings of those values and runs it over the texts.  Dynamic programming then picks the
cover that explains most characters by known values, so that a comma inside the known
value "178,498" isn't taken for a delimiter.  Values the dictionary doesn't have are
covered too, at a lower rank, if they are whole numbers of at least ``min_digits``.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.runtime import Scratch, ship

#: Records per bucket, the unit of one automaton.
BUCKET_ROWS = 20_000
#: Digits that fit a 64-bit value in any case; a longer run is no value but a reject.
MAX_DIGITS = 18
#: Characters that may group the digits of one number in threes.
GROUPING = ",.'"
_NUMBER = re.compile(r"[0-9]+(?:[,.'][0-9]+)*")


def spellings(value: int) -> list[str]:
    """How a whole number may be written: plainly or with its digits grouped in threes."""
    plain = str(value)
    grouped = f"{value:,}"
    return [plain] + ([grouped.replace(",", g) for g in GROUPING] if grouped != plain else [])


def candidate_values(text: Column, min_digits: int = 6) -> Column:
    """Every number that some reading of the text may hold, as an array of text.

    Runs of digits as they stand, and runs whose groups of three are joined.
    """
    runs = F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))
    joined = F.regexp_extract_all(text, F.lit("(?<![0-9])([0-9]{1,3}(?:[,.'][0-9]{3})+)(?![0-9])"), F.lit(1))
    # A joined run may itself be several numbers; every stretch of its groups is a candidate.
    groups = F.flatten(F.transform(joined, lambda j: _stretches(F.regexp_extract_all(j, F.lit("([0-9]+)"), F.lit(1)))))
    long = F.filter(F.concat(runs, groups), lambda r: F.length(r).between(min_digits, MAX_DIGITS))
    return F.array_distinct(long)


def _stretches(groups: Column) -> Column:
    """All concatenations of 2 to 6 adjacent groups."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(groups), F.lit(1)))
    stretch = lambda i, n: F.when(i + n - 1 <= F.size(groups), F.array_join(F.slice(groups, i, n), ""))
    return F.flatten(F.transform(starts, lambda i: F.array_compact(F.array(*[stretch(i, F.lit(n)) for n in range(2, 7)]))))


def _automaton(known: list[int]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for v in known:
        for s in spellings(v):
            a.add_word(s, (len(s), v))
    if len(a):
        a.make_automaton()
    return a


def segment(text: str, automaton, min_digits: int = 6) -> list[int]:
    """Values of one text in order.

    Within each maximal stretch of digits and grouping characters, the cover that explains
    most digits, of these the one with most digits in known values, of these the one with
    fewest pieces.  A piece must be bounded by something other than a digit.
    """
    if not text:
        return []
    out: list[int] = []
    for m in _NUMBER.finditer(text):
        s, n = m.group(), m.end() - m.start()
        pieces: dict[int, list[tuple[int, int, bool]]] = {}
        edge = lambda i, j: (i == 0 or not s[i - 1].isdigit()) and (j == n or not s[j].isdigit())
        if len(automaton):
            for end, (size, value) in automaton.iter(s):
                if edge(end + 1 - size, end + 1):
                    pieces.setdefault(end + 1 - size, []).append((end + 1, value, True))
        for g in re.finditer(r"[0-9]+", s):  # whole numbers the dictionary doesn't have
            if min_digits <= g.end() - g.start() <= MAX_DIGITS:
                pieces.setdefault(g.start(), []).append((g.end(), int(g.group()), False))
        for g in re.finditer(r"(?<![0-9])[0-9]{1,3}(?:([,.'])[0-9]{3})(?:\1[0-9]{3})*(?![0-9])", s):
            digits = re.sub(r"[^0-9]", "", g.group())
            if min_digits <= len(digits) <= MAX_DIGITS:
                pieces.setdefault(g.start(), []).append((g.end(), int(digits), False))
        # best[i]: (digits explained, digits in known values, -pieces) from i on, and the way.
        best: list = [None] * (n + 1)
        best[n] = ((0, 0, 0), None)
        for i in range(n - 1, -1, -1):
            top = (best[i + 1][0], None)
            for end, value, known in pieces.get(i, ()):
                size, rest = sum(c.isdigit() for c in s[i:end]), best[end][0]
                score = (rest[0] + size, rest[1] + size * known, rest[2] - 1)
                if score > top[0]:
                    top = (score, (end, value))
            best[i] = top
        i = 0
        while i < n:
            if best[i][1] is None:
                i += 1
            else:
                i, value = best[i][1]
                out.append(value)
    return out


def unpack(df: DataFrame, key: str, fields: list[str], known: DataFrame, known_column: str, min_digits: int = 6, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(field, record_key, position, value) for every value packed in ``fields``.

    ``key`` must be unique; of rows with an equal key the one with the greatest field texts
    counts.  Rows with a null key and null or empty texts give nothing.  Positions count
    values from 0.  ``known`` may have any size; it is joined, never broadcast.  Texts may
    be of any length.  A run of more than MAX_DIGITS digits is no value: it has no row here
    and comes out of ``oversized`` instead.
    """
    ship(df.sparkSession)
    texts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("record_key")).agg(F.max(F.struct(*[F.col(f).cast("string").alias(f) for f in fields])).alias("_t"))
    long = texts.select("record_key", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_t.{f}").alias("text")) for f in fields])).alias("_e")).select("record_key", "_e.*").where("text rlike '[0-9]'")
    # A count of the rows (of the files' footers, where the table is parquet) sets the number of buckets.
    buckets = max(1, -(-df.count() * len(fields) // bucket_rows))
    long = long.withColumn("bucket", F.pmod(F.xxhash64("record_key", "field"), F.lit(buckets)).cast("int"))
    wanted = long.select(F.col("bucket").alias("at_bucket"), F.explode(candidate_values(F.col("text"), min_digits)).alias("value")).select("at_bucket", F.col("value").cast("bigint").alias("value")).distinct()
    values = known.where(F.col(known_column).isNotNull()).select(F.col(known_column).cast("bigint").alias("value")).distinct()
    local = wanted.join(values, "value", "left_semi")

    def solve(records: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        automaton = _automaton(dictionary["value"].tolist())
        found = [(f, k, i, v) for f, k, t in zip(records["field"], records["record_key"], records["text"]) for i, v in enumerate(segment(t, automaton, min_digits))]
        return pd.DataFrame(found, columns=["field", "record_key", "position", "value"])

    return long.groupBy("bucket").cogroup(local.groupBy("at_bucket")).applyInPandas(solve, "field string, record_key bigint, position int, value bigint")


def oversized(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, record_key, reason, run) for each run of digits too long for a 64-bit value, in any row."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    long = df.select(F.col(key).alias("record_key"), cells.alias("_e")).select("record_key", "_e.*")
    runs = F.explode(F.regexp_extract_all("text", F.lit("([0-9]{%d,})" % (MAX_DIGITS + 1)), F.lit(1)))
    return long.select("field", "record_key", F.lit("too_many_digits").alias("reason"), runs.alias("run"))


def id_list(text: Column, min_digits: int = 6) -> Column:
    """The ordered ids of one text as an array, by pattern alone (no dictionary)."""
    # A separator between a number's first one to three digits, or whole groups of three, and a last run of whole groups.
    bare = F.regexp_replace(text, "(?<=(?<![0-9])[0-9]{1,3}(?:[,.'][0-9]{3}){0,5})[,.'](?=[0-9]{3}(?![0-9]))", "")
    return F.filter(F.regexp_extract_all(bare, F.lit("([0-9]+)"), F.lit(1)), lambda t: F.length(t).between(min_digits, MAX_DIGITS))


def text_ids(texts: DataFrame, known: DataFrame, known_column: str, min_digits: int = 6) -> DataFrame:
    """(text, ids) for each distinct text that holds a value: its values in order, as ``unpack`` finds them.

    ``texts`` has one column.  A text without any value has no row.
    """
    scratch = Scratch(texts.sparkSession, "packed")
    text = texts.toDF("text").where("text rlike '[0-9]'").distinct()
    numbered = scratch.cut(text.withColumn("text_no", F.monotonically_increasing_id()))
    found = unpack(numbered, "text_no", ["text"], known, known_column, min_digits)
    lists = found.groupBy(F.col("record_key").alias("text_no")).agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("_l"))
    return scratch.cut(numbered.join(lists, "text_no").select("text", F.col("_l.value").alias("ids")))


def unpack_all(sources: list[tuple[str, DataFrame, str, list[str]]], known: DataFrame, known_column: str) -> DataFrame:
    """``unpack`` over several tables: (source_table, field, record_key, position, value)."""
    parts = [unpack(df, key, fields, known, known_column).select(F.lit(name).alias("source_table"), "field", "record_key", "position", "value") for name, df, key, fields in sources]
    return reduce(DataFrame.unionAll, parts)
