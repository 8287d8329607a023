"""The N best items of every group by simultaneous bisection of cutoffs.

Every row has an order-preserving code: its score as a 64-bit integer, then its identifier.
All groups are refined at once.  A round splits the open interval of every group at
``CUTS - 1`` midpoints, counts rows between them with map-side combine and keeps the one
part in which the N-th row lies; rows above it are out, rows below it are in.  A group ends
when what is in it and in its interval together are exactly N.  No group is sorted or
gathered anywhere: a group of millions of rows is only ever counted.

Groups that hold more than 1 / HOT_GROUPS of all rows (fewer than HOT_GROUPS of them can
exist) get their cutoffs by broadcast, so their rows are never shuffled; all other groups
are bounded by that same share and join on the group key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.runtime import Scratch, latest_by

#: Parts into which a round cuts each open interval (eight bisections at once).
CUTS = 256
#: A group above this share of all rows is hot; their number is bounded by the inverse.
HOT_GROUPS = 200


def score_code(score: Column) -> Column:
    """Order-preserving 64-bit code of a double: -inf < ... < -0.0 = 0.0 < ... < inf.

    The same integer as the double's bit pattern (negated for negative numbers), from exact
    arithmetic on powers of two, so that it stays inside generated code.  Null and NaN give
    null.
    """
    x = score.cast("double")
    a = F.abs(x)
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(a)).cast("int")
    e = F.when(two(guess.cast("double")) > a, guess - 1).when(two((guess + 1).cast("double")) <= a, guess + 1).otherwise(guess)
    normal = F.shiftleft((e + 1023).cast("bigint"), 52) + ((a / two(e.cast("double")) - 1.0) * two(F.lit(52.0))).cast("bigint")
    code = (
        F.when(a == float("inf"), F.lit(2047 << 52))
        .when(a >= 2.0**-1022, normal)
        .otherwise((a * two(F.lit(537.0)) * two(F.lit(537.0))).cast("bigint"))
    )
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -code).otherwise(code))


#: Width of a part, so that about CUTS parts cover lo..hi; whole-number arithmetic without overflow.
_WIDTH = f"greatest(1L, hi div {CUTS} - lo div {CUTS})"
#: Number of the part that a value of the interval falls into.
_PART = f"value div {_WIDTH} - lo div {_WIDTH}"


def top_n(df: DataFrame, groups: list[str], score: str, identifier: str, n: int, ascending: bool = True, rank: str = "rank") -> DataFrame:
    """``groups``, ``identifier``, ``score`` and ``rank`` (from 1) of the ``n`` best per group.

    Equal scores are ordered by identifier ascending.  A row whose score is null or NaN, or
    whose identifier is null, doesn't compete; a null group is a group.  An identifier that
    occurs several times in a group counts once, with its best score.  A group with fewer
    competitors gives all of them; an empty table gives no rows.  The identifier must be
    an integer.  Further columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    clash = {rank} & {*groups, score, identifier}
    if clash:
        raise ValueError(f"output column names repeat: {clash}")
    best = F.min if ascending else F.max
    rows = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col(score).alias("_score"), F.col(identifier).cast("bigint").alias("_id"), score_code(F.col(score)).alias("_code"))
    rows = rows.where("_code is not null and _id is not null").groupBy(*[f"g{i}" for i in range(len(groups))], "_id").agg(best(F.struct("_code", "_score")).alias("_b"))
    code = F.col("_b._code") if ascending else -F.col("_b._code")
    scratch = Scratch(df.sparkSession, "topn")
    keys = [f"g{i}" for i in range(len(groups))]
    rows = rows.select(*keys, "_id", code.alias("_s"), F.col("_b._score").alias("_score"))
    kept = _bisect(rows, keys, n, scratch)
    order = Window.partitionBy(*keys).orderBy("_s", "_id")
    return kept.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.row_number().over(order).alias(rank), F.col("_id").alias(identifier), F.col("_score").alias(score))


def _bisect(rows: DataFrame, keys: list[str], n: int, scratch: Scratch) -> DataFrame:
    """Rows of each group's n smallest (_s, _id), by refining all cutoffs together."""
    rows = scratch.cut(rows)
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    # State: on level 0 the interval is of scores, on level 1 of identifiers of the score ``at``.
    state = size.select(*keys, "rows", "lo", "hi", F.lit(n).cast("bigint").alias("need"), F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("at"), F.col("rows").alias("inside"))
    state, seen = scratch.cut_with(state, total=F.sum("rows"), big=F.sum((F.col("rows") > n).cast("int")))
    total = seen["total"] or 0
    is_hot = F.col("rows") > total / HOT_GROUPS
    marked = rows
    open_groups = seen["big"] or 0
    first = True
    while open_groups:
        live = state.where("inside > need")
        parts = []
        for hot in (True, False):
            cut = live.where(is_hot if hot else ~is_hot).select(*[F.col(k).alias(f"c{k}") for k in keys], "need", "lo", "hi", "level", "at", "rows")
            on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in keys])
            parts.append(marked.join(F.broadcast(cut) if hot else cut, on).drop(*[f"c{k}" for k in keys]))
        joined = reduce(DataFrame.unionByName, parts)
        value = F.when(F.col("level") == 0, F.col("_s")).otherwise(F.col("_id"))
        inside = F.col("lo") <= value
        inside = inside & (value <= F.col("hi")) & ((F.col("level") == 0) | (F.col("_s") == F.col("at")))
        counted = joined.where(inside).withColumn("value", value).withColumn("part", F.expr(_PART)).groupBy(*keys, "part").agg(
            F.count(F.lit(1)).alias("here"), F.min("value").alias("plo"), F.max("value").alias("phi"), F.first("need").alias("need"), F.first("level").alias("level"), F.first("at").alias("at"), F.first("rows").alias("rows")
        )
        upto = F.sum("here").over(Window.partitionBy(*keys).orderBy("part"))
        step = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("here") < F.col("need")))
        # A part that is one score and still holds too many rows is refined by identifier.
        left = F.col("need") - (F.col("upto") - F.col("here"))
        tied = (F.col("level") == 0) & (F.col("plo") == F.col("phi")) & (F.col("here") > left)
        low, high = F.lit(-(2**63)).cast("bigint"), F.lit(2**63 - 1).cast("bigint")
        new = step.select(
            *keys, "rows", F.when(tied, low).otherwise(F.col("plo")).alias("lo"), F.when(tied, high).otherwise(F.col("phi")).alias("hi"), left.alias("need"),
            F.when(tied, 1).otherwise(F.col("level")).alias("level"), F.when(tied, F.col("plo")).otherwise(F.col("at")).alias("at"), F.col("here").alias("inside"),
        )
        live_keys = live.select(*keys)
        done = state.alias("s").join(live_keys.alias("l"), reduce(lambda x, y: x & y, [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]), "left_anti")
        nxt, seen = scratch.cut_with(done.unionByName(new), open=F.sum((F.col("inside") > F.col("need")).cast("int")))
        open_groups = seen["open"] or 0
        # Only rows up to the cutoff stay; after the first round that is few of them.
        survivors = scratch.cut(_below(marked, nxt, keys, is_hot))
        scratch.drop(state, marked if not first else rows)
        state, marked, first = nxt, survivors, False
    return marked


def _below(rows: DataFrame, state: DataFrame, keys: list[str], is_hot: Column) -> DataFrame:
    """Rows not above their group's interval."""
    value = F.when(F.col("level") == 0, F.col("_s") <= F.col("hi")).otherwise((F.col("_s") < F.col("at")) | ((F.col("_s") == F.col("at")) & (F.col("_id") <= F.col("hi"))))
    parts = []
    for hot in (True, False):
        cut = state.where(is_hot if hot else ~is_hot).select(*[F.col(k).alias(f"c{k}") for k in keys], "hi", "level", "at")
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in keys])
        parts.append(rows.join(F.broadcast(cut) if hot else cut, on).where(value).select(*rows.columns))
    return reduce(DataFrame.unionAll, parts)


def latest_top_n(df: DataFrame, groups: list[str], score: str, identifier: str, stamp: str, n: int) -> DataFrame:
    """``top_n`` over the row with the latest ``stamp`` of each group and identifier."""
    return top_n(latest_by(df, [*groups, identifier], stamp, [score]), groups, score, identifier, n)
