"""Mix sources to target shares of the total size by systematic sampling.

The total is the largest at which every source can reach its share without using a text more
than its allowed number of times.  Every text of a source then has the same expected number
of copies; the texts stand in order of size, the expected copies are summed up along that
order, one random offset per source is added, and a text is emitted once for each whole
number that its stretch of the sum crosses.  Because neighbours in the order have nearly
equal sizes, the tokens drawn differ from the target by about one large text.

The prefix sum is a rank (all stretches of a source are equally long) taken over range
partitions, so a source that holds most rows is never sorted or scanned in one task.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.tokens import DEFAULT_TOKENIZER, token_count
from roadweave.runtime import Scratch, grouped_rank, ship

#: Sources a mixture may have; their totals are gathered on the driver.
MAX_SOURCES = 10_000


def _sized(items: DataFrame, item_id: str, text: str, source: str, tokenizer: str, scratch: Scratch) -> DataFrame:
    """One row per distinct text: its least id, the source of that row, its tokens.

    Equal texts count as one text wherever they stand, so resent texts can't exceed the
    limit of repeats.  Only digests are shuffled; texts are tokenised where they are read.
    """
    read = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("_id"), F.col(source).alias("_source"), token_count(text, tokenizer).alias("_n"), F.sha2(text, 256).alias("_text"))
    one = read.groupBy("_text").agg(F.min(F.struct("_id", "_source", "_n")).alias("_r")).select("_r.*")
    return scratch.cut(one.where("_n > 0"))


def mix(items: DataFrame, targets: DataFrame, item_id: str, text: str, source: str, seed: int = 7, tokenizer: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(copies, shares).

    copies: (item_id, source, n_tokens, copy), one row per use of a text, copy from 1.
    shares: per target source target_share, tokens, actual_share, texts, uses, most_uses.

    ``targets`` has the columns source, target_share (positive, summing to 1) and
    max_repeats (at least 1) and at most MAX_SOURCES rows.  Texts that are null, empty or
    without tokens, and texts of sources without a target, are not used.  A text that
    several rows hold counts once, with its least id and that row's source; null ids rank
    first.  If a source with a target has no tokens no mixture has the target shares and a
    ValueError says which.  Equal input and seed give equal output.
    """
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()}
    if len(goal) > MAX_SOURCES or not goal or abs(sum(s for s, _ in goal.values()) - 1) > 1e-6 or any(s <= 0 or m < 1 for s, m in goal.values()):
        raise ValueError("targets need 1 to MAX_SOURCES sources, positive shares that sum to 1 and max_repeats of at least 1")
    ship(items.sparkSession)
    scratch = Scratch(items.sparkSession, "mixing")
    sized = _sized(items, item_id, text, source, tokenizer, scratch)
    wanted = F.broadcast(items.sparkSession.createDataFrame([(s,) for s in goal], "_source string"))
    have = {r["_source"]: r["t"] for r in sized.join(wanted, "_source", "left_semi").groupBy("_source").agg(F.sum("_n").alias("t")).collect()}
    empty = sorted(str(s) for s in goal if not have.get(s))
    if empty:
        raise ValueError(f"sources without tokens: {empty}")
    total = min(have[s] * most / share for s, (share, most) in goal.items())
    rates = []
    for s, (share, most) in sorted(goal.items(), key=lambda x: str(x[0])):
        rates.append((s, min(float(most), share * total / have[s]), random.Random(f"{seed}/{s}").random(), share))
    rate = F.broadcast(items.sparkSession.createDataFrame(rates, "_source string, _rate double, _offset double, _share double"))
    ranked = grouped_rank(sized.join(wanted, "_source", "left_semi"), ["_source"], ["_n", "_id"], "_rank", scratch, few_groups=True)
    r = ranked.join(rate, "_source")
    # The whole numbers crossed by (rank * rate, (rank + 1) * rate] after the offset is added.
    crossed = F.floor((F.col("_rank") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset"))
    used = r.withColumn("_uses", crossed.cast("int")).where("_uses > 0")
    copies = used.select(F.col("_id").alias(item_id), F.col("_source").alias(source), F.col("_n").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("_uses"))).alias("copy"))
    sums = used.groupBy("_source").agg(F.sum(F.col("_n").cast("bigint") * F.col("_uses")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.sum("_uses").alias("uses"), F.max("_uses").alias("most_uses"))
    whole = F.broadcast(sums.agg(F.sum("tokens").alias("_all")))
    shares = rate.join(sums, "_source", "left").join(whole).select(
        F.col("_source").alias(source), F.col("_share").alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("_all")).alias("actual_share"),
        F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return copies, shares
