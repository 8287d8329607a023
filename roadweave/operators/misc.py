"""Small operators over road and flow tables: dense numbers, overrides, exact sums, ends of sequences, rings, screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.runtime import Scratch, grouped_rank


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """(key, idx): every distinct non-null key with its place, from 0, in the keys' order."""
    one = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_all", F.lit(0))
    return grouped_rank(one, ["_all"], [key], name, Scratch(df.sparkSession, "index"), few_groups=True).drop("_all")


def encode(df: DataFrame, columns: list[str], index: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """``df`` with each column replaced by its index; a key the index lacks fails when it is read."""
    for c in columns:
        look = index.select(F.col(key).alias(c), F.col(name).alias("_i"))
        missing = F.raise_error(F.concat(F.lit(f"{c} isn't in the index: "), F.col(c).cast("string"))).cast("bigint")
        df = df.join(look, c, "left").withColumn(c, F.when(F.col(c).isNotNull() & F.col("_i").isNull(), missing).otherwise(F.col("_i"))).drop("_i")
    return df


def override(rule: DataFrame, manual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rule`` with the manual value where there is one, and where each value came from."""
    m = manual.select(*keys, F.col(value).alias("_m")).dropDuplicates(keys)
    return rule.join(m, keys, "left").withColumns({value: F.coalesce("_m", value), "origin": F.when(F.col("_m").isNotNull(), "manual").when(F.col(value).isNotNull(), "rule").otherwise("none")}).drop("_m")


def exact_sum(value: Column, scale: int = 10) -> Column:
    """A sum that doesn't depend on the order of rows: decimals of ``scale`` places."""
    return F.sum(value.cast(f"decimal(28,{scale})"))


def end_checks(rows: DataFrame, items: str, first: str, last: str) -> DataFrame:
    """``rows`` with whether a list begins and ends with the stated items; null for an empty list."""
    return rows.withColumns({"first_ok": F.try_element_at(items, F.lit(1)) == F.col(first), "last_ok": F.try_element_at(items, F.lit(-1)) == F.col(last)})


def ring_centroid(regions: DataFrame, region: str, ring: str) -> DataFrame:
    """(region, cx, cy, area): centroid and area of a ring by the shoelace sums; of a ring without area the mean of its corners."""
    p = F.col(ring)
    sides = F.arrays_zip(p.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))
    # Corners are taken from the first one, so large coordinates don't cost digits.
    x0, y0 = p[0]["x"], p[0]["y"]
    s = regions.select(region, p.alias("_p"), x0.alias("_x"), y0.alias("_y"), F.explode(sides).alias("s"))
    px, py, qx, qy = (F.col(f"s.{a}.{b}") - F.col(f"_{b}") for a in ("p", "q") for b in ("x", "y"))
    cross = px * qy - qx * py
    g = s.groupBy(region).agg(F.sum(cross).alias("c"), F.sum((px + qx) * cross).alias("sx"), F.sum((py + qy) * cross).alias("sy"), F.first("_x").alias("_x"), F.first("_y").alias("_y"), F.avg(px).alias("mx"), F.avg(py).alias("my"))
    at = lambda s_, m, o: F.col(o) + F.when(F.abs("c") > 1e-9, F.col(s_) / (3 * F.col("c"))).otherwise(F.col(m))
    return g.select(region, at("sx", "mx", "_x").alias("cx"), at("sy", "my", "_y").alias("cy"), (F.abs("c") / 2).alias("area"))


def too_short(matrix: DataFrame, places: DataFrame, o: str, d: str, km: str, zone: str) -> DataFrame:
    """Pairs whose stated distance lies below the straight line between their places, with the shortfall."""
    at = lambda e, n: places.select(F.col(zone).alias(e), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    t = matrix.join(at(o, 1), o).join(at(d, 2), d).withColumn("least_km", F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")) / 1000)
    return t.where(F.col(km) < F.col("least_km")).withColumn("shortfall", F.col("least_km") - F.col(km)).drop("x1", "y1", "x2", "y2")


def pass_through(slots: DataFrame, weights: DataFrame, path: list[str], node: str, flow: Column) -> DataFrame:
    """Flow through each node: a path counts once however often it meets the node."""
    return slots.select(*path, node).where(F.col(node).isNotNull()).distinct().join(weights, path).groupBy(node).agg(F.count(F.lit(1)).alias("paths"), F.sum(flow).alias("flow"))


def slot_occupancy(visits: DataFrame, site: str, start: str, end: str, minutes: int) -> DataFrame:
    """(site, slot, present): how many visits touch each time slot; a visit of no length touches one."""
    width = minutes * 60
    slot = lambda c: F.floor(F.unix_timestamp(c) / width)
    t = visits.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    return t.select(site, F.explode(F.sequence(slot(start), slot(end))).alias("slot")).groupBy(site, "slot").agg(F.count(F.lit(1)).alias("present"))


def pick_examples(df: DataFrame, classes: list[tuple[str, Column]], value: str, keys: list[str], n: int) -> DataFrame:
    """``n`` examples: the best row of each class, then the best of the rest; ties by keys.

    Each class and the rest need only their first rows, so what is sorted is bounded by ``n``.
    """
    order = [F.desc(value), *keys]
    parts = []
    for place, (name, rule) in enumerate(classes):
        parts.append(df.where(rule).orderBy(*order).limit(1).withColumns({"_place": F.lit(place), "why": F.lit(name)}))
    parts.append(df.orderBy(*order).limit(n + len(classes)).withColumns({"_place": F.lit(len(classes)), "why": F.lit("fill")}))
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    once = t.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))).where("_r = 1").drop("_r")
    return once.orderBy("_place", *order).limit(n).drop("_place")


def path_key(version: str, *parts: str) -> Column:
    """A text key: the version and, after it, zone:access of either end."""
    return F.concat_ws("|", F.lit(version), *[F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string")) for a, b in zip(parts[::2], parts[1::2])])


def imputed(known: Column, capacity: Column, rest: float | Column, rest_capacity: float | Column) -> Column:
    """A known value, or the share of the rest that a capacity has in the capacities without a value."""
    return F.coalesce(known, F.try_divide(capacity * rest, rest_capacity if isinstance(rest_capacity, Column) else F.lit(rest_capacity)))


def regression(new: DataFrame, frozen: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: keys in both, missing on either side, and the greatest absolute difference of each value."""
    a, b = new.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("_a")), frozen.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("_b"))
    j = a.join(b, keys, "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), n(F.col("_b").isNull()).alias("only_new"), n(F.col("_a").isNull()).alias("only_frozen"), *[F.max(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}"))).alias(f"{v}_max") for v in values])
