"""Points near other points: a dual-tree join over two implicit octrees.

Points are placed on a sphere in earth-centred metres, where the distance of two points
is a straight chord whatever their latitude and where no seam exists at a pole or at the
date line.  Both sets are summarised bottom-up into tree nodes (cell, tight bounding box,
count).  Pairs of tree nodes are then compared level by level: boxes too far apart are
discarded, boxes wholly within reach are accepted with all their points, the rest is
refined to the children.  Only uncertain leaf pairs compute distances.

Regions take part as trees of their own: a region's box is covered with few cells of the
power-of-two side that fits it, so small regions get small cells beside large ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.runtime import Scratch

#: Radius of the sphere in metres.
EARTH_RADIUS_M = 6_371_008.8
#: Cell sides as multiples of the search radius, coarse to fine.
LEVELS = (64, 8, 1)
#: A cell with more than this fraction of a side's points (there can't be more than 1 / HOT_FRACTION) is split into parts.
HOT_FRACTION = 1 / 2000
#: Points in a part of a hot cell, and the least size that counts as hot.
PART_POINTS = 5_000
_AXES = ("x", "y", "z")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in the unit of ``radius``; degrees are taken as they stand."""
    h = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _placed(df: DataFrame, item: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """Distinct points with earth-centred coordinates and the cell of every level."""
    la, lo = F.radians(F.col("_lat")), F.radians(F.col("_lon"))
    xyz = {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e9))
    points = df.select(F.col(item).alias("_id"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    points = points.where(F.col("_id").isNotNull() & usable(F.col("_lat")) & usable(F.col("_lon"))).distinct()
    points = points.withColumns({a: xyz[a] * EARTH_RADIUS_M for a in _AXES})
    return points.withColumns({f"c{k}": F.struct(*[F.floor(F.col(a) / (radius_m * k)).alias(a) for a in _AXES]) for k in LEVELS})


def _nodes(points: DataFrame, level: int, parent: int | None) -> DataFrame:
    """Tree nodes of one level with bounding box and, below the top, the parent cell."""
    box = [f(a).alias(f"{n}{a}") for a in _AXES for n, f in (("lo_", F.min), ("hi_", F.max))]
    up = [F.first(f"c{parent}").alias("up")] if parent else []
    return points.groupBy(F.col(f"c{level}").alias("cell")).agg(*box, *up, F.count(F.lit(1)).alias("n"))


def _square(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t * t for t in terms])


def _compare(pairs: DataFrame, chord: float) -> DataFrame:
    """Drop impossible node pairs and mark those wholly within reach."""
    gap = [F.greatest(F.col(f"a.lo_{x}") - F.col(f"b.hi_{x}"), F.col(f"b.lo_{x}") - F.col(f"a.hi_{x}"), F.lit(0.0)) for x in _AXES]
    span = [F.greatest(F.col(f"a.hi_{x}") - F.col(f"b.lo_{x}"), F.col(f"b.hi_{x}") - F.col(f"a.lo_{x}")) for x in _AXES]
    # A micrometre of slack: rounding must never discard or accept a borderline pair.
    return pairs.where(_square(gap) <= (chord + 1e-6) ** 2).select(
        F.col("a.cell").alias("ca"), F.col("b.cell").alias("cb"), (_square(span) < max(0.0, chord - 1e-6) ** 2).alias("sure")
    )


def near_pairs(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_at: tuple[str, str], right_at: tuple[str, str], radius_m: float
) -> DataFrame:
    """Distinct (left_id, right_id) at most ``radius_m`` apart on the sphere.

    ``left_at`` and ``right_at`` name the latitude and longitude columns.  Rows with a null
    id or a null, NaN or infinite coordinate have no partner; values outside the usual
    range are taken as they stand.  Repeated rows count once; an id at several places is
    near whatever any of its places is near to.  An empty side gives no pairs.  Output
    names are ``left_id`` and ``right_id`` (which must differ).
    """
    if left_id == right_id:
        raise ValueError("the two id columns need different names")
    if radius_m < 0:
        raise ValueError("the radius must not be negative")
    from math import pi, sin

    reach = min(radius_m / (2 * EARTH_RADIUS_M), pi / 2)
    chord, step = 2 * EARTH_RADIUS_M * sin(reach), max(radius_m, 1e-3)
    scratch = Scratch(left.sparkSession, "near")
    # Written once: every level and the last join read these points.
    a, b = scratch.cut(_placed(left, left_id, *left_at, step)), scratch.cut(_placed(right, right_id, *right_at, step))

    # Top level: cells are at least a radius wide, so partners are among the 27 neighbours.
    top = LEVELS[0]
    na, nb = _nodes(a, top, None), _nodes(b, top, None)
    offsets = [F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias(f"d{x}") for x in _AXES]
    around = na
    for o, x in zip(offsets, _AXES):
        around = around.select("*", o)
    around = around.withColumn("other", F.struct(*[(F.col(f"cell.{x}") + F.col(f"d{x}")).alias(x) for x in _AXES]))
    pairs = _compare(around.alias("a").join(nb.alias("b"), F.col("a.other") == F.col("b.cell")), chord)
    found = []
    for level, parent in zip((*LEVELS[1:], None), LEVELS):
        found.append((parent, pairs.where("sure"), False))
        if level is None:
            found.append((parent, pairs.where("not sure"), True))
            break
        ca, cb = _nodes(a, level, parent), _nodes(b, level, parent)
        open_ = pairs.where("not sure").select(F.col("ca").alias("pa"), F.col("cb").alias("pb"))
        down = open_.join(ca.select(F.struct("*").alias("a")), F.col("a.up") == F.col("pa"))
        down = down.join(cb.select(F.struct("*").alias("b")), F.col("b.up") == F.col("pb"))
        pairs = _compare(down, chord)
    outs = [_points_of(a, b, level, p, radius_m if check else None) for level, p, check in found]
    return reduce(DataFrame.unionAll, outs).distinct().toDF(left_id, right_id)


def _parts(points: DataFrame, cell: str, name: str) -> DataFrame:
    """(hot, parts) of the cells with more than HOT_FRACTION of the points, broadcast."""
    sizes = points.groupBy(F.col(cell).alias("hot")).agg(F.count(F.lit(1)).alias("n"))
    total = points.agg(F.count(F.lit(1)).alias("all"))
    hot = sizes.join(F.broadcast(total)).where(F.col("n") > F.greatest(F.col("all") * HOT_FRACTION, F.lit(PART_POINTS)))
    return F.broadcast(hot.select(F.col("hot").alias(f"hot_{name}"), F.ceil(F.col("n") / PART_POINTS).alias(f"parts_{name}")))


def _points_of(a: DataFrame, b: DataFrame, level: int, pairs: DataFrame, radius_m: float | None) -> DataFrame:
    """Point pairs of node pairs; with a radius only those that hold it.

    Hot cells of either side are cut into parts of PART_POINTS, and their node pairs into all
    pairs of parts, so no task gets a whole hot cell.
    """
    cell, sides, split = f"c{level}", [], pairs
    for name, points in (("a", a), ("b", b)):
        hot = _parts(points, cell, name)
        parts = F.coalesce(F.col(f"parts_{name}"), F.lit(1).cast("bigint"))
        sides.append(points.join(hot, F.col(cell) == F.col(f"hot_{name}"), "left").select(
            F.col(cell).alias(f"c{name}"), F.pmod(F.xxhash64("_id", "_lat", "_lon"), parts).alias(f"part_{name}"), F.struct("_id", "_lat", "_lon").alias(f"p{name}")
        ))
        split = split.join(hot, F.col(f"c{name}") == F.col(f"hot_{name}"), "left").withColumn(f"part_{name}", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop(f"hot_{name}", f"parts_{name}")
    out = split.join(sides[0], ["ca", "part_a"]).join(sides[1], ["cb", "part_b"])
    if radius_m is not None:
        out = out.where(haversine(F.col("pa._lat"), F.col("pa._lon"), F.col("pb._lat"), F.col("pb._lon")) <= radius_m)
    return out.select("pa._id", F.col("pb._id").alias("_id2"))


def in_regions(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, x: str, y: str, ring: str, buffer: float = 0.0, cells: int = 32) -> DataFrame:
    """(point, region) pairs where the point lies in the region's ring or within ``buffer`` of it.

    ``ring`` is an array of structs (x, y), closed or not; planar coordinates.  A region's
    box, widened by the buffer, is covered with at most (``cells`` + 1) squared cells whose
    side is a power of two, so regions of any sizes lie side by side.  Points look only at
    levels that a region has.  Tree nodes of the points (bounding box per cell) are compared
    with the ring first: a node that no side comes near lies wholly inside and is accepted
    with all its points, or wholly outside and is discarded; the rest is refined to points,
    for which even-odd ray casting and the distance to each side decide.  Null coordinates
    and rings of fewer than three points match nothing; a ring with a null corner neither.
    """
    bad = F.exists(ring, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    r = regions.where((F.size(ring) >= 3) & ~F.coalesce(bad, F.lit(True)) & F.col(region_id).isNotNull()).select(F.col(region_id), F.col(ring).alias("_ring"))
    xs, ys = F.transform("_ring", lambda p: p["x"]), F.transform("_ring", lambda p: p["y"])
    r = r.withColumns({"_x0": F.array_min(xs) - buffer, "_x1": F.array_max(xs) + buffer, "_y0": F.array_min(ys) - buffer, "_y1": F.array_max(ys) + buffer})
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-6))
    r = r.withColumn("_level", F.ceil(F.log2(extent / cells)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda c: F.floor(c / side)
    cover = r.withColumn("_cx", F.explode(F.sequence(cell(F.col("_x0")), cell(F.col("_x1"))))).withColumn("_cy", F.explode(F.sequence(cell(F.col("_y0")), cell(F.col("_y1")))))
    scratch = Scratch(points.sparkSession, "regions")
    # The levels in use: at most one for each power of two of a double, in one row.
    levels = r.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))
    usable = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    p = points.where(usable & F.col(point_id).isNotNull()).select(F.col(point_id), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))
    p = p.join(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).select(point_id, "_px", "_py", "_level", cell(F.col("_px")).alias("_cx"), cell(F.col("_py")).alias("_cy"))
    p = scratch.cut(p)
    at = ["_level", "_cx", "_cy"]
    boxes = p.groupBy(*at).agg(F.min("_px").alias("_nx0"), F.max("_px").alias("_nx1"), F.min("_py").alias("_ny0"), F.max("_py").alias("_ny1"))
    near = cover.join(boxes, at).where("_nx0 <= _x1 and _nx1 >= _x0 and _ny0 <= _y1 and _ny1 >= _y0")
    sides = F.arrays_zip(F.col("_ring").alias("p"), F.concat(F.slice("_ring", 2, F.size("_ring")), F.slice("_ring", 1, 1)).alias("q"))
    ends = lambda s: [(s[n]["x"], s[n]["y"]) for n in ("p", "q")]

    def crosses(px: Column, py: Column):
        def one(s: Column) -> Column:
            (x0, y0), (x1, y1) = ends(s)
            return ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / F.nullif(y1 - y0, F.lit(0.0)) + x0)

        return F.size(F.filter("_sides", lambda s: F.coalesce(one(s), F.lit(False)))) % 2 == 1

    def touches(s: Column) -> Column:
        """A side may come within the buffer of the node's box: their boxes meet, and the corners don't all lie on one side of its line."""
        (x0, y0), (x1, y1) = ends(s)
        bx0, bx1, by0, by1 = F.col("_nx0") - buffer, F.col("_nx1") + buffer, F.col("_ny0") - buffer, F.col("_ny1") + buffer
        turn = [(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) for x in (bx0, bx1) for y in (by0, by1)]
        meet = (F.least(x0, x1) <= bx1) & (F.greatest(x0, x1) >= bx0) & (F.least(y0, y1) <= by1) & (F.greatest(y0, y1) >= by0)
        return meet & ~((F.least(*turn) > 0) | (F.greatest(*turn) < 0))

    px, py = F.col("_px"), F.col("_py")

    def close(s: Column) -> Column:
        (x0, y0), (x1, y1) = ends(s)
        dx, dy = x1 - x0, y1 - y0
        t = F.coalesce(((px - x0) * dx + (py - y0) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return _square([px - (x0 + t * dx), py - (y0 + t * dy)]) <= buffer * buffer

    middle = crosses((F.col("_nx0") + F.col("_nx1")) / 2, (F.col("_ny0") + F.col("_ny1")) / 2)
    judged = near.withColumn("_sides", sides).withColumn("_unsure", F.exists("_sides", touches))
    judged = scratch.cut(judged.where(F.col("_unsure") | middle).select(region_id, "_sides", "_unsure", *at))
    sure = judged.where("not _unsure").select(region_id, *at).join(p, at).select(point_id, region_id)
    open_ = judged.where("_unsure").join(p, at).where(crosses(px, py) | F.exists("_sides", close)).select(point_id, region_id)
    return sure.unionAll(open_).distinct()
