"""Queries of the general data-preparation problems over whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators import diff, near, orphans, packed, rejects
from roadweave.runtime import latest_by
from roadweave.sources.tables import table

#: Fields compared between the two copies; the review calls ROLE by another name.
SECTION_FIELDS = [
    "ROAD", "TGMA_LIGHT_2024", "QUALITY_CLASS", "ROLE", "MEASUREMENT_OPERATOR", "PRIMARY_SEGMENT_UID", "OPPOSITE_SEGMENT_UID",
    "PRIMARY_EDGE_IDS", "OPPOSITE_EDGE_IDS", "EXTERNAL_EXPOSURE", "CORRIDOR_GROUP", "INFORMATION_ROLE", "QGIS_REVIEW_STATUS",
]
STATION_RADIUS_M = 150.0


def section_number(c: str) -> Column:
    """The integer a section id denotes: outer blanks and a zero fraction don't count."""
    return F.regexp_replace(F.col(c).cast("string"), "\\A\\s+|(?:\\.0*)?\\s*\\z", "").try_cast("bigint")


def bare_text(c: str) -> Column:
    """Text without outer blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\\A\\s+|\\s+\\z", "")


def _comparable(field: str, column: str) -> Column:
    if field == "TGMA_LIGHT_2024":
        return F.col(column).cast("string")
    if field.endswith("EDGE_IDS"):
        return F.col(column)  # joined by _with_id_lists
    return bare_text(column)


def _with_id_lists(spark: SparkSession, d: str, sides: list[DataFrame]) -> list[DataFrame]:
    """The EDGE_IDS fields of both copies as their ordered ids, found as in p6 and joined by ``|``."""
    fields = [f for f in SECTION_FIELDS if f.endswith("EDGE_IDS")]
    texts = reduce(DataFrame.unionAll, [t.select(F.explode(F.array(*fields))) for t in sides])
    lists = packed.text_ids(texts, table(spark, d, "directed_edges"), "edge_id")
    out = []
    for t in sides:
        for f in fields:
            t = t.join(lists.select(F.col("text").alias(f), F.array_join(F.col("ids").cast("array<string>"), "|").alias("_ids")), f, "left")
            t = t.withColumn(f, F.coalesce("_ids", F.lit(""))).drop("_ids")
        out.append(t)
    return out


def section_copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The latest row of every section in the review and in the mapping."""
    out = []
    for name, role in (("station_review", "ROLE_PROPOSAL"), ("calibration_mapping", "ROLE")):
        t = table(spark, d, name).select(section_number("SECTION_ID").alias("section_id"), "loaded_at", *[F.col(role if f == "ROLE" else f).alias(f) for f in SECTION_FIELDS])
        out.append(latest_by(t.where("section_id is not null"), ["section_id"], "loaded_at", SECTION_FIELDS))
    return out[0], out[1]


def p2_differences(spark: SparkSession, d: str) -> DataFrame:
    """Sections in one copy only and every differing field with both values."""
    review, mapping = _with_id_lists(spark, d, list(section_copies(spark, d)))
    fields = {f: (_comparable(f, f), _comparable(f, f)) for f in SECTION_FIELDS}
    return diff.diff_copies(review, mapping, "section_id", fields, ("review", "mapping"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_differences(spark, d).select("section_id", "diff", "field")


def _all_copies(spark: SparkSession, d: str) -> tuple[list[DataFrame], dict]:
    """Every row of both copies, superseded and repeated ones included, and the fields to compare."""
    sides = []
    for name, role in (("station_review", "ROLE_PROPOSAL"), ("calibration_mapping", "ROLE")):
        t = table(spark, d, name)
        sides.append(t.select(section_number("SECTION_ID").alias("section_id"), *[F.col(role if f == "ROLE" else f).alias(f) for f in SECTION_FIELDS]))
    return _with_id_lists(spark, d, sides), {f: (_comparable(f, f), _comparable(f, f)) for f in SECTION_FIELDS}


def p2_all_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same comparison over all rows, superseded and repeated ones included, so that keys repeat."""
    sides, fields = _all_copies(spark, d)
    return diff.diff_copies(*sides, "section_id", fields, ("review", "mapping"))


def p2_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Over all rows: keys with a pair, pairs, their differing fields, and a number no pairing can go below."""
    sides, fields = _all_copies(spark, d)
    total = diff.pairing_total(diff.diff_copies(*sides, "section_id", fields, ("review", "mapping")), "section_id").withColumnRenamed("section_id", "_k")
    both = diff.pairing_bound(*sides, "section_id", fields).join(total, F.col("section_id").eqNullSafe(F.col("_k")))
    return both.agg(F.count(F.lit(1)).alias("keys"), F.sum("pairs").alias("pairs"), F.sum("differing").alias("differing"), F.sum("least").alias("least"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stations = table(spark, d, "stations").withColumn("section_id", section_number("SECTION_ID"))
    return near.near_pairs(stations, table(spark, d, "nodes"), "section_id", "node_id", ("LAT", "LON"), ("lat", "lon"), STATION_RADIUS_M)


#: How far outside a region's ring a point still belongs to it.
REGION_BUFFER_M = 2.0


def zone_rings(spark: SparkSession, d: str) -> DataFrame:
    """A ring for every municipality: the diamond in the box of its access candidates."""
    t = table(spark, d, "access_candidates").where("PRO_COM is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    b = t.groupBy("PRO_COM").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return b.select(F.col("PRO_COM").alias("pro_com"), F.array(corner(F.col("x0"), cy), corner(cx, F.col("y0")), corner(F.col("x1"), cy), corner(cx, F.col("y1"))).alias("ring"))


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """Every node with the municipalities whose ring holds it or is at most two metres away."""
    n = table(spark, d, "nodes").groupBy("node_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return near.in_regions(n, zone_rings(spark, d), "node_id", "pro_com", "x", "y", "ring", REGION_BUFFER_M)


def _network(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("restriction_sequence_edges", "way_nodes", "directed_edges", "prefix_states", "nodes", "segments")}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_cases(spark, _network(spark, d), orphans.NETWORK_RELATIONS)


def p5_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Waiting references per table, month and kind after each of two batches."""
    return reduce(DataFrame.unionAll, [s.snapshots() for s in orphans.replay(spark, _network(spark, d), orphans.NETWORK_RELATIONS, increments=2)])


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and kind."""
    return p5_found(spark, d).groupBy("child_table", "period", "kind").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    sources = [
        ("calibration_mapping", table(spark, d, "calibration_mapping"), "load_row", ["PRIMARY_EDGE_IDS", "OPPOSITE_EDGE_IDS", "RELEVANT_DIRECTED_EDGE_IDS"]),
        ("restriction_sequences", table(spark, d, "restriction_sequences"), "sequence_id", ["edge_ids_json"]),
    ]
    return packed.unpack_all(sources, table(spark, d, "directed_edges"), "edge_id")


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    # line_no 1 is the header; a line without a number is a data line.
    return rejects.parse_rows(table(spark, d, "travel_matrix_raw").where("line_no is null or line_no > 1"), "raw_line", rejects.TRAVEL_MATRIX)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).where("reject_reason is not null and line_no > 1").select("line_id", F.col("reject_reason").alias("reason"))


def p7_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed rows."""
    valid, _ = rejects.split_rows(_matrix(spark, d))
    return valid.select("line_id", *[f.name for f in rejects.TRAVEL_MATRIX])


def p7_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines per file, reason and first broken field."""
    _, bad = rejects.split_rows(_matrix(spark, d))
    return bad.groupBy("source_file", "reject_reason", "broken_field").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_differences, p2_all_rows, p2_pairing, p3_found, p3_regions, p5_found, p5_report, p5_snapshots, p6_found, p7_found, p7_rows, p7_rejects)}

_BARE = "regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
_SECTION = "try_cast(regexp_replace(regexp_replace(SECTION_ID, '^\\s+', ''), '(\\.0*)?\\s*$', '') as bigint)"
_IDS = "array_to_string(list_filter(regexp_extract_all(regexp_replace(coalesce({c}, ''), '\\b(\\d{{1,3}})[,.''](\\d{{3}})\\b', '\\1\\2', 'g'), '\\d+'), lambda x: length(x) >= 6), '|')"


def _section_sql(name: str, role: str) -> str:
    cols = []
    for f in SECTION_FIELDS:
        c = role if f == "ROLE" else f
        cols.append((f"cast({c} as varchar)" if f == "TGMA_LIGHT_2024" else _IDS.format(c=c) if f.endswith("EDGE_IDS") else _BARE.format(c=c)) + f" as {f}")
    return f"select {_SECTION} as section_id, {', '.join(cols)} from {name} where {_SECTION} is not null qualify row_number() over (partition by {_SECTION} order by loaded_at desc) = 1"


_DIFFS = "\n".join(
    [f"with r as ({_section_sql('station_review', 'ROLE_PROPOSAL')}), m as ({_section_sql('calibration_mapping', 'ROLE')})"]
    + ["select section_id, 'only_in_review' as diff, '' as field, cast(null as varchar) as value_left, cast(null as varchar) as value_right from r where section_id not in (select section_id from m)"]
    + ["union all select section_id, 'only_in_mapping', '', null, null from m where section_id not in (select section_id from r)"]
    + [f"union all select section_id, 'value', '{f}', r.{f}, m.{f} from r join m using (section_id) where r.{f} is distinct from m.{f}" for f in SECTION_FIELDS]
)

_REF = "regexp_replace(cast({c} as varchar), '^\\s+|\\s+$', '', 'g')"


def _orphan_sql(r: orphans.Relation) -> str:
    key = " || ':' || ".join(f"cast({c} as varchar)" for c in r.child_key)
    return f"""select distinct '{r.child}' as child_table, strftime(c.{r.loaded}, '%Y-%m') as period, {key} as child_key, {_REF.format(c="c." + r.ref)} as ref_value,
      case when p.k is null then 'missing' when p.living is null then 'deleted' else 'late' end as kind
      from {r.child} c left join (select {_REF.format(c=r.parent_key)} as k, min(case when deleted_at is null then loaded_at end) as living from {r.parent} where {r.parent_key} is not null group by 1) p
      on p.k = {_REF.format(c="c." + r.ref)}
      where c.{r.ref} is not null and (p.k is null or p.living is null or strftime(p.living, '%Y-%m') > strftime(c.{r.loaded}, '%Y-%m'))"""


_ORPHANS = "\nunion all ".join(_orphan_sql(r) for r in orphans.NETWORK_RELATIONS)


def _packed_sql(name: str, key: str, field: str) -> str:
    one = f"select {key} as k, max({field}) as t from {name} group by {key}"
    ids = _IDS.format(c="t").removeprefix("array_to_string(").removesuffix(", '|')")
    return f"select '{name}' as source_table, '{field}' as field, k as record_key, cast(generate_subscripts(l, 1) - 1 as integer) as position, cast(unnest(l) as bigint) as value from (select k, {ids} as l from ({one}))"


_QUOTED = 'regexp_replace({c}, \'"[^"]*"\', chr(57344), \'g\')'
_LINE = "regexp_replace(raw_line, '\\r$', '')"
_DIGITS = '^[ \\t]*(?:"[0-9]{{1,{n}}}"|[0-9]{{1,{n}}})[ \\t]*$'
_DECIMAL = '^[ \\t]*(?:"(?:[0-9]+,?[0-9]*|,[0-9]+)"|(?:[0-9]+,?[0-9]*|,[0-9]+))[ \\t]*$'
_VALID = " and ".join(
    [f"regexp_matches(f[{i}], '{_DIGITS.format(n=n)}')" for i, n in zip(range(1, 7), (2, 3, 6, 2, 3, 6))] + [f"regexp_matches(f[{i}], '{_DECIMAL}')" for i in (7, 8, 9)]
)
_LINES = f"""with lines as (select *, {_LINE} as t, {_QUOTED.format(c=_LINE)} as s from travel_matrix_raw where line_no > 1),
 parts as (select *, string_split(t, ';') as f, string_split(s, ';') as g from lines),
 judged as (select *, case when len(list_filter(g, lambda x: contains(x, '"') or (contains(x, chr(57344)) and not regexp_matches(x, '^[ \\t]*' || chr(57344) || '+[ \\t]*$')))) > 0 then 'quoting'
   when len(g) <> 9 then 'column_count' when not ({_VALID}) then 'invalid_value' end as reason from parts)
"""
_CODE = "trim(replace(f[{i}], '\"', ''), ' ' || chr(9))"
_TYPED = ", ".join(
    [f"{_CODE.format(i=i)} as {f.name}" for i, f in enumerate(rejects.TRAVEL_MATRIX, 1) if f.type == "string"]
    + [f"cast(replace({_CODE.format(i=i)}, ',', '.') as double) as {f.name}" for i, f in enumerate(rejects.TRAVEL_MATRIX, 1) if f.type == "double"]
)

_RE2_FIELDS = [f'[ \\t]*(?:"[0-9]{{1,{n}}}"|[0-9]{{1,{n}}})[ \\t]*' for n in (2, 3, 6, 2, 3, 6)] + ['[ \\t]*(?:"(?:[0-9]+,?[0-9]*|,[0-9]+)"|(?:[0-9]+,?[0-9]*|,[0-9]+))[ \\t]*'] * 3
_BROKEN = "case " + " ".join(f"when not regexp_matches(t, '^{';'.join(_RE2_FIELDS[:k])}(?:;|$)') then {k}" for k in range(1, 10)) + " else 10 end"

ORACLE = {
    "p7_rejects": _LINES.replace("where line_no > 1", "where line_no is null or line_no > 1") + f"select source_file, reason as reject_reason, cast({_BROKEN} as integer) as broken_field, count(*) as n from judged where reason is not null group by 1, 2, 3",
    "p2_found": f"select section_id, diff, field from ({_DIFFS})",
    "p2_differences": f"select *, cast(1 as bigint) as n from ({_DIFFS})",
    "p3_found": f"""select distinct {_SECTION} as section_id, node_id from stations s join nodes n on
      2 * {near.EARTH_RADIUS_M} * asin(least(1.0, sqrt(power(sin(radians(n.lat - s.LAT) / 2), 2) + cos(radians(s.LAT)) * cos(radians(n.lat)) * power(sin(radians(n.lon - s.LON) / 2), 2)))) <= {STATION_RADIUS_M}""",
    "p3_regions": f"""with b as (select PRO_COM, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from access_candidates where PRO_COM is not null and x is not null and y is not null and not isnan(x) and not isnan(y) group by 1),
      r as (select PRO_COM, x0, x1, y0, y1, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from b), n as (select node_id, max(x) as x, max(y) as y from nodes where node_id is not null group by 1),
      e as (select PRO_COM, unnest([[x0, cy, cx, y0], [cx, y0, x1, cy], [x1, cy, cx, y1], [cx, y1, x0, cy]]) as e from r),
      s as (select PRO_COM, e[1] as ax, e[2] as ay, e[3] - e[1] as dx, e[4] - e[2] as dy from e)
      select node_id, PRO_COM as pro_com from n join r on x between x0 - {REGION_BUFFER_M} and x1 + {REGION_BUFFER_M} and y between y0 - {REGION_BUFFER_M} and y1 + {REGION_BUFFER_M}
      where (x1 > x0 and y1 > y0 and abs(x - cx) / ((x1 - x0) / 2) + abs(y - cy) / ((y1 - y0) / 2) < 1) or exists (select 1 from s where s.PRO_COM = r.PRO_COM and
        sqrt(power(x - ax - dx * greatest(0, least(1, coalesce(((x - ax) * dx + (y - ay) * dy) / nullif(dx * dx + dy * dy, 0), 0))), 2) + power(y - ay - dy * greatest(0, least(1, coalesce(((x - ax) * dx + (y - ay) * dy) / nullif(dx * dx + dy * dy, 0), 0))), 2)) <= {REGION_BUFFER_M})""",
    "p5_found": _ORPHANS,
    "p5_report": f"select child_table, period, kind, count(*) as n from ({_ORPHANS}) group by all",
    "p6_found": " union all ".join(
        [_packed_sql("calibration_mapping", "load_row", f) for f in ("PRIMARY_EDGE_IDS", "OPPOSITE_EDGE_IDS", "RELEVANT_DIRECTED_EDGE_IDS")]
        + [_packed_sql("restriction_sequences", "sequence_id", "edge_ids_json")]
    ),
    "p7_found": _LINES + "select line_id, reason from judged where reason is not null",
    "p7_rows": _LINES + f"select line_id, {_TYPED} from judged where reason is null",
}
