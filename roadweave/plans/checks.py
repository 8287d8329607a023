"""Queries over turn relations, contracts between tables, access selections and real count sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators import access, network, paths, restrictions
from roadweave.plans import reference as ref
from roadweave.plans.reference import _CAND, _EDGE, _GAP, _OD, _SEG, _TOPO, candidates, edges1, query, segments1
from roadweave.sources.tables import table

# Turn relations: those whose sequences the tables hold, with their ways as members.


def _relation_ways(s, d) -> DataFrame:
    """One row per sequence: value, ways in order (neighbours merged), number of edges, node after the first edge."""
    e = table(s, d, "restriction_sequence_edges").where("sequence_id is not null and position is not null").groupBy("sequence_id", "position").agg(F.max(F.struct("way_id", "v")).alias("r"))
    g = e.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("position", "r.way_id", "r.v"))).alias("l"))
    ways = F.transform("l", lambda x: x["way_id"])
    merged = F.filter(F.transform(ways, lambda w, i: F.when((i == 0) | ~w.eqNullSafe(F.get(ways, i - 1)), w)), lambda w: w.isNotNull())
    v = table(s, d, "restriction_sequences").groupBy("sequence_id").agg(F.max("restriction_value").alias("restriction_value"))
    return v.join(g.select("sequence_id", merged.alias("ways"), F.size("l").alias("edges"), F.col("l")[0]["v"].alias("first_v")), "sequence_id")


def _relations(s, d) -> tuple[DataFrame, DataFrame]:
    """Relations with tags (some with an exemption or a condition) and their members."""
    r = _relation_ways(s, d).withColumnRenamed("sequence_id", "relation_id")
    i = F.col("relation_id")
    tags = F.map_from_entries(F.array_compact(F.array(
        F.when(~((i % 26 == 0) & F.lit(True)), F.struct(F.when(i % 5 == 0, "restriction:motorcar").otherwise("restriction").alias("k"), F.col("restriction_value").alias("v"))),
        F.when(i % 11 == 0, F.struct(F.lit("except").alias("k"), F.lit("bus; Motorcar").alias("v"))),
        F.when(i % 13 == 0, F.struct(F.lit("restriction:conditional").alias("k"), F.lit("no_left_turn @ (07:00-09:00)").alias("v"))),
    )))
    member = lambda role, kind, at: F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), at.alias("ref"))
    middle = F.when(F.col("edges") == 2, F.array(member("via", "node", F.col("first_v")))).otherwise(F.transform(F.slice("ways", F.lit(2), F.greatest(F.size("ways") - 2, F.lit(0))), lambda w: member("via", "way", w)))
    ends = F.array(member("from", "way", F.element_at("ways", 1)), member("to", "way", F.element_at("ways", -1)))
    members = r.where("size(ways) > 0").select("relation_id", F.explode(F.concat(ends, middle)).alias("m")).select("relation_id", "m.*")
    return r.select("relation_id", tags.alias("tags")), members


_RELWAYS = """e as (select sequence_id, position, max(row(way_id, v)) as r from (select sequence_id, position, way_id, v from restriction_sequence_edges where sequence_id is not null and position is not null) group by 1, 2),
  g as (select sequence_id, list(r[1] order by position) as raw, count(*) as edges, arg_min(r[2], position) as first_v from e group by 1),
  gw as (select sequence_id, edges, first_v, [raw[i] for i in range(1, len(raw) + 1) if raw[i] is not null and (i = 1 or raw[i] is distinct from raw[i - 1])] as ways from g),
  val as (select sequence_id, max(restriction_value) as value from restriction_sequences group by 1),
  rel as (select val.sequence_id as id, value, ways, edges, first_v from val join gw using (sequence_id))"""


@query(f"""with {_RELWAYS}, wanted as (select distinct way_id from way_nodes where way_id is not null),
  m as (select id, 'end' as role, unnest([ways[1], ways[len(ways)]]) as way from rel where len(ways) > 0 union all select id, 'via', unnest(ways[2:len(ways) - 1]) from rel where len(ways) > 0 and edges <> 2),
  c as (select id, count(*) filter (role = 'via') as via_ways, count(*) filter (way not in (select way_id from wanted)) as unwanted from m group by 1),
  t as (select rel.id, edges, coalesce(via_ways, 0) as via_ways, len(ways) > 0 and coalesce(unwanted, 0) = 0 as in_scope, case when id % 26 <> 0 then value end as value, id % 13 = 0 as cond, case when edges = 2 and len(ways) > 0 then 'VIA_NODE' when coalesce(via_ways, 0) > 0 then 'VIA_WAY' else 'NO_VIA' end as via_class from rel left join c using (id)),
  u as (select *, value is not null and id % 11 <> 0 as applies, via_class <> 'NO_VIA' as canonical from t)
  select via_class, case when not in_scope then 'OUT_OF_SCOPE' when not applies then case when cond and value is null then 'CONDITIONAL_ONLY' else 'NOT_APPLICABLE_MOTORCAR' end when not canonical then 'NONCANONICAL_STRUCTURE' when cond then 'STATIC_PLUS_CONDITIONAL' else 'STATIC_CANONICAL' end as status, count(*) as n from u group by 1, 2""")
def restriction_intake(s, d):
    """Turn relations by via class and status."""
    relations, members = _relations(s, d)
    wanted = table(s, d, "way_nodes").where("way_id is not null").select("way_id")
    return restrictions.intake(relations, members, wanted).groupBy("via_class", "status").agg(F.count(F.lit(1)).alias("n"))


def _compiled(s, d) -> tuple[DataFrame, DataFrame]:
    r = _relation_ways(s, d).where("size(ways) > 0").select(
        F.col("sequence_id").alias("relation_id"), "restriction_value", F.when(F.col("edges") == 2, "VIA_NODE").when(F.size("ways") > 2, "VIA_WAY").otherwise("NO_VIA").alias("via_class"),
        F.when(F.col("edges") == 2, F.col("first_v")).alias("via_node"), "ways",
    )
    nodes = table(s, d, "way_nodes").where("way_id is not null and seq is not null").groupBy("way_id", "seq").agg(F.max("node_id").alias("node_id"))
    return restrictions.compile_relations(r, nodes, edges1(s, d).where("u is not null and v is not null and way_id is not null"))


@query()
def compile_status(s, d):
    """Turn relations by rule kind and the outcome of their compilation; tested against a brute-force compiler."""
    return _compiled(s, d)[1].groupBy("rule_kind", "compile_status").agg(F.count(F.lit(1)).alias("relations"), F.sum("sequences").alias("sequences"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))


#: Routing codes of the statuses in the edge table (fixed values).
STATUS_CODES = {"CORE": 1, "LOCAL_ENDPOINT_ONLY": 2, "closed_access": 0, "closed_direction": 0}


@query("select routing_status as status, routing_code as code, case routing_status when 'CORE' then 1 when 'LOCAL_ENDPOINT_ONLY' then 2 when 'closed_access' then 0 when 'closed_direction' then 0 end as expected, count(*) as n from directed_edges where routing_code is distinct from (case routing_status when 'CORE' then 1 when 'LOCAL_ENDPOINT_ONLY' then 2 when 'closed_access' then 0 when 'closed_direction' then 0 end) group by 1, 2")
def status_contract(s, d):
    return restrictions.contract_breaches(table(s, d, "directed_edges"), "routing_status", "routing_code", STATUS_CODES)


_HAVE = "have as (select trim(segment_uid) as segment_uid, count(distinct way_direction) as actual, max(cast(way_direction = 'FORWARD' as integer)) as f, max(cast(way_direction = 'BACKWARD' as integer)) as b from edge where segment_uid is not null group by 1)"


@query(f"""with {_SEG}, {_EDGE}, {_HAVE}, t as (select direction_code, cast(direction_code in ('0', '1') as integer) as fw, cast(direction_code in ('0', '-1') as integer) as bw, coalesce(actual, 0) as actual, coalesce(f, 0) as f, coalesce(b, 0) as b from seg left join have using (segment_uid))
  select direction_code, fw + bw as expected, actual, f > fw or b > bw as against, count(*) as n from t group by all""")
def direction_contract(s, d):
    """Edges that segments have against those their direction opens, and edges against the direction."""
    edges = edges1(s, d).where("segment_uid is not null").withColumn("segment_uid", F.trim("segment_uid"))
    return restrictions.edge_balance(segments1(s, d).select("segment_uid", "direction_code"), edges.select("segment_uid", "way_direction"))


# Access points: any number, separation and depth, with topological segments.


def _ranked(s, d, depth: int) -> DataFrame:
    r = access.ranked_candidates(candidates(s, d), "PRO_COM", "node_id", "distance_m", depth)
    return r.join(network.incident_topo(ref.topo_segments(s, d)), "node_id", "left")


_INCIDENT = _TOPO.replace("from seg left join structural", "from (select * from seg where way_id is not null and seq is not null) seg left join structural") + f""", inc as (select node, list(distinct topo_id) as t from (select start_node as node, topo_id from topo union select end_node, topo_id from topo) group by 1),
  {_CAND}, acc as (select PRO_COM as z, rank, node_id as n, distance_m as d, x, y, coalesce(inc.t, []) as t from ranked left join inc on inc.node = node_id)"""


def _selection_sql(k: int, sep: str, depth: str, adaptive: bool = False, name: str = "sel", extra: str = "") -> str:
    """A CTE that chooses k points per zone; ``sep`` and ``depth`` are SQL expressions."""
    names = [f"a{i}" for i in range(1, k + 1)]
    joins = "acc a1" + extra + "".join(f" join acc {n} on {n}.z = a1.z and {n}.rank > {p}.rank and {n}.rank <= {depth}" for p, n in zip(names, names[1:]))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    ok = "".join(f" and {_GAP.format(a, b)} >= {sep} - 1e-9 and not list_has_any({a}.t, {b}.t)" for a, b in pairs)
    gap = f"least({', '.join(_GAP.format(a, b) for a, b in pairs)}, 1e18)" if pairs else "cast(null as double)"
    far, total = f"greatest({', '.join(f'{n}.d' for n in names)}, -1)", " + ".join(f"{n}.d" for n in names)
    order = ([f"{names[-1]}.rank"] if adaptive else []) + [far, total, f"-coalesce({gap}, 0)", f"[{', '.join(f'{n}.n' for n in names)}]"]
    return f"{name} as (select a1.z as PRO_COM, {sep} as sep, {depth} as max_depth, [{', '.join(f'{n}.n' for n in names)}] as nodes, {names[-1]}.rank as depth, {far} as far, {total} as total, {gap} as separation from {joins} where a1.rank = 1{ok} qualify row_number() over (partition by a1.z, {sep}, {depth} order by {', '.join(order)}) = 1)"


def _selected(t: DataFrame) -> DataFrame:
    return t.select("PRO_COM", F.array_join(F.col("nodes").cast("array<string>"), "|").alias("nodes"), F.col("depth").cast("int").alias("depth"), F.round("far", 6).alias("far"), F.round("total", 6).alias("total"), F.round("separation", 6).alias("separation"))


_SELECTED = "select PRO_COM, array_to_string(nodes, '|') as nodes, depth, round(far, 6) as far, round(total, 6) as total, round(separation, 6) as separation from sel"


@query(f"{_INCIDENT}, {_selection_sql(3, '100.0', '30', True)} {_SELECTED}")
def access_triple_topo(s, d):
    """The adaptive triple at its full depth of 30, without shared topological segments."""
    return _selected(access.anchored_selection(_ranked(s, d, 30), "PRO_COM", "node_id", "distance_m", 3, 100.0, "topo_ids", adaptive=True))


@query(f"{_INCIDENT}, {_selection_sql(2, '100.0', '20')} {_SELECTED}")
def access_pair_choice(s, d):
    return _selected(access.anchored_selection(_ranked(s, d, 20), "PRO_COM", "node_id", "distance_m", 2, 100.0, "topo_ids"))


@query(f"{_INCIDENT}, {_selection_sql(5, '100.0', '20')} {_SELECTED}")
def access_five_choice(s, d):
    return _selected(access.anchored_selection(_ranked(s, d, 20), "PRO_COM", "node_id", "distance_m", 5, 100.0, "topo_ids"))


_SUMMARY = "count(*) as zones, round(avg(far), 6) as mean_far, round(avg(total), 6) as mean_total"


def _summary(t: DataFrame, name: str, value) -> DataFrame:
    return t.agg(F.count(F.lit(1)).alias("zones"), F.round(F.avg("far"), 6).alias("mean_far"), F.round(F.avg("total"), 6).alias("mean_total")).select(F.lit(value).alias(name), "*")


@query(f"{_INCIDENT}, v as (select unnest([0.0, 50.0, 100.0, 150.0, 200.0]) as s), {_selection_sql(3, 'v.s', '20', extra=' cross join v')} select cast(v.s as double) as separation, {_SUMMARY} from v left join sel on sel.sep = v.s where sel.sep is not null group by 1")
def access_separation_sweep(s, d):
    """Zones with a triple among the nearest 20, for each least separation."""
    r = _ranked(s, d, 20)
    out = [_summary(access.anchored_selection(r, "PRO_COM", "node_id", "distance_m", 3, x, "topo_ids"), "separation", x) for x in (0.0, 50.0, 100.0, 150.0, 200.0)]
    return reduce(DataFrame.unionAll, out)


@query(f"{_INCIDENT}, v as (select unnest([20, 25, 30, 40, 50]) as k), {_selection_sql(3, '100.0', 'v.k', extra=' cross join v')} select cast(max_depth as integer) as depth, {_SUMMARY} from sel group by 1")
def access_depth_sweep(s, d):
    """Zones with a triple, for each number of candidates looked at."""
    r = _ranked(s, d, 50)
    return reduce(DataFrame.unionAll, [_summary(access.anchored_selection(r, "PRO_COM", "node_id", "distance_m", 3, 100.0, "topo_ids", depth=k), "depth", k) for k in (20, 25, 30, 40, 50)])


@query(f"{_INCIDENT} select a.z as PRO_COM, count(*) as pairs, count(*) filter (list_has_any(a.t, b.t)) as shared from acc a join acc b on a.z = b.z and a.rank < b.rank where b.rank <= 5 group by 1")
def access_shared_pairs(s, d):
    return access.shared_pairs(_ranked(s, d, 5), "PRO_COM", "topo_ids")


# Count sections as the mapping has them.

_UNGROUPED = "regexp_replace(regexp_replace(text, '(\\d)[,.''](\\d{3})\\b', '\\1\\2', 'g'), '(\\d)[,.''](\\d{3})\\b', '\\1\\2', 'g')"
_MAPPED = f"""with {_EDGE}, wp as (select distinct way_id, cast(way_id % 25 as integer) as o, cast(floor(way_id / 25 % 25) as integer) as d, 1.0 / (1 + way_id % 9) as weight from edge where way_id is not null),
  map as (select try_cast(regexp_replace(regexp_replace(SECTION_ID, '^\\s+', ''), '(\\.0*)?\\s*$', '') as bigint) as section, RELEVANT_DIRECTED_EDGE_IDS as text, loaded_at from calibration_mapping),
  latest as (select section, text from map where section is not null qualify row_number() over (partition by section order by loaded_at desc, text desc nulls last) = 1),
  sect as (select distinct section, cast(id as bigint) as edge_id from (select section, unnest(list_filter(regexp_extract_all({_UNGROUPED}, '\\d+'), lambda x: length(x) >= 6)) as id from latest)),
  hit as (select distinct way_id, section from edge join sect using (edge_id) where way_id is not null),
  exps as (select section, o, d, count(*) as paths, least(sum(weight), 1.0) as p from hit join wp using (way_id) group by 1, 2, 3)"""


@query(_MAPPED + " select section, o, d, paths, round(p, 6) as p from exps")
def mapped_exposure(s, d):
    """Exposure of the count sections with all their edges from the mapping."""
    return ref.way_exposures(s, d).withColumn("p", F.round("p", 6))


@query(_MAPPED + f", {_OD} select section, round(sum(p * flow), 4) as flow from exps join od using (o, d) group by 1")
def mapped_link_flow(s, d):
    return paths.link_flow(ref.way_exposures(s, d), ref.od_flows(s, d), "section", "flow").withColumn("flow", F.round("flow", 4))


@query(_MAPPED + " select section, count(p) as pairs, case when max(p) is null then 'NOT_REPRESENTED' when max(p) < 1 - 1e-9 then 'PARTIAL' else 'FULL' end as label from latest left join exps using (section) group by 1")
def mapped_exposure_label(s, d):
    return paths.exposure_label(ref._mapping(s, d).select("section"), ref.way_exposures(s, d), "section")
