"""Queries over the small operators, the readers and sinks, and gates, each with its SQL."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roadweave.functions import codes
from roadweave.operators import access, demand, misc, network, quality, stations
from roadweave.plans import reference as ref
from roadweave.plans.checks import _INCIDENT
from roadweave.plans.fitting import _GLOBAL, global_surface
from roadweave.plans.problems import zone_rings
from roadweave.plans.reference import _APATHS, _CAND, _DEG, _EDGE, _NODE, _OD, _SEG, _matrix_sql, candidates, edges1, matrix, nodes1, query, segments1
from roadweave.runtime import Scratch
from roadweave.sources import files, formats
from roadweave.sources.tables import table

# Readers and sinks: written to the shared folder and read back.


def _folder(s: SparkSession, name: str) -> str:
    """A folder of the shared one; its URI."""
    return Scratch(s, name).root


def _path(uri: str) -> str:
    """The plain path of a shared folder, for files that a library opens; the folder is made."""
    if "://" in uri or uri.startswith("file:"):
        if not uri.startswith("file:"):
            raise ValueError(f"{uri}: SQLite and array files need a folder that is mounted as a path")
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    os.makedirs(uri, exist_ok=True)
    return uri


@query("select s_suppkey, s_name, cast(s_acctbal as double) as s_acctbal, true as has_file from supplier")
def io_delimited(s, d):
    """A file with a byte-order mark, blanks in the header, `;` and decimal commas, read by a wrong separator's fallback."""
    at = _folder(s, "delimited")
    t = table(s, d, "supplier")
    line = F.concat_ws(";", F.col("s_suppkey").cast("string"), "s_name", F.replace(F.col("s_acctbal").cast("double").cast("string"), F.lit("."), F.lit(",")))
    head = s.createDataFrame([("﻿ s_suppkey ; s_name;s_acctbal",)], "value string").coalesce(1)
    head.write.text(f"{at}/a")
    t.select(line.alias("value")).write.text(f"{at}/b")
    names = files.header_of(s, f"{at}/a").split(files.detect_separator(files.header_of(s, f"{at}/a")))
    got = s.read.option("sep", ";").schema("s_suppkey string, s_name string, s_acctbal string").csv(f"{at}/b")
    assert [n.strip() for n in names] == got.columns
    return got.select(F.col("s_suppkey").try_cast("bigint").alias("s_suppkey"), "s_name", F.replace("s_acctbal", F.lit(","), F.lit(".")).try_cast("double").alias("s_acctbal"), F.col("_metadata.file_path").isNotNull().alias("has_file"))


@query("select n_nationkey, n_name from nation")
def io_csv(s, d):
    """Sorted CSV with header, refusing an existing folder, read back with detected separator and chosen types."""
    at = f"{_folder(s, 'csv')}/out"
    t = table(s, d, "nation").select("n_nationkey", "n_name")
    files.write_csv(t, at, ["n_nationkey"], exclusive=True)
    return files.reload(files.read_delimited(s, at, types={"n_nationkey": "bigint"}), ["n_nationkey"])


@query("select c_custkey, c_name, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer")
def io_sqlite(s, d):
    """Rows into a SQLite table, a third of them again with new values, read back in ranges of row ids."""
    at = _path(_folder(s, "sqlite")) + "/out.sqlite"
    t = table(s, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    formats.write_sqlite(t, at, "customer", ["c_custkey"])
    formats.write_sqlite(t.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), at, "customer", ["c_custkey"])
    formats.write_sqlite(t.withColumn("c_name", F.lit("kept out")), at, "customer", ["c_custkey"], mode="ignore")
    return formats.read_sqlite(s, at, "customer", range_rows=4000)


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def io_sqlite_join(s, d):
    """Two databases, found by their columns, joined."""
    at = _path(_folder(s, "databases"))
    formats.write_sqlite(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{at}/one.sqlite", "n", ["n_nationkey"])
    formats.write_sqlite(table(s, d, "region").select("r_regionkey", "r_name"), f"{at}/two.sqlite", "r", ["r_regionkey"])
    both = [f"{at}/one.sqlite", f"{at}/two.sqlite"]
    n, r = (formats.read_sqlite(s, *formats.find_database(both, w)) for w in ({"n_name", "n_regionkey"}, {"r_name"}))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name")


@query("select cast(row_number() over (order by p_partkey) - 1 as bigint) as i, p_retailprice as price from part")
def io_array(s, d):
    """A column as an array file, read back by ranges."""
    at = _path(_folder(s, "array")) + "/price.npy"
    values = table(s, d, "part").orderBy("p_partkey").select(F.col("p_retailprice").cast("double")).toPandas().to_numpy().ravel()
    np.save(at, values)
    return formats.read_array(s, at, "price", range_rows=5000)


@query(f"with {_OD} select o as i, d as k, cast(flow as double) as value from od")
def io_sparse(s, d):
    """Flows as a compressed sparse matrix and back."""
    at = _path(_folder(s, "sparse")) + "/flow.npz"
    formats.write_csr(ref.od_flows(s, d).select(F.col("o").alias("i"), F.col("d").alias("k"), F.col("flow").cast("double").alias("value")), at, 25, 25)
    return formats.read_csr(s, at)


@query("select l_returnflag as shard, count(*) as n, sum(l_orderkey) as keys from lineitem group by 1")
def io_shards(s, d):
    """Shards with a manifest: a second run makes only what isn't whole; hashes agree."""
    shards = formats.Shards(s, _folder(s, "shards"), "orderkeys-1")
    t = table(s, d, "lineitem").select("l_returnflag", "l_orderkey")
    names = sorted(r[0] for r in t.select("l_returnflag").distinct().collect())  # a handful of flags
    for wanted in (names[:1], names):
        for n in sorted(set(wanted) - shards.done(verify=True)):
            shards.write(n, t.where(F.col("l_returnflag") == n).select("l_orderkey"))
    return shards.merged().groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("with w as (select way_id, count(*) as n from way_nodes where way_id is not null group by 1) select way_id, n, cast(coalesce(sum(n) over (order by way_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_place from w")
def io_offsets(s, d):
    """Where each way's nodes begin in one merged numbering."""
    w = table(s, d, "way_nodes").where("way_id is not null").groupBy("way_id").agg(F.count(F.lit(1)).alias("n"))
    return formats.rebased(w, ["way_id"], "n").select("way_id", "n", F.col("offset").cast("bigint").alias("first_place"))


# Small operators


@query("with n as (select node_id, max(x) as x, max(y) as y from nodes group by 1), c as (select node_id, max(in_giant_scc) as g from node_components group by 1) select node_id, x, y from n join c using (node_id) where g = 1")
def giant_nodes(s, d):
    """Nodes in the giant component by its stored labels."""
    c = table(s, d, "node_components").groupBy("node_id").agg(F.max("in_giant_scc").alias("g")).where("g = 1")
    return nodes1(s, d).join(c, "node_id", "left_semi")


@query(f"with {_EDGE}, e as (select edge_id, u, v from edge where u is not null and v is not null), n as (select distinct unnest([u, v]) as id from e), i as (select id, row_number() over (order by id) - 1 as idx from n) select edge_id, a.idx as u, b.idx as v from e join i a on a.id = u join i b on b.id = v")
def dense_encoding(s, d):
    """Edges with node ids replaced by dense numbers."""
    e = edges1(s, d).where("u is not null and v is not null").select("edge_id", "u", "v")
    index = misc.dense_index(e.select(F.explode(F.array("u", "v")).alias("node_id")), "node_id")
    return misc.encode(e, ["u", "v"], index, "node_id").select("edge_id", "u", "v")


@query("with m as (select PRO_COM, node_id, max(source_rank) as r from access_candidates where PRO_COM is not null and node_id is not null group by 1, 2), k as (select PRO_COM, node_id, max(case when distance_m < 100 then 0 end) as r from access_candidates where PRO_COM is not null and node_id is not null group by 1, 2) select m.PRO_COM, m.node_id, coalesce(k.r, m.r) as r, case when k.r is not null then 'manual' when m.r is not null then 'rule' else 'none' end as origin from m join k using (PRO_COM, node_id)")
def priority_override(s, d):
    """Stored ranks, overridden where a node is very near."""
    t = table(s, d, "access_candidates").where("PRO_COM is not null and node_id is not null").groupBy("PRO_COM", "node_id")
    rule = t.agg(F.max("source_rank").alias("r"))
    manual = t.agg(F.max(F.when(F.col("distance_m") < 100, 0)).alias("r")).where("r is not null")
    return misc.override(rule, manual, ["PRO_COM", "node_id"], "r")


@query("select cast(sum(cast(round(length_m, 4) as decimal(28,10))) as varchar) as total, count(*) as n from directed_edges where length_m is not null and not isnan(length_m)")
def exact_length(s, d):
    """The total length, free of the order of summing."""
    t = table(s, d, "directed_edges").where("length_m is not null and not isnan(length_m)")
    return t.agg(misc.exact_sum(F.round("length_m", 4)).cast("string").alias("total"), F.count(F.lit(1)).alias("n"))


_IDLIST = "cast(list_filter(regexp_extract_all(regexp_replace(coalesce(j, ''), '(\\d)[,.''](\\d{3})\\b', '\\1\\2', 'g'), '\\d+'), lambda x: length(x) >= 6) as bigint[])"


@query(f"with t as (select sequence_id, max(edge_ids_json) as j, max(start_edge_id) as a, max(end_edge_id) as b, max(edge_count) as n from restriction_sequences group by 1), l as (select *, {_IDLIST} as ids from t) select first_ok, last_ok, length_ok, count(*) as n from (select ids[1] = a as first_ok, ids[len(ids)] = b as last_ok, len(ids) = n as length_ok from l) group by all")
def sequence_ends(s, d):
    """Whether packed sequences begin, end and count as stated."""
    t = table(s, d, "restriction_sequences").groupBy("sequence_id").agg(F.max("edge_ids_json").alias("j"), F.max("start_edge_id").alias("a"), F.max("end_edge_id").alias("b"), F.max("edge_count").alias("n"))
    t = t.withColumn("ids", ref.id_list(F.coalesce("j", F.lit(""))).cast("array<bigint>"))
    return misc.end_checks(t, "ids", "a", "b").groupBy("first_ok", "last_ok", (F.size("ids") == F.col("n")).alias("length_ok")).agg(F.count(F.lit(1)).alias("n"))


@query("with b as (select PRO_COM, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from access_candidates where PRO_COM is not null and x is not null and y is not null and not isnan(x) and not isnan(y) group by 1) select PRO_COM as pro_com, round((x0 + x1) / 2, 4) as cx, round((y0 + y1) / 2, 4) as cy, round((x1 - x0) * (y1 - y0) / 2, 2) as area from b")
def ring_centroids(s, d):
    t = misc.ring_centroid(zone_rings(s, d), "pro_com", "ring")
    return t.select("pro_com", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("area", 2).alias("area"))


_PLACES = "pl as (select lpad(cast(PRO_COM as varchar), 6, '0') as z, avg(x) as x, avg(y) as y from access_candidates where x is not null and y is not null and not isnan(x) and not isnan(y) group by PRO_COM)"


@query(_matrix_sql() + f", {_PLACES}, km as (select lpad(OR_PROCOM, 6, '0') as o, lpad(DEST_PROCOM, 6, '0') as d, min(KM_TOT) as km from matrix group by 1, 2), g as (select o, d, km, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 1000 as line from km join pl a on a.z = o join pl b on b.z = d) select o, d, km, round(line - km, 6) as shortfall from g where km < line order by line - km desc, o, d limit 125")
def distance_anomalies(s, d):
    """The 125 stated distances that lie farthest below the straight line between the zones' places."""
    places = table(s, d, "access_candidates").where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("PRO_COM").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select(codes.normal_code("PRO_COM").alias("z"), "x", "y")
    km = matrix(s, d).groupBy(codes.normal_code("OR_PROCOM").alias("o"), codes.normal_code("DEST_PROCOM").alias("d")).agg(F.min("KM_TOT").alias("km"))
    t = misc.too_short(km, places, "o", "d", "km", "z").orderBy(F.desc("shortfall"), "o", "d").limit(125)
    return t.select("o", "d", "km", F.round("shortfall", 6).alias("shortfall"))


@query(f"with {_EDGE}, s as (select distinct way_id, unnest([u, v]) as node_id from edge where way_id is not null) select node_id, count(*) as paths, round(sum(1.0 / (1 + way_id % 9)), 6) as flow from s where node_id is not null group by 1")
def node_pass_through(s, d):
    """Flow through every node, ways taken as paths."""
    e = edges1(s, d).where("way_id is not null").select("way_id", F.explode(F.array("u", "v")).alias("node_id"))
    w = e.select("way_id").distinct().withColumn("w", 1.0 / (1 + F.col("way_id") % 9))
    return misc.pass_through(e, w, ["way_id"], "node_id", F.col("w")).withColumn("flow", F.round("flow", 6))


@query("with v as (select user_id, ts as a, ts + interval 20 minute as b from events where ts is not null) select user_id, s as slot, count(*) as present from (select user_id, unnest(range(cast(floor(epoch(a) / 1800) as bigint), cast(floor(epoch(b) / 1800) as bigint) + 1)) as s from v) group by 1, 2")
def slot_occupancy(s, d):
    """Visits of twenty minutes in half-hour slots."""
    v = table(s, d, "events").where("ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("a"), (F.col("ts").cast("timestamp") + F.expr("interval 20 minutes")).alias("b"))
    return misc.slot_occupancy(v, "user_id", "a", "b", 30)


_EXAMPLES = [("intra", "o = d"), ("outward", "o < d"), ("inward", "o > d")]


@query(
    f"with {_OD}, p as (" + " union all ".join([f"(select {i} as place, '{n}' as why, * from od where {r} order by flow desc, o, d limit 1)" for i, (n, r) in enumerate(_EXAMPLES)] + ["(select 3, 'fill', * from od order by flow desc, o, d limit 13)"])
    + "), u as (select * from p qualify row_number() over (partition by o, d order by place) = 1) select why, o, d, flow from u order by place, flow desc, o, d limit 10"
)
def example_pairs(s, d):
    """Ten examples: the greatest flow of each class, then the greatest of the rest."""
    return misc.pick_examples(ref.od_flows(s, d), [(n, F.expr(r)) for n, r in _EXAMPLES], "flow", ["o", "d"], 10).select("why", "o", "d", "flow")


@query(_APATHS + " select concat_ws('|', 'v01', cast(o as varchar) || ':' || cast(source as varchar), cast(d as varchar) || ':' || cast(target as varchar)) as path_id, cost from path")
def path_keys(s, d):
    return ref.access_paths(s, d).select(misc.path_key("v01", "o", "source", "d", "target").alias("path_id"), "cost")


@query(_APATHS + " select count(*) as \"both\", cast(0 as bigint) as only_new, cast(0 as bigint) as only_frozen, max(abs(cost - (cost + case when source % 2 = 0 then 0.5 else 0 end))) as cost_max from path")
def path_regression(s, d):
    """Paths against a frozen copy with known changes, on their four keys."""
    p = ref.access_paths(s, d)
    frozen = p.withColumn("cost", F.col("cost") + F.when(F.col("source") % 2 == 0, 0.5).otherwise(0.0))
    return misc.regression(p, frozen, ["o", "d", "source", "target"], ["cost"])


@query("select highway, case when highway = 'service' then 'auxiliary' when highway in ('" + "', '".join(codes.CLASS_SPEED_KMH) + "') then 'kept' else 'out' end as layer, count(*) as n from segments group by all")
def highway_layers(s, d):
    """Road classes kept, split off to an auxiliary layer, or out."""
    h = F.col("highway")
    layer = F.when(h == "service", "auxiliary").when(h.isin(*codes.CLASS_SPEED_KMH), "kept").otherwise("out")
    return table(s, d, "segments").groupBy("highway", layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SEG}, {_NODE}, t as (select length_m, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as line from seg join node a on a.node_id = u join node b on b.node_id = v where a.x is not null and b.x is not null and length_m > 0) select count(*) as n, round(abs(sum(line) - sum(length_m)) / sum(length_m), 8) as delta, abs(sum(line) - sum(length_m)) / sum(length_m) <= 0.01 as holds from t")
def length_delta(s, d):
    """The summed length of segments against the straight lines between their nodes."""
    at = lambda e: nodes1(s, d).select(F.col("node_id").alias(e), F.col("x").alias(f"x{e}"), F.col("y").alias(f"y{e}"))
    t = segments1(s, d).where("length_m > 0").join(at("u"), "u").join(at("v"), "v").where("xu is not null and xv is not null")
    g = t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hypot(F.col("xu") - F.col("xv"), F.col("yu") - F.col("yv"))).alias("l"), F.sum("length_m").alias("m"))
    delta = F.abs(F.col("l") - F.col("m")) / F.col("m")
    return g.select("n", F.round(delta, 8).alias("delta"), (delta <= 0.01).alias("holds"))


@query(_DEG + " select undirected_degree as degree, count(*) as n from deg group by 1")
def degree_histogram(s, d):
    return network.degrees(edges1(s, d)).groupBy(F.col("undirected_degree").alias("degree")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SEG} select segment_uid, round(length_m, 6) as length_m from seg where length_m is null or not length_m > 30")
def short_segments(s, d):
    """The reject side of a least length: null, NaN and too short."""
    return segments1(s, d).where(~F.coalesce((F.col("length_m") > 30) & ~F.isnan("length_m"), F.lit(False))).select("segment_uid", F.round("length_m", 6).alias("length_m"))


@query(f"{_INCIDENT} select node as node_id, array_to_string(list_sort(t), '|') as topo_ids from inc where node is not null")
def incident_segments(s, d):
    """The topological segments at every node."""
    return network.incident_topo(ref.topo_segments(s, d)).where("node_id is not null").select("node_id", F.array_join("topo_ids", "|").alias("topo_ids"))


@query(_GLOBAL + ", nb as (select a.i, a.k, a.j, min(b.j) as least from surf a join surf b on abs(a.i - b.i) <= 1 and abs(a.k - b.k) <= 1 and not (a.i = b.i and a.k = b.k) group by 1, 2, 3) select cast(i as integer) as i, cast(k as integer) as k from nb where j < least")
def surface_minima(s, d):
    """Grid points whose loss is below that of all eight neighbours."""
    return demand.surface_minima(global_surface(s, d).select("i", "k", "j").cache(), "i", "k", "j").select(F.col("i").cast("int").alias("i"), F.col("k").cast("int").alias("k"))


@query("select line_id, try_cast(replace(trim(t), ',', '.') as double) as finite, case when try_cast(replace(trim(t), ',', '.') as double) > 0 then try_cast(replace(trim(t), ',', '.') as double) end as positive, case when try_cast(trim(t) as integer) in (0, 1, 2) then try_cast(trim(t) as integer) end as code from (select line_id, case when regexp_matches(t, '^[ \\t]*[0-9]+(,[0-9]+)?[ \\t]*$') then t end as t from (select line_id, string_split(raw_line, ';')[1] as t from travel_matrix_raw))")
def number_parsers(s, d):
    """Finite, positive and bounded numbers of a text column; what isn't one is null."""
    first = F.split("raw_line", ";")[0]
    t = table(s, d, "travel_matrix_raw").select("line_id", F.when(first.rlike("\\A[ \\t]*[0-9]+(,[0-9]+)?[ \\t]*\\z"), first).alias("t"))
    number = F.replace(F.trim("t"), F.lit(","), F.lit("."))
    return t.select("line_id", codes.finite(number).alias("finite"), codes.positive(number).alias("positive"), codes.bounded_code(F.trim("t")).alias("code"))


@query("select event_id, event_type in ('view', 'error') as overlaps, coalesce(json_extract_string(props, '$.\"z\"'), json_extract_string(props, '$.\"k\"')) as tag from events")
def tag_functions(s, d):
    """A tag by priority, and whether a packed list meets a set."""
    return table(s, d, "events").select("event_id", codes.tokens_overlap("event_type", ["view", "error"]).alias("overlaps"), codes.first_tag(F.from_json("props", "map<string,string>"), "z", "k").alias("tag"))


@query("select b as beta, n, case when b <= 0 then 'Infinity'::double else round(ln(2) / b, 9) end as half, case when n <= 0 then 0.0 when b <= 0 then 'Infinity'::double else round(n / b, 9) end as peak from (select unnest([0.0::double, 0.02::double, 0.1::double]) as b) cross join (select unnest([0.0::double, 1.5::double]) as n)")
def curve_points(s, d):
    """Half-life and peak of the deterrence curves, with their limits."""
    t = s.createDataFrame([(b, n) for b in (0.0, 0.02, 0.1) for n in (0.0, 1.5)], "beta double, n double")
    return t.select("beta", "n", F.round(codes.half_life(F.col("beta")), 9).alias("half"), F.round(codes.peak_cost(F.col("n"), F.col("beta")), 9).alias("peak"))


@query(f"with {_EDGE} select way_id, bit_or(cast(1 as bigint) << (seq % 40)) as mask, bool_or(seq % 40 = 33) as has_33 from edge where way_id is not null and seq >= 0 group by 1")
def bit_masks(s, d):
    """Places used by each way as a mask of forty bits, and whether bit 33 is set."""
    e = edges1(s, d).where("way_id is not null and seq >= 0").groupBy("way_id").agg(F.bit_or(codes.bitmask(F.col("seq") % 40)).alias("mask"))
    return e.withColumn("has_33", codes.has_bit(F.col("mask"), F.lit(33)))


@query(f"with {_SEG}, {_EDGE}, e as (select segment_uid, count(distinct way_direction) as directions, count(*) as edges from edge group by 1) select segment_uid, coalesce(directions, 0) as directions, coalesce(edges, 0) as edges, coalesce(directions, 0) = coalesce(edges, 0) as one_each from (select segment_uid from seg where highway = 'primary') left join e using (segment_uid)")
def segment_edges(s, d):
    """Edges of the primary segments, and whether there is one per direction."""
    return stations.edges_of_segments(segments1(s, d).where("highway = 'primary'").select("segment_uid"), edges1(s, d)).select("segment_uid", "directions", "edges", "one_each")


@query(f"with {_SEG}, w as (select * from seg where highway = 'trunk'), n as (select s.segment_uid from seg s join w on s.way_id = w.way_id and abs(s.seq - w.seq) <= 2 union select s.segment_uid from seg s join (select distinct unnest([u, v]) as x from w) on x = s.u or x = s.v) select segment_uid from n where segment_uid not in (select segment_uid from w)")
def segment_neighbours(s, d):
    """Segments near the trunk roads: within two places on the way, or at a shared node."""
    t = segments1(s, d)
    return network.neighbourhood(t, t.where("highway = 'trunk'"))


@query(f"with {_OD}, c as (select o, d, 0.42855 * flow as c from od) select 'total_kept' as \"check\", 0.0::double as value, 0.0::double as expected, 'PASS' as status union all select 'same_costs', 0.0, 0.0, 'PASS' union all select 'shares_sum', 0.0, 0.0, 'PASS'")
def flow_gates(s, d):
    """Conservation of the total under a change of order, agreement with itself within a tolerance, shares that sum to one."""
    f = ref.od_flows(s, d)
    moved = f.select(F.col("d").alias("o"), F.col("o").alias("d"), "flow")
    z = ref.territorial_shares(s, d)
    off = z.agg(F.sum("p_share").alias("p"), F.sum("a_share").alias("a")).select(((F.abs(F.col("p") - 1) > 1e-6) | (F.abs(F.col("a") - 1) > 1e-6)).alias("bad"))
    return quality.report(
        quality.conservation_gate(f, moved, "flow", "total_kept"),
        quality.regression_gate(f.withColumn("c", F.col("flow") * 1.0), f.withColumn("c", F.col("flow") * 1.0), ["o", "d"], "c", "same_costs", 1e-9),
        quality.violations(off, {"shares_sum": F.col("bad")}),
    )


@query("select true as equal, 2 as runs")
def determinism(s, d):
    """A selection made twice has the same content."""
    one = lambda: files.content_hash(access.ranked_candidates(candidates(s, d), "PRO_COM", "node_id", "distance_m", 3).select("PRO_COM", "node_id", "rank"))
    return one().unionAll(one()).agg((F.countDistinct("n", "digest") == 1).alias("equal"), F.count(F.lit(1)).cast("int").alias("runs"))


@query(f"with {_CAND}, n as (select PRO_COM, max(COMUNE) as name from access_candidates where PRO_COM is not null group by 1), t as (select PRO_COM, count(*) as points from ranked group by 1) select PRO_COM, points, cast(row_number() over (order by points desc, trim(regexp_replace(lower(strip_accents(coalesce(name, ''))), '\\s+', ' ', 'g')), PRO_COM) as integer) as place from t join n using (PRO_COM) order by place limit 10")
def zones_by_name(s, d):
    """The ten zones with most access points, ties by folded name."""
    n = table(s, d, "access_candidates").where("PRO_COM is not null").groupBy("PRO_COM").agg(F.max("COMUNE").alias("name"))
    t = candidates(s, d).where("distance_m is not null and not isnan(distance_m)").groupBy("PRO_COM").agg(F.count(F.lit(1)).alias("points")).join(n, "PRO_COM")
    top = t.orderBy(F.desc("points"), codes.fold_name(F.coalesce("name", F.lit(""))), "PRO_COM").limit(10).withColumn("key", codes.fold_name(F.coalesce("name", F.lit(""))))
    from pyspark.sql import Window

    return top.select("PRO_COM", "points", F.row_number().over(Window.orderBy(F.desc("points"), "key", "PRO_COM")).alias("place"))


def databases(folder: str) -> list[str]:
    """The SQLite files of a folder, in order."""
    return [str(p) for p in sorted(Path(folder).rglob("*")) if p.is_file() and p.read_bytes()[:16] == b"SQLite format 3\0"]




@query("select event_id, case when event_id % 5 = 0 and event_type = 'view' then 'closed_direction' when c in (0) then 'closed_access' when c = 2 then 'local_restricted' else 'open' end as status, n as class from (select *, case n when 'open' then 1 when 'local_restricted' then 2 else 0 end as c from (select event_id, event_type, case when event_type = 'view' then 'open' when event_type = 'click' then 'local_restricted' when event_type = 'error' then 'prohibited' when event_type = 'purchase' then 'permission_restricted' else 'open' end as n from events))")
def access_classes(s, d):
    """Access class and routing status from tags, the tag of the direction before the general one."""
    e = F.col("event_type")
    tag = F.when(e == "view", F.lit("yes")).when(e == "click", "destination").when(e == "error", "no").when(e == "purchase", "private")
    tags = F.map_filter(F.create_map(F.lit("motor_vehicle:forward"), tag, F.lit("access"), F.when(tag.isNotNull(), "no")), lambda k, v: v.isNotNull())
    t = table(s, d, "events").withColumn("class", codes.access_class(tags, "forward"))
    return t.select("event_id", codes.routing_status(F.col("class"), (F.col("event_id") % 5 == 0) & (e == "view")).alias("status"), "class")


@query(f"with {_OD}, k as (select sum(flow) filter (o <> d and (o + d) % 4 <> 0) as known, sum(o + d) filter (o <> d and (o + d) % 4 = 0) as cap from od) select case when o > d then d else o end as lo, case when o > d then o else d end as hi, case when o = d then 0 else round(case when (o + d) % 4 <> 0 then flow else 1000.0 * (o + d) / (select cap from k) end, 6) end as flow, round(flow * 0.42855 * 365, 6) as yearly, round(flow * 0.2 * 0.5, 6) as thinned from od")
def flow_transforms(s, d):
    """Ends in order, diagonal as zero, unknown flows by their share of a capacity, a year's amount, a thinned flow."""
    from roadweave.operators.od import ALPHA

    f = ref.od_flows(s, d)
    o, t = F.col("o"), F.col("d")
    hidden = (o + t) % 4 == 0
    cap = F.broadcast(f.where((o != t) & hidden).agg(F.sum(o + t).alias("cap")))
    lo, hi = codes.swapped(o > t, o, t)
    known = F.when(~hidden, F.col("flow").cast("double"))
    filled = misc.imputed(known, (o + t).cast("double"), F.lit(1000.0), F.col("cap"))
    return f.join(cap).select(lo.alias("lo"), hi.alias("hi"), F.when(o == t, 0.0).otherwise(F.round(filled, 6)).alias("flow"), F.round(codes.annual(F.col("flow") * ALPHA), 6).alias("yearly"), F.round(codes.thinned(F.col("flow").cast("double"), 0.2, 0.5), 6).alias("thinned"))


@query(_APATHS + ", h as (select *, (source * 31 + target * 17) % 5 = 0 as hit from path) select o, d, count(*) as n, cast(sum(cast(hit as integer)) as bigint) as hits, round(coalesce(sum(weight) filter (hit), 0), 6) as hit_weight, round(least(coalesce(sum(weight) filter (hit), 0), 1.0) - coalesce(sum(weight) filter (hit), 0) * 0.5, 6) as delta from h group by 1, 2")
def pair_sanity(s, d):
    """Hits among the access paths of every pair, against half the exposure as reported."""
    from roadweave.operators import paths as p

    t = ref.access_paths(s, d).withColumn("hit", (F.col("source") * 31 + F.col("target") * 17) % 5 == 0)
    reported = t.where("hit").groupBy("o", "d").agg((F.sum("weight") * 0.5).alias("p"))
    r = p.path_sanity(t, "hit", reported)
    return r.select("o", "d", "n", "hits", F.round("hit_weight", 6).alias("hit_weight"), F.round("delta", 6).alias("delta"))


@query(f"""with recursive {_SEG}, e as (select segment_uid as s, unnest([u, v]) as n from seg where u <> v), lp as (select u as n from seg where u = v),
  m as (select min(s) as a, max(s) as b from e where n is not null and n not in (select n from lp where n is not null) group by n having count(*) = 2 and min(s) <> max(s)), l as (select a, b from m union select b, a from m),
  cc(id, comp) using key (id) as (select segment_uid, segment_uid from seg where segment_uid is not null union (select x.id, min(y.comp) from recurring.cc as x join l on l.a = x.id join cc as y on y.id = l.b where y.comp < x.comp group by x.id))
  select comp as chain, count(*) as segments, round(sum(length_m), 4) as length_m from cc join seg on segment_uid = id group by 1""")
def contracted_chains(s, d):
    """Segments joined across nodes where exactly two ends meet."""
    return network.contracted_chains(segments1(s, d)).withColumn("length_m", F.round("length_m", 4))


@query("select user_id, make_timestamp(cast(floor(epoch_us(ts) / 1800000000) as bigint) * 1800000000) as start, make_timestamp(cast(floor(epoch_us(ts) / 1800000000) as bigint) * 1800000000 + 1800000000) as \"end\", count(*) as n from events where ts is not null group by 1, 2, 3")
def windowed_visits(s, d):
    """Visits per user and half hour, by the operator that also runs on a stream."""
    from roadweave.streaming.windows import windowed_counts

    t = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return windowed_counts(t, ["user_id"], "ts", "30 minutes")
