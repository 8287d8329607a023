import math
from itertools import combinations

from roadweave.operators import network
from roadweave.plans import reference

SMALL = "/root/testdata/sf0.001"


def brute(records, topo, depth=30, least=100.0):
    """The first feasible triple by depth, then by distances, separation and nodes."""
    gap = lambda p, q: math.hypot(p["x"] - q["x"], p["y"] - q["y"])
    for k in range(3, min(depth, len(records)) + 1):
        found = []
        for t in combinations(records[:k], 3):
            pairs = list(combinations(t, 2))
            if t[0] is records[0] and min(gap(*p) for p in pairs) >= least - 1e-9 and not any(topo.get(p["node_id"], set()) & topo.get(q["node_id"], set()) for p, q in pairs):
                d = [r["distance_m"] for r in t[1:]]
                found.append((max(d), sum(d), -min(gap(*p) for p in pairs), *sorted(r["node_id"] for r in t[1:]), k))
        if found:
            best = min(found)
            return {best[3], best[4]}, best[5]
    return None


def test_triples_to_depth_30(spark):
    """All zones with a triple within the nearest 30, some of them only beyond 12."""
    topo = {r["node_id"]: set(r["topo_ids"]) for r in network.incident_topo(reference.topo_segments(spark, SMALL)).collect()}
    zones: dict = {}
    for r in reference.candidates(spark, SMALL).where("distance_m is not null and not isnan(distance_m)").collect():
        zones.setdefault(r["PRO_COM"], []).append(r)
    want = {z: t for z, rows in zones.items() if (t := brute(sorted(rows, key=lambda r: (r["distance_m"], r["node_id"])), topo))}
    got = {r["PRO_COM"]: ({r["node_2"], r["node_3"]}, r["depth"]) for r in reference.access_triple_adaptive(spark, SMALL).collect()}
    assert got == want and max(k for _, k in want.values()) > 12


def test_triples_share_no_segment(spark, tmp_path):
    """The query passes the topological segments: a nearer node on the same segment isn't taken."""
    spark.createDataFrame([(1, n, 1.0 * n, 200.0 * n, 0.0) for n in range(1, 5)], "PRO_COM int, node_id long, distance_m double, x double, y double").selectExpr("*", "timestamp'2026-01-01' as loaded_at").write.parquet(f"{tmp_path}/access_candidates.parquet")
    edge = "edge_id long, segment_uid string, way_id long, seq int, u long, v long, length_m double, time_s double, way_direction string, core_eligible int"
    spark.createDataFrame([(100001, "s1", 9, 0, 1, 2, 5.0, 1.0, "forward", 1)], edge).write.parquet(f"{tmp_path}/directed_edges.parquet")
    spark.createDataFrame([("s1", 9, 0, 1, 2, 5.0, "primary", 1, "SS1")], "segment_uid string, way_id long, seq int, osm_u long, osm_v long, length_m double, highway string, direction_code int, ref string").write.parquet(f"{tmp_path}/segments.parquet")
    got = [tuple(r)[1:5] for r in reference.access_triple_adaptive(spark, str(tmp_path)).collect()]
    assert got == [(1, 3, 4, 4)]
