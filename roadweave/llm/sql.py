"""SQL for the queries of this subpackage that SQL can express on whole tables."""

ORACLE = {
    "p4_found": """with latest as (select PRO_COM, node_id, distance_m from access_candidates
      qualify row_number() over (partition by PRO_COM, node_id order by loaded_at desc) = 1)
      select PRO_COM as pro_com, cast(row_number() over (partition by PRO_COM order by distance_m, node_id) as integer) as rank, node_id
      from latest where distance_m is not null and not isnan(distance_m) qualify rank <= 5""",
}
