"""Turn relations as they are mapped: scope, structure and the edge sequences they mean.

Relations: relation_id and tags (a map).  Members: relation_id, role (from, via, to), kind
(node or way), ref, place (their order).  Everything is one pass of aggregations and joins;
chains over any number of via ways are combined inside array expressions, bounded by the
number of combinations that still counts as unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.codes import first_tag, tokens_overlap

#: Tags that state a restriction for cars, most specific first, and exemptions that free cars (fixed values).
CAR_TAGS = ("restriction:motorcar", "restriction:motor_vehicle", "restriction:vehicle", "restriction")
CAR_CLASSES = ["motorcar", "motor_vehicle", "vehicle"]
#: Combinations of connecting nodes, and paths along one via way, above which a chain is ambiguous (fixed values).
MOST_COMBINATIONS, MOST_VARIANTS = 200, 20


def intake(relations: DataFrame, members: DataFrame, wanted_ways: DataFrame) -> DataFrame:
    """Each relation with via_class, in_scope, restriction_value, conditional, applies, canonical and status.

    via_class: VIA_NODE, VIA_WAY, NO_VIA or VIA_MIXED.  In scope: it has way members and all of
    them are wanted.  Applies to cars: a value is there and ``except`` names no car class.
    Canonical: one from way, one to way, and one via node or only via ways.  status is the
    first of OUT_OF_SCOPE, CONDITIONAL_ONLY or NOT_APPLICABLE_MOTORCAR, NONCANONICAL_STRUCTURE,
    STATIC_PLUS_CONDITIONAL, STATIC_CANONICAL.  A relation without members is out of scope.
    """
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    way, role = F.col("kind") == "way", F.col("role")
    wanted = wanted_ways.select(F.col(wanted_ways.columns[0]).alias("ref"), F.lit("way").alias("kind"), F.lit(True).alias("_wanted")).distinct()
    m = members.join(wanted, ["ref", "kind"], "left").groupBy("relation_id").agg(
        n((role == "from") & way).alias("from_ways"), n((role == "to") & way).alias("to_ways"), n((role == "via") & way).alias("via_ways"), n((role == "via") & (F.col("kind") == "node")).alias("via_nodes"),
        n(role == "via").alias("vias"), n(way).alias("ways"), n(way & F.col("_wanted").isNull()).alias("unwanted"),
    )
    t = relations.join(m, "relation_id", "left").na.fill(0, ["from_ways", "to_ways", "via_ways", "via_nodes", "vias", "ways", "unwanted"])
    value = first_tag(F.col("tags"), *CAR_TAGS)
    conditional = F.col("tags")["restriction:conditional"]
    vias = F.col("vias")
    via_class = F.when(vias == 0, "NO_VIA").when(F.col("via_nodes") == vias, "VIA_NODE").when(F.col("via_ways") == vias, "VIA_WAY").otherwise("VIA_MIXED")
    one_end = (F.col("from_ways") == 1) & (F.col("to_ways") == 1)
    middle = ((F.col("via_nodes") == 1) & (F.col("via_ways") == 0)) | ((F.col("via_ways") >= 1) & (F.col("via_nodes") == 0))
    t = t.select(
        "relation_id", via_class.alias("via_class"), ((F.col("ways") > 0) & (F.col("unwanted") == 0)).alias("in_scope"), value.alias("restriction_value"), conditional.alias("conditional"),
        (value.isNotNull() & ~tokens_overlap(F.col("tags")["except"], CAR_CLASSES)).alias("applies"), (one_end & middle).alias("canonical"),
    )
    status = (
        F.when(~F.col("in_scope"), "OUT_OF_SCOPE")
        .when(~F.col("applies"), F.when(F.col("conditional").isNotNull() & F.col("restriction_value").isNull(), "CONDITIONAL_ONLY").otherwise("NOT_APPLICABLE_MOTORCAR"))
        .when(~F.col("canonical"), "NONCANONICAL_STRUCTURE")
        .when(F.col("conditional").isNotNull(), "STATIC_PLUS_CONDITIONAL")
        .otherwise("STATIC_CANONICAL")
    )
    return t.withColumn("status", status)


def _product(lists: Column, kind: str) -> Column:
    """All ways to take one array from each of a list of lists of arrays, joined end to end."""
    start = F.array(F.array().cast(kind))
    return F.aggregate(lists, start, lambda done, more: F.flatten(F.transform(done, lambda a: F.transform(more, lambda b: F.concat(a, b)))))


def way_paths(spans: DataFrame, way_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(way_id, start, end, variants): the edge sequences along one way from node to node.

    ``spans``: way_id, start, end; ``way_nodes``: way_id, seq, node_id; ``edges``: edge_id,
    way_id, seq, way_direction.  Forward from an earlier to a later place, backward the other
    way, each only if every edge of the stretch is there.  Without one the span has no row.
    """
    at = lambda c, p: way_nodes.select("way_id", F.col("node_id").alias(c), F.col("seq").alias(p))
    s = spans.select("way_id", "start", "end").distinct().join(at("start", "i"), ["way_id", "start"]).join(at("end", "j"), ["way_id", "end"]).where("i <> j")
    s = s.withColumns({"way_direction": F.when(F.col("i") < F.col("j"), "FORWARD").otherwise("BACKWARD"), "lo": F.least("i", "j"), "hi": F.greatest("i", "j") - 1})
    steps = s.withColumn("seq", F.explode(F.sequence("lo", "hi"))).join(edges.select("way_id", "seq", "way_direction", "edge_id"), ["way_id", "seq", "way_direction"])
    order = F.when(F.col("way_direction") == "FORWARD", F.col("seq")).otherwise(-F.col("seq"))
    whole = steps.groupBy("way_id", "start", "end", "i", "j", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "edge_id"))).alias("e"), F.countDistinct("seq").alias("n"))
    ok = whole.where((F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.size("e") == F.col("n")))
    return ok.groupBy("way_id", "start", "end").agg(F.array_sort(F.collect_set(F.col("e.edge_id"))).alias("variants"))


def compile_relations(relations: DataFrame, way_nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, summary) of canonical relations.

    ``relations``: relation_id, restriction_value, via_class, via_node (null for via ways),
    ways (from way, via ways, to way in order).  sequences: relation_id, rule_kind, seq, each
    distinct edge sequence once.  summary: relation_id, rule_kind, compile_status, sequences,
    and the least and greatest length.  compile_status is UNSUPPORTED_RESTRICTION_VALUE,
    UNSUPPORTED_VIA_CLASS, NO_SHARED_NODE, AMBIGUOUS_CONNECTIONS, AMBIGUOUS_VIA_WAY_PATH,
    NO_ROUTABLE_SEQUENCE or COMPILED.  Ambiguous relations are named, not guessed.
    """
    v = F.col("restriction_value")
    kind = F.when(v.startswith("no_"), "NO_SEQUENCE").when(v.startswith("only_"), "ONLY_SEQUENCE").otherwise("UNSUPPORTED")
    r = relations.select("relation_id", kind.alias("rule_kind"), "via_class", "via_node", "ways")
    known = r.where("rule_kind <> 'UNSUPPORTED'")
    into = edges.select(F.col("way_id").alias("from_way"), F.col("v").alias("entry"), F.col("edge_id").alias("e1"))
    out = edges.select(F.col("way_id").alias("to_way"), F.col("u").alias("exit"), F.col("edge_id").alias("e2"))

    node = known.where("via_class = 'VIA_NODE'").select("relation_id", F.col("ways")[0].alias("from_way"), F.element_at("ways", -1).alias("to_way"), F.col("via_node").alias("entry"), F.col("via_node").alias("exit"))
    found = node.join(into, ["from_way", "entry"]).join(out, ["to_way", "exit"]).select("relation_id", F.array("e1", "e2").alias("seq"))

    # Nodes that neighbours in a chain share: one option list for each of its joints.
    chain = known.where("via_class = 'VIA_WAY'")
    joints = chain.select("relation_id", "ways", F.explode(F.sequence(F.lit(0), F.size("ways") - 2)).alias("k"))
    joints = joints.select("relation_id", "k", F.expr("ways[k]").alias("a"), F.expr("ways[k + 1]").alias("b"))
    on = lambda c: way_nodes.select(F.col("way_id").alias(c), "node_id").where("node_id is not null").distinct()
    shared = joints.join(on("a"), "a").join(on("b"), ["b", "node_id"]).groupBy("relation_id", "k").agg(F.array_sort(F.collect_set("node_id")).alias("options"))
    options = joints.select("relation_id", "k").join(shared, ["relation_id", "k"], "left").groupBy("relation_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("options", F.array().cast("array<bigint>")).alias("o")))), lambda x: x["o"]).alias("options")
    )
    # Joints multiply: as doubles, so that no chain overflows.
    many = F.aggregate("options", F.lit(1.0), lambda n, o: n * F.size(o).cast("double"))
    state = F.when(many == 0, "NO_SHARED_NODE").when(many > MOST_COMBINATIONS, "AMBIGUOUS_CONNECTIONS")
    options = options.withColumn("problem", state)
    combos = options.where("problem is null").select("relation_id", F.posexplode(_product(F.transform("options", lambda o: F.transform(o, lambda x: F.array(x))), "array<bigint>")).alias("combo", "at")).join(chain.select("relation_id", "ways"), "relation_id")
    spans = combos.select("relation_id", "combo", F.posexplode(F.arrays_zip(F.slice("ways", F.lit(2), F.size("ways") - 2).alias("w"), F.slice("at", F.lit(1), F.size("at") - 1).alias("s"), F.slice("at", F.lit(2), F.size("at") - 1).alias("e"))).alias("k", "z"))
    spans = spans.select("relation_id", "combo", "k", F.col("z.w").alias("way_id"), F.col("z.s").alias("start"), F.col("z.e").alias("end"))
    along = spans.join(way_paths(spans, way_nodes, edges), ["way_id", "start", "end"], "left")
    parts = along.groupBy("relation_id", "combo").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "variants"))), lambda x: x["variants"]).alias("variants"), F.min(F.col("variants").isNotNull()).alias("whole"), F.max(F.coalesce(F.size("variants"), F.lit(0)) > MOST_VARIANTS).alias("wild")
    )
    wild = parts.groupBy("relation_id").agg(F.max("wild").alias("wild"))
    paths = combos.join(parts, ["relation_id", "combo"]).where("whole and not wild").join(wild.where("not wild").select("relation_id"), "relation_id", "left_semi")
    middle = paths.select("relation_id", F.col("ways")[0].alias("from_way"), F.element_at("ways", -1).alias("to_way"), F.col("at")[0].alias("entry"), F.element_at("at", -1).alias("exit"), F.explode(_product(F.col("variants"), "array<bigint>")).alias("mid"))
    over = middle.join(into, ["from_way", "entry"]).join(out, ["to_way", "exit"]).select("relation_id", F.concat(F.array("e1"), "mid", F.array("e2")).alias("seq"))

    sequences = found.unionByName(over).distinct().join(r.select("relation_id", "rule_kind"), "relation_id").select("relation_id", "rule_kind", "seq")
    count = sequences.groupBy("relation_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("seq")).alias("shortest"), F.max(F.size("seq")).alias("longest"))
    t = r.join(count, "relation_id", "left").join(options.select("relation_id", "problem"), "relation_id", "left").join(wild, "relation_id", "left")
    status = (
        F.when(F.col("rule_kind") == "UNSUPPORTED", "UNSUPPORTED_RESTRICTION_VALUE")
        .when(~F.col("via_class").isin("VIA_NODE", "VIA_WAY"), "UNSUPPORTED_VIA_CLASS")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.coalesce("wild", F.lit(False)), "AMBIGUOUS_VIA_WAY_PATH")
        .when(F.col("n").isNull(), "NO_ROUTABLE_SEQUENCE")
        .otherwise("COMPILED")
    )
    return sequences, t.select("relation_id", "rule_kind", status.alias("compile_status"), F.coalesce("n", F.lit(0)).alias("sequences"), "shortest", "longest")


def contract_breaches(df: DataFrame, status: str, code: str, contract: dict[str, int]) -> DataFrame:
    """(status, code, expected, n) of rows whose code isn't the one of their status; an unknown status expects none."""
    expected = F.create_map(*[F.lit(x) for kv in contract.items() for x in kv])[F.col(status)]
    t = df.select(F.col(status).alias("status"), F.col(code).alias("code"), expected.alias("expected"))
    return t.where(~F.col("code").eqNullSafe(F.col("expected"))).groupBy("status", "code", "expected").agg(F.count(F.lit(1)).alias("n"))


def edge_balance(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """(direction_code, expected, actual, n): edges a segment should have, one for each open direction, against those it has.

    ``segments``: segment_uid, direction_code; ``edges``: segment_uid, way_direction.
    """
    have = edges.groupBy("segment_uid").agg(F.countDistinct("way_direction").alias("actual"), F.max((F.col("way_direction") == "FORWARD").cast("int")).alias("f"), F.max((F.col("way_direction") == "BACKWARD").cast("int")).alias("b"))
    c = F.col("direction_code")
    fwd, bwd = c.isin("0", "1").cast("int"), c.isin("0", "-1").cast("int")
    t = segments.join(have, "segment_uid", "left").select("direction_code", (fwd + bwd).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"), ((F.coalesce("f", F.lit(0)) > fwd) | (F.coalesce("b", F.lit(0)) > bwd)).alias("against"))
    return t.groupBy("direction_code", "expected", "actual", "against").agg(F.count(F.lit(1)).alias("n"))
