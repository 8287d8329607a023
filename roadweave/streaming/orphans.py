"""The orphan state fed by a stream: every micro-batch of references is one batch of the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadweave.operators.orphans import OrphanState, Relation


def follow(parents: DataFrame, children: DataFrame, relation: Relation, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that takes new parent rows and references into the state named ``path``.

    Both are streams of rows as the relation names them; they are read as one stream with a
    mark, so a micro-batch holds what arrived of either side.  A micro-batch that is given
    again after a failure changes nothing, as repeated rows don't.  ``once`` ends the query
    when all that is there has been taken in.
    """
    r = relation
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in r.child_key])
    gone = F.col(r.deleted).cast("timestamp") if r.deleted in parents.columns else F.lit(None).cast("timestamp")
    empty = lambda t, n: F.lit(None).cast(t).alias(n)
    p = parents.select(F.lit(True).alias("_parent"), F.col(r.parent_key).cast("string").alias("ref"), F.col(r.loaded).alias("loaded_at"), gone.alias("deleted_at"), empty("string", "child_key"))
    c = children.select(F.lit(False).alias("_parent"), F.col(r.ref).cast("string").alias("ref"), F.col(r.loaded).alias("loaded_at"), empty("timestamp", "deleted_at"), key.alias("child_key"))
    inner = Relation(r.child, ("child_key",), "ref", r.parent, "ref")

    def take(batch: DataFrame, _: int) -> None:
        state = OrphanState(batch.sparkSession, inner, path)
        batch = batch.persist()
        try:
            state.advance(batch.where("_parent"), batch.where("not _parent"))
        finally:
            batch.unpersist()

    writer = p.unionByName(c).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
