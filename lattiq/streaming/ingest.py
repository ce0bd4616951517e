"""Continuous additions: a stream of documents appended to an index in micro-batches.

Each micro-batch is one ``add``.  Its number is stored in the version that holds its documents and becomes visible
with them, so a batch that is delivered twice after a failure is recognised and every document is added once.  The
``doc_id`` of a document is kept in the metadata of the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattiq.functions.scratch import Scratch
from lattiq.plans.engine import Engine


def add_batch(engine: Engine, batch: DataFrame, number: int, name: str) -> None:
    """Add the documents ``(doc_id, vecs)`` of one micro-batch unless that was done before."""
    if number <= engine.meta().get("streams", {}).get(name, -1):
        return
    # dense ids by running counts over hash buckets, then within a bucket: no global sort in one task
    keyed = batch.where("size(vecs) > 0").withColumn("bucket", F.expr("cast(pmod(xxhash64(doc_id), 256) as int)"))
    head = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.expr("sum(n) over (order by bucket) - n")).drop("n")
    dense = keyed.withColumn("inner", F.expr("row_number() over (partition by bucket order by doc_id)")).join(F.broadcast(head), "bucket")
    dense = Scratch(batch.sparkSession, "stream").write(dense.selectExpr("before + inner - 1 as pid", "doc_id", "vecs"), "dense")
    engine.add(dense.selectExpr("pid", "posexplode(vecs) as (pos, vec)"), reload=False, names=dense.select("pid", "doc_id"), stream=(name, number))


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, name: str = "documents") -> StreamingQuery:
    """Start the additions; ``stream`` has (doc_id, vecs: array of vectors)."""
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: add_batch(engine, df, n, name)).start()
