"""Records that arrive as a stream, matched against a static pool in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import blocking


def link(stream: DataFrame, pool: DataFrame, out: str, checkpoint: str, top: int = 20, trigger: str | None = None) -> StreamingQuery:
    """Block each micro-batch of queries (qid, name, address, country); Parquet by batch, replayed batches overwrite theirs."""
    index = blocking.index(blocking.keys(pool, "tid"))
    index.write.mode("overwrite").parquet(f"{checkpoint}-index")  # every batch reads it; it outlives lost executors
    index = pool.sparkSession.read.schema(index.schema).parquet(f"{checkpoint}-index")

    def each(batch: DataFrame, number: int) -> None:
        blocking.search(blocking.keys(batch, "qid"), index, top).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
