"""A stream of queries, searched in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.plans.search import Catalogue


def search_stream(queries: DataFrame, catalogue: Catalogue, path: str, checkpoint: str, limit: int = 10, once: bool = False) -> StreamingQuery:
    """queries: a stream of query_id, q and optionally vector, else the catalogue's embedder makes it. Appends each micro-batch's ranked results to path, in a folder by batch: a retried batch overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        catalogue.search_many(batch, limit).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    writer = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
