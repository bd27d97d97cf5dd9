"""The chunking stage over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import Limits, chunks
from ..sources.snapshots import Store
from ..sources.writers import only_new


def chunk_stream(spark: SparkSession, source: str, schema: str, sink: str, state: str, strategy: str = "hybrid", limits: Limits = Limits()) -> StreamingQuery:
    """Chunks of Parquet documents as they arrive; a document that is stored is skipped.

    The sink is a store with the tables chunks and documents.  A batch's rows
    of both and its number are published at once, so a batch that is run again
    finds its number and does nothing.  Documents are compared by id with the
    buckets that the batch touches, before they are cut.  Of a document that a
    batch repeats, one text is taken (the least).
    """
    documents = spark.readStream.schema(schema).parquet(source)
    mark = f"batch:{state}"

    def publish(batch: DataFrame, number: int) -> None:
        store = Store(spark, sink)
        last = store.mark(mark)
        if last is not None and number <= last:
            return
        key = batch.columns[0]
        named = batch.withColumn("doc", F.col(key).cast("string")).persist()
        try:
            new = only_new(named, store.beside("documents", named.select("doc")), "doc") if store.exists("documents") else named
            new = new.groupBy("doc").agg(F.min_by(F.struct(*batch.columns), "text").alias("row"))
            with store.begin() as t:
                t.append("chunks", chunks(new.select("row.*"), strategy, limits), "doc")
                t.append("documents", new.select("doc"), "doc")
                t.set_mark(mark, number)
        finally:
            named.unpersist()

    return documents.writeStream.foreachBatch(publish).option("checkpointLocation", state).trigger(availableNow=True).start()
