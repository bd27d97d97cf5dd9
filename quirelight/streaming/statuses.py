"""Status transitions as a stream: the state of each publication's stages.

The state of a key is the last transition by its order, how often one came, and
when the last was; events may come late and in any order.  Spark keeps it in its
state store and restores it from the checkpoint, so a query that is started
again counts nothing twice.  ``update_stream`` publishes what each batch changed
into a store, together with the batch's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..sources.snapshots import Store

STATE = "status string, error string, moment timestamp, tie long, attempts long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """One value a key: the last transition, and how many there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else (None, None, None, None, 0)
        best, n = held[:4], held[4]
        for frame in rows:
            n += len(frame)
            # the last by moment, then by the tie's number
            top = frame.sort_values(["moment", "tie"], kind="stable").iloc[-1]
            new = (top["status"], top["error"], top["moment"].to_pydatetime(), int(top["tie"]))
            if best[2] is None or (new[2], new[3]) >= (_plain(best[2], new[2]), best[3]):
                best = new
        self.state.update((*best, n))
        yield pd.DataFrame({"publication": [key[0]], "stage": [key[1]], "status": [best[0]], "attempts": [n], "updated": [best[2]], "error": [best[1]]})

    def close(self) -> None:
        """Nothing is open."""


def _plain(moment: object, like: object) -> object:
    """A stored moment in the zone, or without one, that new ones have."""
    return moment.replace(tzinfo=like.tzinfo) if moment.tzinfo != like.tzinfo else moment


def folded_stream(transitions: DataFrame) -> DataFrame:
    """publication, stage, status, attempts, updated, error of the keys that each batch touches.

    ``transitions`` (a stream or a table) has publication, stage, status, error,
    moment and tie, a number that orders transitions of one moment.
    """
    kind = transitions.schema["publication"].dataType
    out = StructType([StructField("publication", kind), StructField("stage", StringType()), StructField("status", StringType()), StructField("attempts", LongType()), StructField("updated", TimestampType()), StructField("error", StringType())])
    rows = transitions.select("publication", "stage", "status", "error", "moment", F.col("tie").cast("long").alias("tie"))
    return rows.groupBy("publication", "stage").transformWithStateInPandas(Fold(), out, "Update", "None")


def update_stream(transitions: DataFrame, sink: str, state: str) -> StreamingQuery:
    """Keep table statuses of the store ``sink`` up to date with a stream of transitions.

    A batch's changes and its number are one state of the store; a batch that
    is run again finds its number and does nothing.
    """
    spark = transitions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    mark = f"batch:{state}"

    def publish(batch: DataFrame, number: int) -> None:
        store = Store(spark, sink)
        last = store.mark(mark)
        if last is not None and number <= last:
            batch.write.format("noop").mode("overwrite").save()  # the state of a batch is kept when its rows are computed
            return
        keyed = batch.withColumn("key", F.to_json(F.struct("publication", "stage")))
        with store.begin() as t:
            if store.exists("statuses"):
                t.upsert("statuses", keyed, "key")
            else:
                t.replace("statuses", keyed, "key")
            t.set_mark(mark, number)

    return folded_stream(transitions).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", state).trigger(availableNow=True).start()
