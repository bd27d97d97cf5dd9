"""Cutting lineage on storage that all executors share.

The folder is ``spark.checkpoint.dir`` when the session names one (a cluster
must); otherwise, as in tests in one process, a temporary folder is set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quirelight-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder.

    Note that a checkpoint hands on the optimizer's estimate of its size, a
    product of the estimates at each join; a loop that joins two results of
    its last round must pass one through ``written``, which is measured.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` stored as Parquet in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete what ``written`` stored, when nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two columns of whole numbers as one blob a task, for the driver."""
    held = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1) for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype(np.int64).tobytes()], pa.binary())], names=["blob"])


def unpacked(rows: list[Row]) -> np.ndarray:
    """The rows of such blobs."""
    return np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(r.blob, np.int64).reshape(-1, 2) for r in rows)])
