"""Files under a root, by any scheme that Hadoop opens."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder where all executors see it: below spark.checkpoint.dir, or temporary in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quirelight-")
    return f"{named.rstrip('/')}/work-{uuid.uuid4().hex}"


@dataclass
class Storage:
    """put, get, list, exists, copy, move, delete; paths are relative to the root."""

    spark: SparkSession
    root: str

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{path}" if path else self.root)

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs().exists(self._at(path))

    def put(self, path: str, data: bytes) -> None:
        """Written aside, then renamed, so that a reader sees all of it or nothing."""
        fs, aside = self._fs(), self._at(path + ".part")
        out = fs.create(aside, True)
        out.write(bytearray(data))
        out.close()
        fs.delete(self._at(path), False)
        if not fs.rename(aside, self._at(path)):
            raise OSError(f"cannot write {path}")

    def create(self, path: str, data: bytes) -> bool:
        """A file that is not there yet, all of it at once; False if it is (atomic where the file system's rename is)."""
        aside = self._at(f"{path}.{uuid.uuid4().hex}.part")
        out = self._fs().create(aside, False)
        out.write(bytearray(data))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration())
        if not self.exists(path):
            try:
                context.rename(aside, self._at(path), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                    raise
        self._fs().delete(aside, False)
        return False

    def text(self, path: str) -> str:
        """A small file, read by the driver."""
        stream = self._fs().open(self._at(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it is not there."""
        fs, at = self._fs(), self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def get(self, path: str) -> bytes:
        found = self.spark.read.format("binaryFile").load(str(self._at(path).toString())).select("content").first()
        return bytes(found[0])

    def list(self, path: str = "", pattern: str = "*") -> DataFrame:
        """path, length of files below, partial ones left out; empty if the folder is not there."""
        if not self.exists(path):
            return self.spark.createDataFrame([], "path string, length long")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(self._at(path).toString())
        return files.where(~F.col("path").endswith(".part")).select("path", "length")

    def copy(self, path: str, to: str) -> None:
        self.put(to, self.get(path))

    def move(self, path: str, to: str) -> None:
        if not self._fs().rename(self._at(path), self._at(to)):
            raise OSError(f"cannot move {path}")

    def drop(self, path: str) -> bool:
        """Delete a folder by its whole path."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def delete(self, path: str) -> bool:
        return self._fs().delete(self._at(path), True)
