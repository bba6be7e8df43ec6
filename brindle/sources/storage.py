"""Versioned Parquet snapshots.

A table's version is a list of folders that are written once and never changed.
INSERT adds a folder; UPDATE and DELETE rewrite the folders that hold rows they
change and keep the others. Old versions stay readable until they are vacuumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Storage:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")

    def write(self, table: str, df: DataFrame, sort_by: Sequence[str] = ()) -> str:
        """Write *df* as a new folder of *table*; rows sorted within files, so that the
        statistics of row groups let lookups on these columns skip most of a file."""
        folder = f"{self.warehouse}/{table}/part-{uuid.uuid4().hex}"
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        df.write.mode("errorifexists").parquet(folder)
        return folder

    def read(self, folders: Sequence[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def delete(self, path: str) -> None:
        target, fs = self._fs(path)
        fs.delete(target, True)

    def names(self, folder: str) -> list[str]:
        target, fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def read_text(self, path: str) -> str:
        target, fs = self._fs(path)
        stream = fs.open(target)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create_text(self, path: str, text: str) -> bool:
        """Write a new file; False if there is one of that name."""
        target, fs = self._fs(path)
        try:
            stream = fs.create(target, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True
