"""The derived views over streams of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusradar.sources.views import Tables
from corpusradar.streaming.state import file_system


class StreamTables(Tables):
    """Like ``Tables``, but every table is read as a stream; times come as instants, which watermarks need."""

    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        reader = self.spark.readStream.schema(self.spark.read.parquet(path).schema)
        where, fs = file_system(self.spark, path)
        if fs.getFileStatus(where).isDirectory():  # a table of many files, to which more may come
            stream = reader.parquet(path)
        else:
            stream = reader.option("pathGlobFilter", f"{name}*.parquet").option("recursiveFileLookup", "true").parquet(self.folder)
        return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream
