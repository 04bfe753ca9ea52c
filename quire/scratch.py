"""Tables that an operator writes and reads again.

They are Parquet folders under ``spark.checkpoint.dir`` (read from the session; where it is unset, in a temporary folder of
a local master, as in tests, and an error on a cluster). They cut lineage: a lost executor costs the tasks that ran there,
not the job. Tables that a result reads live as long as the session, or until ``close``; the session's end deletes them.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables of one operator run, in a folder of their own that all executors share."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"{tempfile.gettempdir()}/checkpoints"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        self.tables: list[str] = []

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back: computed once, and recovered from files instead of from its lineage."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{label}")

    def cut_by(self, df: DataFrame, label: str, key: str) -> DataFrame:
        """``cut`` into buckets by ``key``: plans that join or group such tables by it need no exchange.

        There are as many buckets as the session has shuffle partitions. ``df`` is to be partitioned by ``key`` alike, as
        are plans over such tables (``deal`` does it for others); else each task would write a file to each bucket.
        Joins merge such tables: by the size of its files, many times smaller than its rows, one would be broadcast.
        """
        name = f"quire_{uuid.uuid4().hex}"
        out = df.write.bucketBy(self.buckets(), key).option("compression", "zstd").option("path", f"{self.root}/{label}")
        out.saveAsTable(name)
        self.tables.append(name)
        return self.spark.read.table(name).hint("merge")

    def deal(self, df: DataFrame, label: str, key: str) -> DataFrame:
        """``cut_by`` of a table that comes in any order: exchanged once."""
        return self.cut_by(df.repartition(self.buckets(), key), label, key)

    def buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def close(self) -> None:
        """Delete all of it: for who has read the results."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        self.tables.clear()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *labels: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
