"""Shared pieces of the training-data operators: tables, folds, shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod FOLDS equals HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no model may learn from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Shared:
    """Intermediate tables in the folder that the cluster shares.

    ``spark.checkpoint.dir`` names the folder; where it is unset a session in one
    process (tests) uses a temporary folder of this machine, and a cluster is
    refused, as its executors would not see one.  Tables are
    Parquet, so a lost executor never costs what is written, and the plan that
    reads one is short again.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        self.root = f"{root or tempfile.mkdtemp(prefix='enclosa-')}/enclosa/{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[str] = []
        self.tables: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back; its lineage ends here."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dealt(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Writes ``df`` in buckets of ``key``, one file each: joins on the key then move only the other side."""
        self.n += 1
        path, n = f"{self.root}/{self.n}-{name}", partitions(self.spark)
        named = "enclosa_" + uuid.uuid4().hex
        df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(named)
        self.paths.append(path)
        self.tables.append(named)
        return self.spark.table(named)

    def drop(self, df: DataFrame) -> None:
        """Deletes what keep() wrote, once nothing reads it any more."""
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if self.root.rpartition("/")[2] in folder:
                self._delete(folder)

    def finish(self, df: DataFrame) -> DataFrame:
        """Keeps a result and deletes everything that was kept before it."""
        before, self.paths = self.paths, []
        out = self.keep(df, "result")
        for named in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {named}")
        for path in before:
            self._delete(path)
        self.release()
        return out

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that are finished with."""
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
