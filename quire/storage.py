"""Tables in shared storage: what cuts lineage, survives lost executors and keeps one reading of an unordered plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a local session makes its own; a cluster can't."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Stored:
    """A table written once to the shared folder and read back.

    A lost executor costs nothing: the files are in shared storage and a retried read finds them again. ``drop`` frees
    the files once no later plan needs them, ``release`` those of all tables of a session.
    """

    held: dict[str, Stored] = {}

    def __init__(self, df: DataFrame, name: str = "t"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/quire-{name}-{uuid.uuid4().hex}"
        self._write(df)
        Stored.held[self.path] = self

    def _write(self, df: DataFrame) -> None:
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        Stored.held.pop(self.path, None)


class Bucketed(Stored):
    """A table stored in buckets by some columns: joins and groups by these do not shuffle it again.

    ``dealt`` shuffles the rows first, so that a bucket is one file; rows that already come in few buckets a task need not.
    """

    def __init__(self, df: DataFrame, by: list[str], name: str = "t", dealt: bool = True):
        self.by, self.dealt, self.table = by, dealt, f"quire_{uuid.uuid4().hex}"
        self.buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        super().__init__(df, name)

    def _write(self, df: DataFrame) -> None:
        df = df.repartition(self.buckets, *self.by) if self.dealt else df
        df.write.bucketBy(self.buckets, *self.by).option("path", self.path).option("compression", "zstd").format("parquet").saveAsTable(self.table)
        self.df = self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
        super().drop()


def release(spark: SparkSession) -> None:
    """Frees every stored table of the session; what was returned by then must have been written."""
    for held in [h for h in Stored.held.values() if h.spark is spark]:
        held.drop()
