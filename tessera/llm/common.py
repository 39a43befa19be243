"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table of up to so many rows of a few numbers is sent to all executors; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session that runs in this one process may leave it unset, as tests do; it then gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator in the shared folder, by name; those that nothing reads any more can be deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.rows = spark, scratch_path(spark, name), {}
        self.tables: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str, *sums: Column) -> DataFrame:
        """``df`` written and read back; ``rows[name]`` is what ``sums`` came to, the number of rows first."""
        seen, made = Observation(), self.tables.setdefault(name, [])
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        made.append(path)
        df.observe(seen, F.count(F.lit(1)).alias("n"), *sums).write.parquet(path)
        self.rows[name] = tuple(seen.get.values())
        return self.spark.read.schema(df.schema).parquet(path)

    def count(self, name: str) -> int:
        return self.rows[name][0]

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names."""
        for name in names:
            for path in self.tables.pop(name, []):
                delete(self.spark, path)

    def drop_older(self, name: str) -> None:
        for path in self.tables[name][:-1]:
            delete(self.spark, path)
        del self.tables[name][:-1]

    def keep(self, *names: str) -> None:
        """Deletes all tables but those of these names."""
        self.drop(*(n for n in list(self.tables) if n not in names))


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which what its Python worker has freed goes back to the system, for the worker lives on."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be sent to all executors if its counted ``rows`` are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
