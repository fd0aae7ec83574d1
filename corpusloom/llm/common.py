"""What the corpus operators share: table access, staged tables, session limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch sent to a Python worker. Bounds a worker's memory when texts are long.
BATCH_ROWS = "500"
BATCH_BYTES = str(8 << 20)

#: Words in a shingle and the least similarity of near duplicates, where a contract says nothing else.
SHINGLE_WORDS = 5
NEAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a batch of very long texts fits a worker, and let local workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset and one machine runs everything, a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch.get():
        _scratch.get()[-1].append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


#: The open blocks of this thread or task; another one's never see its tables.
_scratch: ContextVar[tuple[list, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables staged inside the block when it ends, but for those passed to the yielded function, which results still read."""
    around, tables, kept = _scratch.get(), [], set()
    token = _scratch.set((*around, tables))

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_path)
        return df

    try:
        yield keep
    finally:
        _scratch.reset(token)
        if around:  # what outlives this block belongs to the one around it
            around[-1].extend((s, p) for s, p in tables if p in kept)
        for spark, path in tables:
            if path not in kept:
                _delete(spark, path)


def ranged(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df staged in ranges of its order, with the number of its range as _p: no key, however common, is one task's alone."""
    return staged(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), name)


def numbered(df: DataFrame, column: str, *order: str | Column) -> DataFrame:
    """df with a row's place in the order, from 0. Each range is numbered apart, after the counts of the ranges before it: one row a range."""
    parts = ranged(df, "numbered", *order)
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_before")
    return parts.join(F.broadcast(before), "_p").withColumn(column, place.cast("long")).drop("_p", "_before")


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(column: str = "text") -> Column:
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: A table is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within BROADCAST_BYTES, else unchanged, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
