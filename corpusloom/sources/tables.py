"""Tables of a library folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, text) of Markdown or text files, one row a file."""
    found = spark.read.text(paths, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return found.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; broken lines give nulls."""
    return spark.read.schema(schema).json(path)


def parent_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lists of parents, one file a source; corrupt and empty files are skipped."""
    return spark.read.schema(schema + ", _corrupt string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").filter("_corrupt is null").drop("_corrupt")


def csv_rows(spark: SparkSession, paths: list[str], key: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header; of rows that share a key the one in the last file named wins."""
    from functools import reduce

    parts = [spark.read.schema(schema).csv(p, header=True, multiLine=True, escape='"').withColumn("_file", F.lit(i)) for i, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "_file")]), "_file").alias("r")).select(key, "r.*")


def missing_files(wanted: DataFrame, present: DataFrame, name: str = "stem") -> DataFrame:
    """Wanted stems without a file."""
    return wanted.join(present, name, "left_anti")
