"""Sinks: ledgers, bibliographies, edge mirrors, reports. Spark's committers publish whole outputs or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.titles import bibtex_key


def append_ledger(records: DataFrame, path: str, session: str) -> None:
    """Claims of a session as JSON lines, added to what is there."""
    records.select(F.current_timestamp().alias("ts"), F.lit(session).alias("session"), *records.columns).write.mode("append").json(path)


def bibtex_entry(key: Column, meta: Column) -> Column:
    """An @article entry, @misc without a journal, of a struct with title, authors, year, journal and doi."""
    line = lambda name, v: F.when(v != "", F.concat(F.lit(f"  {name} = {{"), v, F.lit("}")))
    fields = F.concat_ws(",\n", line("title", meta["title"]), line("author", F.replace(meta["authors"], F.lit(";"), F.lit(" and"))), line("year", meta["year"]), line("journal", meta["journal"]), line("doi", meta["doi"]))
    return F.concat(F.when(meta["journal"] != "", "@article{").otherwise("@misc{"), key, F.lit(",\n"), fields, F.lit("\n}"))


def bibliography(papers: DataFrame) -> DataFrame:
    """source, key, entry: one entry a source; keys that collide get the letters a to j in order of source, then numbers.

    papers: source, meta.
    """
    one = papers.groupBy("source").agg(F.min_by("meta", F.to_json("meta")).alias("meta"))
    based = one.withColumn("base", bibtex_key(F.col("meta.authors"), F.col("meta.year"), F.col("meta.title")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("source"))
    total = F.count("*").over(Window.partitionBy("base"))
    suffix = F.when(total == 1, "").when(n <= 10, F.substring(F.lit("abcdefghij"), n, F.lit(1))).otherwise((n - 10).cast("string"))
    keyed = based.withColumn("key", F.concat("base", suffix))
    return keyed.select("source", "key", bibtex_entry(F.col("key"), F.col("meta")).alias("entry"))


def edge_mirror(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges with title and year of both ends, for a CSV file. papers: source, title, year."""
    side = lambda end: papers.select(F.col("source").alias(end), F.col("title").alias(f"{end}_title"), F.col("year").alias(f"{end}_year"))
    return edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").select("src", "src_title", "src_year", "dst", "dst_title", "dst_year")


def audit_summary(audits: DataFrame) -> DataFrame:
    """status, n, share, flagged of audit rows (file, status, identity_flags)."""
    out = audits.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.size("identity_flags") > 0).alias("flagged"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
