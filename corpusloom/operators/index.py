"""The stored lexical index: postings with positions, as a table that grows by generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import phrases
from corpusloom.operators.retrieve import _all_else_any, _scored, small, top_k
from corpusloom.sources.generations import Generations


class StoredIndex:
    """Rows source, key, term, tf, positions, dl, ranged by term, so that a search skips the files and row groups of other terms; a row without term
    for each document says how long it is. refresh writes the rows of its own sources as a new generation; older ones of these sources don't count any more.
    """

    def __init__(self, spark: SparkSession, root: str, tokens=phrases.phrase_tokens):
        self.spark, self.tokens = spark, tokens
        self.table = Generations(spark, root, "source", "term")

    def _rows(self, docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
        toks = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), self.tokens(F.col(text)).alias("t")).withColumn("dl", F.size(F.filter("t", lambda t: t != "")))
        # each document has a row without term, at no place
        each = toks.select("key", "source", "dl", F.explode(F.concat(F.transform("t", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("pos"))))).alias("h"))
        each = each.select("key", "source", "dl", "h.*").filter("term is null or term <> ''")
        return each.groupBy("source", "key", "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"))

    def exists(self) -> bool:
        return self.table.exists()

    def rebuild(self, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> None:
        """The whole index anew."""
        self.table.replace_all(self._rows(docs, key, source, text))

    def refresh(self, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", gone: DataFrame | None = None) -> None:
        """The sources in docs, and those in gone, have the rows of docs from now on."""
        self.table.append(self._rows(docs, key, source, text), gone)

    def remove(self, gone: DataFrame) -> None:
        self.table.delete(gone)

    def compact(self) -> None:
        self.table.compact()

    def _found(self, terms: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """Postings of the terms, and one row of totals."""
        rows, newest = self.table.rows()
        n = terms.count()
        if n <= phrases.MOST_LITERALS:  # names reach the scan
            some = rows.filter(F.col("term").isin(*[r["term"] for r in terms.collect()]))
        else:
            some = rows.filter("term is not null").join(small(terms, n), "term", "left_semi")
        totals = self.table.living(rows.filter("term is null").select("source", "dl", "gen"), newest).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return self.table.living(some, newest).withColumnRenamed("key", key), totals

    def search(self, queries: DataFrame, k: int, key: str = "doc_id", allowed: DataFrame | None = None) -> DataFrame:
        """As phrases.bm25_phrases gives them for queries (query_id, query); allowed (key) are the documents that may be hits."""
        units = phrases.staged(phrases.phrase_units(queries), "asked")
        found, totals = self._found(units.select(F.explode("unit").alias("term")).distinct(), key)
        scored = phrases.score_units(phrases.staged(found, "postings"), totals, units, key)
        return phrases.ranked(scored if allowed is None else scored.join(allowed.select(key).distinct(), key, "left_semi"), k, key)

    def search_words(self, queries: DataFrame, k: int, key: str = "doc_id", every: bool | None = False) -> DataFrame:
        """As retrieve.bm25 gives them for queries (query_id, term); with every=None all terms, else any."""
        q = queries.select("query_id", "term").distinct()
        found, totals = self._found(q.select("term").distinct(), key)
        scored = _scored(found, found.groupBy("term").agg(F.count("*").alias("df")), totals, q, key, every)
        return _all_else_any(scored, k, key) if every is None else top_k(scored, k, ["query_id"], [F.col("score").desc(), F.col(key)])
