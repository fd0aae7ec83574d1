"""A library: tables under one root, and what a user does with them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.metadata import metadata_text
from corpusloom.functions.models import hashed_vector
from corpusloom.operators import chunking, converge, graph, quality
from corpusloom.operators import retrieve as rt
from corpusloom.operators.index import StoredIndex
from corpusloom.operators.phrases import phrase_tokens
from corpusloom.sources.generations import Generations
from corpusloom.sources.staging import staged

TABLES = ("documents", "parents", "children", "metrics", "edges", "meta")


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting by precedence: environment (CORPUSLOOM_NAME), session (corpusloom.name), default."""
    return os.environ.get("CORPUSLOOM_" + name.upper().replace(".", "_")) or spark.conf.get(f"corpusloom.{name}", None) or default


#: Hits that one agent search may return.
MOST_HITS = 6


class Library:
    """Documents, parents, children with vectors, a lexical index, graph and metadata as tables that grow by generations."""

    def __init__(self, spark: SparkSession, root: str, embed=hashed_vector):
        self.spark, self.root, self.embed = spark, root.rstrip("/"), embed
        self.index = StoredIndex(spark, f"{self.root}/index")

    def _stored(self, name: str) -> Generations:
        return Generations(self.spark, f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self._stored(name).exists()

    def table(self, name: str) -> DataFrame:
        return self._stored(name).read()

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a whole table; one without a source column is dealt by its first."""
        Generations(self.spark, f"{self.root}/{name}", "source" if "source" in df.columns else df.columns[0]).replace_all(df)

    def scaffold(self) -> None:
        """The library's tables, empty, where they don't exist, so that every question has an answer before the first ingest."""
        schemas = {
            "documents": "source string, text string, hash string", "children": "parent_id string, idx int, text string, source string, section string, vector array<double>",
            "parents": "source string, section string, chunk_type string, label string, content string, parent_id string, word_count long, char_count long",
        }
        for name, schema in schemas.items():
            if not self.has(name):
                self.write(name, self.spark.createDataFrame([], schema))
        if not self.index.exists():
            self.rebuild_index()

    def _indexed(self, parents: DataFrame) -> DataFrame:
        """parent_id, source, text: what the lexical index searches, the content and the source's metadata."""
        meta = self.table("meta") if self.has("meta") else None
        rows = parents.select("parent_id", "source", "content")
        if meta is None:
            return rows.select("parent_id", "source", F.col("content").alias("text"))
        known = meta.select("source", metadata_text(F.col("title"), F.col("authors"), F.col("journal"), F.col("year").cast("string")).alias("_m"))
        return rows.join(known, "source", "left").select("parent_id", "source", F.concat_ws(" ", "content", "_m").alias("text"))

    def rebuild_index(self) -> None:
        self.index.rebuild(self._indexed(self.table("parents")), "parent_id")

    def ingest(self, docs: DataFrame) -> int:
        """Clean, cut and chunk documents (source, text) that are new or changed; the number of them."""
        log = self.table("documents").select("source", "hash") if self.has("documents") else self.spark.createDataFrame([], "source string, hash string")
        fresh = chunking.changed(docs.select("source", "text"), log)
        from corpusloom.functions.text import before_references, clean_lines

        fresh = staged(fresh.withColumn("text", before_references(clean_lines(F.col("text")))).filter(F.length("text") >= 500), "fresh")
        parents = chunking.parents(fresh).dropDuplicates(["parent_id"])
        kids = chunking.children(parents.select("parent_id", "content")).join(parents.select("parent_id", "source", "section"), "parent_id").withColumn("vector", self.embed(F.substring("text", 1, 2000)))
        parents = staged(parents, "parents")
        for name, new in (("documents", fresh.select("source", "text", "hash")), ("parents", parents), ("children", kids)):
            self._stored(name).append(new, gone=fresh.select("source"))
        if self.index.exists():
            self.index.refresh(self._indexed(parents), "parent_id", gone=fresh.select("source"))
        elif not parents.isEmpty():
            self.rebuild_index()
        return fresh.count()

    def remove(self, patterns: list[str], dry_run: bool = True, exact: bool = False) -> int:
        """Rows of documents that go; with dry_run=False they and their chunks are gone."""
        before = self.table("documents")
        after = quality.remove_papers(before, patterns, exact=exact)
        n = before.count() - after.count()
        if not dry_run and n:
            gone = staged(before.join(after.select("source").distinct(), "source", "left_anti").select("source").distinct(), "gone")
            for name in ("documents", "parents", "children"):
                self._stored(name).delete(gone)
            self.index.remove(gone)
        return n

    def parents_of(self, ids: list[str]) -> DataFrame:
        """Parents in the order of a request, nulls where there is none."""
        request = self.spark.createDataFrame([(i, p) for p, i in enumerate(ids)], "parent_id string, pos int")
        return request.join(self.table("parents"), "parent_id", "left").orderBy("pos")

    def parents_by_source(self, source: str) -> DataFrame:
        """A source's parents; files are ranged by source, so that most are skipped."""
        return self.table("parents").filter(F.col("source") == source)

    def sources(self) -> DataFrame:
        """source, n_parents, n_chars, sections: what the store holds of each source."""
        return self.table("parents").groupBy("source").agg(F.count("*").alias("n_parents"), F.sum("char_count").alias("n_chars"), F.array_sort(F.collect_set("section")).alias("sections"))

    def stats(self) -> DataFrame:
        """One row: sources, parents, children, characters."""
        p = self.table("parents").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_parents"), F.sum("char_count").alias("n_chars"))
        return p.join(self.table("children").agg(F.count("*").alias("n_children")))

    def search(self, queries: DataFrame, k: int = 6, mode: str = "hybrid", filters: dict | None = None) -> DataFrame:
        """query_id, parent_id, source, text, channels, similarity, score, rank for queries (query_id, query).

        dense: nearest children as they come. hybrid: their k best, nine times as many parents by words (all of them, else any) and three times as
        many by metadata are fused by parent; 3 k of these are reranked, boosted where the library has edges and metrics, and capped at two of a source.
        Filters hold for every channel.
        """
        wide = self.table("children")
        kids = wide.filter(rt.where(filters)) if filters else wide
        kids = kids.withColumn("chunk", F.concat_ws("#", "parent_id", F.col("idx").cast("string")))
        vectors = kids.select(F.xxhash64("chunk").alias("vec_id"), F.col("vector").alias("embedding"))
        asked = queries.select("query_id", self.embed(F.col("query")).alias("embedding"))
        near = rt.knn_batch(vectors, asked, k).join(kids.select(F.xxhash64("chunk").alias("vec_id"), "parent_id", "source", "text"), "vec_id")
        near = near.withColumn("similarity", rt.similarity(F.col("distance"))).select("query_id", "parent_id", "source", "text", "similarity", "rank")
        if mode == "dense":
            return near.select("query_id", "parent_id", "source", "text", F.lit("vec").alias("channels"), "similarity", F.col("similarity").alias("score"), "rank")
        parents = self.table("parents").select("parent_id", "source", F.col("content").alias("text"))
        if filters:
            parents = parents.join(kids.select("parent_id").distinct(), "parent_id", "left_semi")
        terms = queries.select("query_id", F.explode(F.array_distinct(F.filter(phrase_tokens(F.col("query")), lambda t: t != ""))).alias("term"))
        allowed = parents.select("parent_id") if filters else None
        words_ = self.index.search(queries.select("query_id", "query"), 9 * k, "parent_id", allowed).select("query_id", "parent_id", "rank").join(parents, "parent_id")
        fused = staged(rt.fuse_parents(near, words_, self._meta_hits(terms, parents, 3 * k), 3 * k), "fused")
        hits = rt.post_fusion(fused, queries, k, self.table("edges") if self.has("edges") else None, self.table("metrics") if self.has("metrics") else None)
        return hits.select("query_id", "parent_id", "source", "text", "channels", "similarity", "score", "rank")

    def _meta_hits(self, terms: DataFrame, parents: DataFrame, k: int) -> DataFrame:
        """One parent of each source whose metadata has all of a query's words; its text is led by the metadata."""
        if not self.has("meta"):
            return parents.limit(0).select(F.lit(0).cast(terms.schema["query_id"].dataType).alias("query_id"), "parent_id", "source", "text", F.lit(0).alias("rank"))
        meta = self.table("meta").select("source", metadata_text(F.col("title"), F.col("authors"), F.col("journal"), F.col("year").cast("string")).alias("meta"))
        first = parents.groupBy("source").agg(F.min_by(F.struct("parent_id", "text"), "parent_id").alias("p")).select("source", "p.*").join(meta, "source")
        found = rt.metadata_hits(first.select("parent_id", "source", "meta"), terms, k, "parent_id")
        return found.join(first.select("parent_id", F.concat_ws("\n", "meta", "text").alias("text")), "parent_id").select("query_id", "parent_id", "source", "text", "rank")

    def search_or_broaden(self, queries: DataFrame, k: int = 6, filters: dict | None = None, mode: str = "hybrid") -> DataFrame:
        """An agent's search, at most MOST_HITS hits of a query: where the first pass looks weak (see retrieve.weak_signals) a second one runs without
        filters and three times as wide, up to MOST_HITS, and is taken if it looks better or found more."""
        k = max(1, min(k, MOST_HITS))
        first = staged(self.search(queries, k, mode, filters), "first")
        weak = rt.weak_signals(first).filter(F.size("reasons") > 0).select("query_id")
        lost = queries.select("query_id").join(first.select("query_id").distinct(), "query_id", "left_anti")
        again = staged(queries.join(weak.union(lost).distinct(), "query_id", "left_semi"), "again")
        if again.isEmpty():
            return first
        second = staged(self.search(again, min(3 * k, MOST_HITS), mode), "second")
        n = lambda df, c: df.groupBy("query_id").agg(F.count("*").alias(c))
        still = rt.weak_signals(second).filter(F.size("reasons") > 0).select("query_id", F.lit(True).alias("weak"))
        took = n(second, "b").join(n(first, "a"), "query_id", "left").join(still, "query_id", "left").filter("weak is null or a is null or b > a").select("query_id")
        return first.join(took, "query_id", "left_anti").unionByName(second.join(took, "query_id", "left_semi"))

    def measure(self) -> None:
        """Compute the citation graph's metrics from the edges table."""
        edges = self.table("edges")
        ranks, parts = converge.pagerank_until(edges), graph.louvain(edges)
        hits = converge.hits_until(edges)
        degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").cast("double").alias("in_corpus"))
        rows = ranks.join(parts, "node", "left").join(hits, "node", "left").join(degree, "node", "left")
        self.write("metrics", rows.select(F.col("node").alias("source"), F.col("rank").alias("pagerank"), "authority", "hub", F.lit(None).cast("double").alias("rcr"), F.coalesce("in_corpus", F.lit(0.0)).alias("in_corpus"), F.lit(None).cast("double").alias("cites"), "community_id", "community_size"))
