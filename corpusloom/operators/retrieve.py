"""Retrieval for batches of queries: dense, lexical and metadata channels, fusion, boosts, caps. All plans are lazy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.metadata import PROSE
from corpusloom.functions.models import lexical_relevance
from corpusloom.functions.text import words
from corpusloom.sources.staging import dealt, staged

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF = 60
BROADCAST_ROWS = 200_000
#: The weights of the provenance boost, and when a result list is weak.
BOOST_PAGERANK, BOOST_AUTHORITY, BOOST_RCR, BOOST_IN_CORPUS, BOOST_CITES = 0.040, 0.030, 0.020, 0.010, 0.008
WEAK_SIMILARITY, WEAK_HITS, WEAK_CHARS, WEAK_NARRATIVE = 0.54, 2, 300, 0.30


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side whose row count was taken and is low."""
    return F.broadcast(df) if rows <= most else df


# ---- dense -------------------------------------------------------------------------------------------------------


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector: a scan and a top-k, nothing is shuffled but k rows a task."""
    d = squared_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, F.round(d, 9).alias("distance")).orderBy("distance", key).limit(k)


def _blocks(vectors: DataFrame, key: str, vector: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows packed into blocks of about ``size``, dealt by the key's hash."""
    n = max(1, -(-vectors.count() // size))
    part = F.pmod(F.xxhash64(key), F.lit(n)).alias(name)
    return vectors.groupBy(part).agg(F.collect_list(key).alias("ids"), F.collect_list(vector).alias("vs")), n


def nearest_rows(k: int, key: str):
    """Of rows of queries (q, qv) and a block of vectors (i, iv) the k nearest of each query: query_id, key, distance."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for q, qv, i, iv in zip(rows["q"], rows["qv"], rows["i"], rows["iv"]):
                a, b, i, q = np.stack(qv).astype(float), np.stack(iv).astype(float), np.asarray(i), np.asarray(q)
                squares, found = (b * b).sum(1), []
                for lo in range(0, len(a), 256):
                    some = a[lo : lo + 256]
                    # one product finds who may be near; what is as near as the k-th, give or take its rounding, is measured exactly
                    rough = squares - 2.0 * (some @ b.T)
                    slack = 1e-6 * (1.0 + squares.max() + (some * some).sum(1).max())
                    bound = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(some), np.inf)
                    for n, x, r, t in zip(q[lo : lo + 256], some, rough, bound):
                        near = np.flatnonzero(r <= t + slack)
                        d = np.round(((b[near] - x) ** 2).sum(1), 9)
                        top = np.lexsort((i[near], d))[:k]
                        found.append((np.full(len(top), n), i[near][top], d[top]))
                if found:
                    yield pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), key: np.concatenate([f[1] for f in found]), "distance": np.concatenate([f[2] for f in found])})

    return nearest


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, key, distance, rank: exact nearest neighbours of every query, in a grid of blocks multiplied in numpy."""
    left, nl = _blocks(queries, "query_id", vector, block, "l")
    right, nr = _blocks(vectors, key, vector, block, "r")
    grid = left.select("l", F.col("ids").alias("q"), F.col("vs").alias("qv"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nr - 1).cast("long"))).alias("r"))
    grid = grid.join(right.select("r", F.col("ids").alias("i"), F.col("vs").alias("iv")), "r")

    found = grid.select("q", "qv", "i", "iv").mapInPandas(nearest_rows(k, key), f"query_id long, {key} long, distance double")
    return top_k(found, k, ["query_id"], [F.col("distance"), F.col(key)])


def top_k(rows: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group with their rank; tasks keep k rows of a group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def union_queries(hits: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits of several sub-queries as one list: of each key the least distance, missing distances last."""
    return hits.groupBy(key).agg(F.min("distance").alias("distance")).orderBy(F.col("distance").asc_nulls_last(), key)


# ---- lexical -----------------------------------------------------------------------------------------------------


def terms_of(queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, term: the distinct words of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col(text)))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """query_id, key, score, rank. queries: query_id, term. every=True: only documents with all of a query's terms."""
    return top_k(bm25_scores(docs, queries, key, text, every), k, ["query_id"], [F.col("score").desc(), F.col(key)])


def bm25_terms(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, key, score, rank: documents with all of a query's terms, and for queries that have none those with any. The documents are read once."""
    return _all_else_any(bm25_scores(docs, queries, key, text, None), k, key)


def _all_else_any(scored: DataFrame, k: int, key: str) -> DataFrame:
    scored = staged(scored, "scored")
    some = scored.groupBy("query_id").agg(F.max("whole").alias("_some"))
    kept = scored.join(small(some, some.count()), "query_id").filter("whole or not _some").select("query_id", key, "score")
    return top_k(kept, k, ["query_id"], [F.col("score").desc(), F.col(key)])


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", every: bool | None = False) -> DataFrame:
    """query_id, key, score of all that match; with every=None also whole, whether all terms do. Query terms filter the documents' words before anything is
    grouped."""
    q = queries.distinct()
    from corpusloom.operators.phrases import postings

    tf, totals = postings(docs, q.select("term").distinct(), key, text, words, positions=False)
    tf = dealt(staged(tf, "postings"), key)  # a document's scores are added up where its words are
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return _scored(tf, df, totals, q, key, every)


def _scored(tf: DataFrame, df: DataFrame, totals: DataFrame, q: DataFrame, key: str, every: bool | None) -> DataFrame:
    """query_id, key, score of term frequencies (key, term, tf, dl), document frequencies (term, df) and one row of totals (n, avgdl)."""
    # few words, each in very many documents: where the queries are few they go to the documents
    rows = tf.join(small(q.join(df, "term"), q.count()), "term").join(F.broadcast(totals))  # totals is one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.coalesce(F.when(F.col("avgdl") > 0, F.col("avgdl")), F.lit(1.0))))
    scored = rows.groupBy("query_id", key).agg(F.round(F.sum(weight), 9).alias("score"), F.count("*").alias("matched"))
    if every is not False:
        scored = scored.join(q.groupBy("query_id").agg(F.count("*").alias("terms")), "query_id").withColumn("whole", F.col("matched") == F.col("terms")).drop("terms")
        scored = scored if every is None else scored.filter("whole").drop("whole")
    return scored.drop("matched")


def metadata_hits(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", source: str = "source", text: str = "meta") -> DataFrame:
    """query_id, source, key, rank: one representative of each source whose metadata matches all terms, best first."""
    scored = bm25_scores(docs, queries, key, text, every=True).join(docs.select(key, source), key)
    # the best of a source is aggregated before anything is ranked
    best = scored.groupBy("query_id", source).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))).alias("b"))
    return top_k(best.select("query_id", source, F.col("b.k").alias(key), F.col("b.s").alias("_s")), k, ["query_id"], [F.col("_s"), F.col(key)]).drop("_s")


# ---- fusion ------------------------------------------------------------------------------------------------------


def rrf(channels: list[tuple[str, DataFrame]], key: str = "doc_id", k: int | None = None) -> DataFrame:
    """query_id, key, rrf, channels, rank of ranked lists (query_id, key, rank). A key that a channel lists twice counts twice.

    Order: score, then the first channel that has the key, then its rank there.
    """
    rows = None
    for i, (name, df) in enumerate(channels):
        part = df.select("query_id", key, "rank", F.lit(name).alias("channel"), F.lit(i).alias("ord"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", key).agg(F.sum(1 / (RRF + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("channel")).alias("channels"), F.min(F.struct("ord", "rank")).alias("first"))
    out = top_k(fused.withColumn("rrf", F.round("rrf", 12)), k or 1 << 30, ["query_id"], [F.col("rrf").desc(), F.col("first"), F.col(key)])
    return out.select("query_id", key, F.round("rrf", 5).alias("rrf"), F.concat_ws(",", "channels").alias("channels"), "rank")


def fuse_parents(dense: DataFrame, lexical: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """query_id, parent_id, text, source, rrf, channels, similarity, rank: three channels fused by parent.

    Each channel has query_id, parent_id, source, text, rank; dense also similarity, the best of which stays. Several children of one parent in the dense channel add up. The
    text is the metadata hit's, which carries the entity, else that of the first channel's best entry.
    """
    names = ("vec", "bm25", "meta")
    rows = None
    for i, (name, df) in enumerate(zip(names, (dense, lexical, meta))):
        sim = F.col("similarity") if "similarity" in df.columns else F.lit(None).cast("double")
        part = df.select("query_id", "parent_id", "source", "text", "rank", sim.alias("similarity"), F.lit(name).alias("channel"), F.lit(i).alias("ord"), F.lit(0 if name == "meta" else 1).alias("plain"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "parent_id").agg(
        F.round(F.sum(1 / (RRF + F.col("rank"))), 12).alias("rrf"), F.concat_ws("+", F.array_sort(F.collect_set("channel"))).alias("channels"), F.max("similarity").alias("similarity"),
        F.min(F.struct("ord", "rank")).alias("first"), F.min_by(F.struct("source", "text"), F.struct("plain", "ord", "rank")).alias("e"),
    )
    best = top_k(fused, k, ["query_id"], [F.col("rrf").desc(), F.col("first"), F.col("parent_id")])
    return best.select("query_id", "parent_id", "e.source", "e.text", F.round("rrf", 5).alias("rrf"), "channels", "similarity", "rank")


def post_fusion(fused: DataFrame, queries: DataFrame, k: int, edges: DataFrame | None = None, metrics: DataFrame | None = None, score=lexical_relevance, most: int = 2) -> DataFrame:
    """The first k of fused hits after reranking, both boosts and the cap on a source. queries: query_id, query. Order is by score after each boost."""
    hits = rerank(fused.join(queries.select("query_id", "query"), "query_id"), score=score).withColumn("score", F.coalesce("rerank", F.lit(0.0)))
    again = lambda h: h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "rank")))
    if edges is not None:
        hits = again(boost_citations(hits, edges).drop("factor"))
    if metrics is not None:
        hits = again(boost_provenance(hits, metrics).drop("factor"))
    return cap_sources(hits, most=most, k=k)


def rerank(hits: DataFrame, query: str = "query", text: str = "text", score=lexical_relevance) -> DataFrame:
    """Hits in the order of a reranker's score; without a score they keep their order. Fewer than three hits pass unchanged."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    s = F.when(n >= 3, score(F.col(query), F.col(text)))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank").desc_nulls_last(), "rank")
    return hits.withColumn("rerank", s).withColumn("rank", F.row_number().over(w))


def cap_pool(hits: DataFrame, order: list[Column], k: int, source: str = "source", most: int = 2) -> DataFrame:
    """The hits (query_id, source, ...) that can be among the first k after cap_sources, with their rank among themselves.

    Those are the first ``most`` of each source, of which the first k count, and the first k of all: tasks keep that many before the shuffle, so that a
    query with very many hits isn't ranked in one task.
    """
    best = top_k(hits, most, ["query_id", source], order).drop("rank")
    kept = top_k(best, k, ["query_id"], order).drop("rank").unionByName(top_k(hits, k, ["query_id"], order).drop("rank")).distinct()
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def cap_sources(hits: DataFrame, source: str = "source", most: int = 2, k: int | None = None) -> DataFrame:
    """At most ``most`` hits of a source come first, the others follow in their order; the first k of that."""
    w = Window.partitionBy("query_id", source).orderBy("rank")
    held = hits.withColumn("_over", F.row_number().over(w) > most)
    order = Window.partitionBy("query_id").orderBy("_over", "rank")
    out = held.withColumn("rank", F.row_number().over(order)).drop("_over")
    return out.filter(F.col("rank") <= k) if k else out


# ---- boosts ------------------------------------------------------------------------------------------------------


def provenance_factor(pagerank: Column, authority: Column, rcr: Column, in_corpus: Column, cites: Column, most_pagerank: Column, most_authority: Column) -> Column:
    """Product of five small boosts, at most 1.08; 1.0 unless it is over 1.001."""
    share = lambda x, most: F.coalesce(F.when(most > 0, x / most), F.lit(0.0))
    capped = lambda x, most: F.least(F.coalesce(x, F.lit(0.0)) / most, F.lit(1.0))
    f = (1 + BOOST_PAGERANK * share(pagerank, most_pagerank)) * (1 + BOOST_AUTHORITY * share(authority, most_authority)) * (1 + BOOST_RCR * capped(rcr, 5)) * (1 + BOOST_IN_CORPUS * capped(in_corpus, 20)) * (1 + BOOST_CITES * capped(cites, 2000))
    return F.when(f > 1.001, F.least(f, F.lit(1.08))).otherwise(1.0)


def boost_provenance(hits: DataFrame, metrics: DataFrame, source: str = "source") -> DataFrame:
    """Positive scores times the factor of their source's metrics; other scores stay. metrics: one row a source."""
    most = metrics.agg(F.max("pagerank").alias("p"), F.max("authority").alias("a")).first()
    f = provenance_factor(F.col("pagerank"), F.col("authority"), F.col("rcr"), F.col("in_corpus"), F.col("cites"), F.lit(float(most["p"] or 0)), F.lit(float(most["a"] or 0)))
    found = hits.join(metrics, source, "left").withColumn("factor", F.when(F.col("score") > 0, f).otherwise(1.0))
    return found.withColumn("score", F.col("score") * F.col("factor")).select(*hits.columns, "factor")


def boost_citations(hits: DataFrame, edges: DataFrame, source: str = "source", anchors: int = 2, cited_by: float = 1.05, cites: float = 1.03) -> DataFrame:
    """Scores of sources beside the first ``anchors`` sources of a query: those citing an anchor times cited_by, those it cites times cites.

    Anchors keep their score. edges: src cites dst.
    """
    firsts = hits.groupBy("query_id", source).agg(F.min("rank").alias("at"))
    anchor = top_k(firsts, anchors, ["query_id"], [F.col("at")]).select("query_id", F.col(source).alias("anchor"))
    near = anchor.join(edges, F.col("anchor") == F.col("dst")).select("query_id", F.col("src").alias(source), F.lit(cited_by).alias("f"))
    near = near.unionByName(anchor.join(edges, F.col("anchor") == F.col("src")).select("query_id", F.col("dst").alias(source), F.lit(cites).alias("f")))
    near = near.groupBy("query_id", source).agg(F.max("f").alias("f")).join(anchor.withColumnRenamed("anchor", source), ["query_id", source], "left_anti")
    return hits.join(near, ["query_id", source], "left").withColumn("factor", F.coalesce("f", F.lit(1.0))).withColumn("score", F.col("score") * F.col("factor")).drop("f")


# ---- broadening --------------------------------------------------------------------------------------------------


#: Fixed value: a sentence of prose.
SENTENCE = PROSE


def narrative_chars(text: Column) -> Column:
    """Characters in sentences of 40 or more characters before their end."""
    return F.aggregate(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0)), F.lit(0), lambda n, s: n + F.length(s))


def weak_signals(hits: DataFrame, text: str = "text", sim: str = "similarity") -> DataFrame:
    """query_id, n, chars, best, narrative, reasons: why a result list should be broadened."""
    m = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"), F.max(sim).alias("best"), (F.sum(narrative_chars(F.col(text))) / F.sum(F.length(text))).alias("narrative"))
    m = m.fillna(0, ["chars"]).fillna(0.0, ["narrative"])
    reasons = F.array(F.when(F.col("n") < WEAK_HITS, "few"), F.when(F.col("chars") < WEAK_CHARS, "short"), F.when(F.col("best") < WEAK_SIMILARITY, "far"), F.when(F.col("narrative") < WEAK_NARRATIVE, "fragments"))
    return m.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def or_split(query: Column) -> Column:
    """The three longest words, for a second attempt."""
    toks = F.array_distinct(words(query))
    ranked = F.array_sort(F.transform(toks, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, 3), lambda s: s["w"])


def within_budget(hits: DataFrame, text: str = "text", each: int = 800, total: int = 2200) -> DataFrame:
    """Hits whose cut texts start within the character budget of a query."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return hits.withColumn(text, F.substring(text, 1, each)).withColumn("_before", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).filter(F.col("_before") < total).drop("_before")


def where(filters: dict) -> Column:
    """A metadata filter as a condition: equality, $and, $or, $in, $ne and ranges; {'topic': ...} keys test an array column."""
    out = F.lit(True)
    for name, want in filters.items():
        if name in ("$and", "$or"):
            parts = [where(x) for x in want]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if name == "$and" else joined | p
            out = out & joined
        elif name.startswith("topic_"):
            out = out & F.array_contains("topics", name.removeprefix("topic_"))
        elif isinstance(want, dict):
            for op, v in want.items():
                c = F.col(name)
                out = out & {"$in": lambda: c.isin(*v), "$ne": lambda: c != v, "$gt": lambda: c > v, "$gte": lambda: c >= v, "$lt": lambda: c < v, "$lte": lambda: c <= v, "$eq": lambda: c == v}[op]()
        else:
            out = out & (F.col(name) == want)
    return out
