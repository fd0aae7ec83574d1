"""Queries over retrieval: channels, fusion, boosts, caps, broadening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import WORD, words
from corpusloom.operators import retrieve as rt
from corpusloom.operators.metric import MetricIndex
from corpusloom.operators.phrases import bm25_phrases
from corpusloom.sources.staging import dealt, staged
from corpusloom.sources.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


K = 10


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


_D2 = "round(list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)))), 9)"


def _first_vector(spark, sf_dir) -> list[float]:
    return list(_vectors(spark, sf_dir).filter("vec_id = 0").first()["embedding"])


@query(f"SELECT e.vec_id, {_D2} AS distance, round(1 / (1 + {_D2}), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT {K}")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to vector 0."""
    return rt.knn(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), K).withColumn("similarity", F.round(rt.similarity(F.col("distance")), 6))


_BATCH = f"""nn AS (SELECT query_id, vec_id, distance, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, {_D2} AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= {K})"""


def _batch(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return rt.knn_batch(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), K)


@query(f"WITH {_BATCH} SELECT query_id, vec_id, distance, CAST(rank AS BIGINT) AS rank FROM nn")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 20."""
    return _batch(spark, sf_dir).select("query_id", "vec_id", "distance", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BATCH} SELECT query_id, vec_id, distance, CAST(rank AS BIGINT) AS rank FROM nn")
def knn_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours by the metric index, which looks only at shells that can hold them."""
    v = _vectors(spark, sf_dir)
    found = MetricIndex(v).search(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), K)
    return found.select("query_id", "vec_id", "distance", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BATCH} SELECT vec_id, min(distance) AS distance FROM nn GROUP BY vec_id")
def multi_query_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's hits as one list with the least distance of each vector."""
    return rt.union_queries(_batch(spark, sf_dir))


@query(f"""WITH {_BATCH} SELECT query_id, count(*) FILTER (WHERE g) > 0 AS hit, CAST(min(rank) FILTER (WHERE g) AS BIGINT) AS first_rank, coalesce(round(1.0 / min(rank) FILTER (WHERE g), 6), 0.0) AS reciprocal
FROM (SELECT nn.query_id, nn.rank - 1 AS rank, e.label = q.label AS g FROM nn JOIN embeddings e ON nn.vec_id = e.vec_id JOIN embeddings q ON nn.query_id = q.vec_id WHERE nn.vec_id <> nn.query_id) GROUP BY query_id""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval scores of every query: gold are the vectors of its label, itself left out."""
    from corpusloom.operators.evaluate import first_gold

    v = _vectors(spark, sf_dir)
    hits = _batch(spark, sf_dir).filter("vec_id <> query_id").withColumn("rank", F.col("rank") - 1)
    named = hits.join(v.select("vec_id", F.col("label").alias("found")), "vec_id").join(v.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return first_gold(named, F.col("found") == F.col("label"))


_Q = f"q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS term FROM benchmark)"


def bm25_sql(q: str, docs: str, key: str, every: bool, k: int, rest: str) -> str:
    """The BM25 of rt.bm25 over ``docs`` (key, t: its words) for the query CTE ``q``."""
    return f"""WITH {q}, d AS ({docs}),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT {key}, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY {key}, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, {key}, round(sum(greatest(ln((n.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score, count(*) AS matched FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY query_id, {key}),
{"t AS (SELECT query_id, count(*) AS terms FROM q GROUP BY query_id), f AS (SELECT s.* FROM s JOIN t USING (query_id) WHERE matched = terms)" if every else "f AS (SELECT * FROM s)"},
r AS (SELECT * FROM (SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM f) WHERE rank <= {k}) {rest}"""


_DOCS = f"SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS t FROM documents"
_BENCH = "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r"


def _bench_terms(spark, sf_dir) -> DataFrame:
    return rt.terms_of(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def _out(df: DataFrame, *keys: str) -> DataFrame:
    return df.select("query_id", *keys, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(bm25_sql(_Q, _DOCS, "doc_id", True, 20, _BENCH))
def bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all words of a benchmark item, by BM25."""
    return _out(rt.bm25(_docs(spark, sf_dir), _bench_terms(spark, sf_dir), 20, every=True), "doc_id")


@query(bm25_sql(_Q, _DOCS, "doc_id", False, 20, _BENCH))
def bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for the words of each benchmark item."""
    return _out(rt.bm25(_docs(spark, sf_dir), _bench_terms(spark, sf_dir), 20), "doc_id")


@query(f"""WITH i AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark),
q AS (SELECT DISTINCT query_id, a, b FROM (SELECT query_id, w[1] AS a, w[2] AS b FROM i UNION ALL SELECT query_id, w[3], w[4] FROM i)),
d AS ({_DOCS}), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM d),
m AS (SELECT x.doc_id, x.term AS a, y.term AS b, any_value(x.dl) AS dl, count(*) AS tf FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 JOIN (SELECT DISTINCT a, b FROM q) u ON u.a = x.term AND u.b = y.term GROUP BY x.doc_id, x.term, y.term),
df AS (SELECT a, b, count(*) AS df FROM m GROUP BY a, b),
s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score, count(*) AS matched FROM m JOIN df USING (a, b) JOIN q USING (a, b), n GROUP BY query_id, doc_id),
w AS (SELECT s.*, matched = units AS whole FROM s JOIN (SELECT query_id, count(*) AS units FROM q GROUP BY query_id) USING (query_id)),
f AS (SELECT * FROM w WHERE whole OR query_id NOT IN (SELECT query_id FROM w WHERE whole)),
r AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 20) {_BENCH}""")
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both pairs of neighbouring words that a benchmark item begins with, else with either, by BM25 of the pairs."""
    w = words(F.col("text"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.array_join(F.slice(w, 1, 2), "-"), F.array_join(F.slice(w, 3, 2), "-")).alias("query"))
    return _out(bm25_phrases(_docs(spark, sf_dir), asked, 20), "doc_id")


_META = "SELECT doc_id, source, regexp_extract_all(lower(coalesce(source, '') || ' ' || coalesce(lang, '')), '[\\p{L}\\p{N}]+') AS t FROM documents"
_LANGS = [(1, "en"), (2, "fr"), (3, "de"), (4, "es")]


@query(bm25_sql("q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in _LANGS) + ") AS v(query_id, term))", _META, "doc_id", True, 1 << 30, """,
m AS (SELECT query_id, source, min(rank) AS "at", arg_min(doc_id, rank) AS doc_id FROM r JOIN documents USING (doc_id) GROUP BY query_id, source)
SELECT * FROM (SELECT CAST(query_id AS BIGINT) AS query_id, source, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m."at", source) AS BIGINT) AS rank FROM m) WHERE rank <= 10"""))  # fmt: skip
def meta_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each source whose metadata names a language."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", F.concat_ws(" ", "source", "lang").alias("meta"))
    q = spark.createDataFrame(_LANGS, "query_id long, term string")
    return rt.metadata_hits(docs, q, 10).select("query_id", "source", "doc_id", F.col("rank").cast("long").alias("rank"))


_TERMS = ("the", "tion", "ent")
_FIXED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"(0, '{t}')" for t in _TERMS) + ") AS v(query_id, term))"
_VEC = f"vec AS (SELECT vec_id AS doc_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT e.vec_id, {_D2} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 30)"
_FUSE = f""", {_VEC},
u AS (SELECT doc_id, rank, 'vec' AS channel, 0 AS ord FROM vec UNION ALL SELECT doc_id, rank, 'bm25', 1 FROM r),
fu AS (SELECT doc_id, round(sum(1 / (60.0 + rank)), 12) AS rrf, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels, min(ord * 1000000 + rank) AS first FROM u GROUP BY doc_id),
g AS (SELECT doc_id, rrf, channels, row_number() OVER (ORDER BY rrf DESC, first, doc_id) AS rank FROM fu)"""


def _channels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """doc_id and vec_id are paired by number here; that is a convention of the fixtures, not a link in the data."""
    terms = spark.createDataFrame([(0, t) for t in _TERMS], "query_id long, term string")
    words = rt.bm25(_docs(spark, sf_dir), terms, 30)
    near = rt.knn(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 30).select(F.lit(0).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "distance")
    return rt.top_k(near, 30, ["query_id"], [F.col("distance"), F.col("doc_id")]), words


@query(bm25_sql(_FIXED, _DOCS, "doc_id", False, 30, _FUSE + " SELECT CAST(0 AS BIGINT) AS query_id, doc_id, round(rrf, 5) AS rrf, channels, CAST(rank AS BIGINT) AS rank FROM g"))
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of the dense and the lexical channel."""
    near, words = _channels(spark, sf_dir)
    out = rt.rrf([("vec", near), ("bm25", words)])
    return out.withColumn("rank", F.col("rank").cast("long"))


#: The flagship: benchmark items ask with some words of their text and a source's name. A document is a parent and, by number, a vector's; sources cite the seventh after them.
_ASKED = "asked AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:4], ' ') || ' src' || (item_id % 20) AS query FROM benchmark)"
_SOURCES_CITE = "ed AS (SELECT 'src' || i AS src, 'src' || ((i + 7) % 20) AS dst FROM range(20) t(i))"
_SOURCE_METRICS = "me AS (SELECT source, count(*)::DOUBLE AS pagerank, count(DISTINCT lang)::DOUBLE AS authority, avg(n_chars) / 1000 AS rcr, (count(*) % 30)::DOUBLE AS in_corpus, sum(n_chars)::DOUBLE AS cites FROM documents GROUP BY source)"
_FACTOR = "(1 + 0.040 * pagerank / mp) * (1 + 0.030 * authority / ma) * (1 + 0.020 * least(rcr / 5, 1)) * (1 + 0.010 * least(in_corpus / 20, 1)) * (1 + 0.008 * least(cites / 2000, 1))"


def _words_cte(pre: str, docs: str, k: int, every: bool) -> str:
    """CTEs {pre}r (query_id, doc_id, score, rank): BM25 of the asked words over docs (doc_id, t)."""
    match = f"WHERE matched = (SELECT count(*) FROM qt WHERE qt.query_id = {pre}s.query_id)" if every else ""
    return f"""{pre}d AS MATERIALIZED ({docs}), {pre}n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {pre}d),
{pre}tf AS MATERIALIZED (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM {pre}d) WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, term),
{pre}df AS (SELECT term, count(*) AS df FROM {pre}tf GROUP BY term),
{pre}s AS MATERIALIZED (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score, count(*) AS matched FROM {pre}tf JOIN {pre}df USING (term) JOIN qt USING (term), {pre}n GROUP BY query_id, doc_id),
{pre}r AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {pre}s {match}) WHERE rank <= {k})"""


_FULL = "SELECT doc_id, regexp_extract_all(lower(coalesce(text, '') || ' ' || source || ' ' || lang), '[\\p{L}\\p{N}]+') AS t FROM documents"
_FIRST_OF_SOURCE = "SELECT min(doc_id) AS doc_id, regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+') AS t FROM documents GROUP BY source"


@query(f"""WITH {_ASKED}, qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM asked), {_SOURCES_CITE}, {_SOURCE_METRICS},
ve AS MATERIALIZED (SELECT query_id, doc_id, distance, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {_D2} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM asked)) q WHERE e.vec_id IN (SELECT doc_id FROM documents)) WHERE rank <= 10),
{_words_cte("w", _FULL, 90, True)}, o AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ws WHERE query_id NOT IN (SELECT query_id FROM wr)) WHERE rank <= 90),
{_words_cte("m", _FIRST_OF_SOURCE, 30, True)},
u AS (SELECT query_id, doc_id, rank, 'vec' AS channel, 0 AS ord, 1 / (1 + distance) AS similarity FROM ve UNION ALL SELECT query_id, doc_id, rank, 'bm25', 1, NULL FROM wr UNION ALL SELECT query_id, doc_id, rank, 'bm25', 1, NULL FROM o UNION ALL SELECT query_id, doc_id, rank, 'meta', 2, NULL FROM mr),
f AS (SELECT query_id, doc_id, round(sum(1 / (60.0 + rank)), 12) AS rrf, array_to_string(list_sort(list_distinct(list(channel))), '+') AS channels, max(similarity) AS similarity, min(ord * 1000000 + rank) AS first FROM u GROUP BY query_id, doc_id),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, doc_id) AS rank FROM f) WHERE rank <= 30),
h AS (SELECT g.*, source, CASE WHEN contains(channels, 'meta') THEN source || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS text, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS q, count(*) OVER (PARTITION BY g.query_id) AS n FROM g JOIN documents USING (doc_id) JOIN asked USING (query_id)),
i AS (SELECT *, CASE WHEN n >= 3 THEN len(list_intersect(q, regexp_extract_all(lower(text[:1000]), '[\\p{{L}}\\p{{N}}]+'))) / len(q) ELSE 0.0 END AS s0 FROM h),
j AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s0 DESC, rank) AS r0 FROM i),
an AS (SELECT query_id, source FROM (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(r0)) AS k FROM j GROUP BY query_id, source) WHERE k <= 2),
nb AS (SELECT query_id, s, max(x) AS x FROM (SELECT query_id, src AS s, 1.05 AS x FROM an JOIN ed ON dst = source UNION ALL SELECT query_id, dst, 1.03 FROM an JOIN ed ON src = source) y WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.query_id = y.query_id AND an.source = y.s) GROUP BY query_id, s),
k AS (SELECT j.*, s0 * coalesce(x, 1.0) AS s1 FROM j LEFT JOIN nb ON nb.query_id = j.query_id AND nb.s = j.source), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s1, 9) DESC, r0) AS r1 FROM k),
p AS (SELECT l.*, s1 * CASE WHEN s1 > 0 AND {_FACTOR} > 1.001 THEN least({_FACTOR}, 1.08) ELSE 1.0 END AS s2 FROM l JOIN me USING (source), (SELECT max(pagerank) AS mp, max(authority) AS ma FROM me)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s2, 9) DESC, r1) AS r2 FROM p), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY r2) > 2 AS over FROM t),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, r2) AS r3 FROM c)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, source, channels, round(similarity, 6) AS similarity, round(s2, 6) AS score, CAST(r3 AS BIGINT) AS rank FROM z WHERE r3 <= 10""")
def search_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search for a batch of queries: nearest vectors, words (all of a query's, else any) over text and metadata, metadata by source; fusion by parent,
    reranking, citation and provenance boosts, at most two hits of a source first, ten rows a query."""
    docs = _docs(spark, sf_dir)
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.array_join(F.slice(words(F.col("text")), 1, 4), " "), F.lit(" src"), (F.col("item_id") % 20).cast("string")).alias("query"))
    parents = docs.select(F.col("doc_id").alias("parent_id"), "source", "text")
    v = _vectors(spark, sf_dir).join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    mine = _vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding").join(asked.select("query_id"), "query_id", "left_semi")
    near = rt.knn_batch(v, mine, K).select("query_id", F.col("vec_id").alias("parent_id"), rt.similarity(F.col("distance")).alias("similarity"), "rank").join(parents, "parent_id")
    terms = rt.terms_of(asked, "query")
    full = docs.select(F.col("doc_id").alias("parent_id"), F.concat_ws(" ", "text", "source", "lang").alias("text"))
    found = rt.bm25_terms(full, terms, 9 * K, "parent_id").select("query_id", "parent_id", "rank").join(parents, "parent_id")
    first = docs.groupBy("source").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("source", F.col("d.doc_id").alias("parent_id"), F.col("d.text").alias("text"))
    meta = rt.metadata_hits(first.select("parent_id", "source", F.col("source").alias("meta")), terms, 3 * K, "parent_id")
    meta = meta.join(first.select("parent_id", F.concat_ws("\n", "source", "text").alias("text")), "parent_id")
    fused = staged(rt.fuse_parents(near, found, meta, 3 * K), "fused")
    edges = spark.range(20).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("src"), ((F.col("id") + 7) % 20).cast("string")).alias("dst"))
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("double").alias("pagerank"), F.count_distinct("lang").cast("double").alias("authority"), (F.avg("n_chars") / 1000).alias("rcr"), (F.count("*") % 30).cast("double").alias("in_corpus"), F.sum("n_chars").cast("double").alias("cites"))
    out = rt.post_fusion(fused, asked, K, edges, d)
    return out.select("query_id", F.col("parent_id").alias("doc_id"), "source", "channels", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT doc_id, source, lang, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(coalesce(text, '')) DESC, doc_id) AS rank FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY rank) > 2 AS over FROM a)
SELECT * FROM (SELECT lang AS query_id, doc_id, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY over, rank) AS BIGINT) AS rank FROM b) WHERE rank <= 20""")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents of each language, at most two of a source first."""
    hits = _docs(spark, sf_dir).select("doc_id", "source", F.col("lang").alias("query_id"), F.length("text").alias("n"))
    # two of each source and the twenty best hold all that can come first: a top-k of each source and of each language, kept small before the shuffle
    pool = rt.cap_pool(hits, [F.col("n").desc(), F.col("doc_id")], 20)
    return rt.cap_sources(pool, k=20).select("query_id", "doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query("""WITH m AS (SELECT l_suppkey, count(*) AS pagerank, count(DISTINCT o_custkey) AS authority, avg(l_quantity) / 10 AS rcr, count(DISTINCT l_partkey) AS in_corpus, count(DISTINCT l_orderkey) AS cites FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey),
x AS (SELECT max(pagerank) AS p, max(authority) AS a FROM m),
f AS (SELECT s_suppkey, s_acctbal / 1000 AS score, (1 + 0.040 * coalesce(pagerank / p, 0)) * (1 + 0.030 * coalesce(authority / a, 0)) * (1 + 0.020 * least(coalesce(rcr, 0) / 5, 1)) * (1 + 0.010 * least(coalesce(in_corpus, 0) / 20, 1)) * (1 + 0.008 * least(coalesce(cites, 0) / 2000, 1)) AS f
  FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey, x)
SELECT s_suppkey, round(CASE WHEN score > 0 AND f > 1.001 THEN least(f, 1.08) ELSE 1.0 END, 6) AS factor, round(score * CASE WHEN score > 0 AND f > 1.001 THEN least(f, 1.08) ELSE 1.0 END, 6) AS score FROM f""")
def provenance_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances as scores, boosted by what the order graph says of them."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").cast("double").alias("pagerank"), F.count_distinct("o_custkey").cast("double").alias("authority"), (F.avg("l_quantity") / 10).alias("rcr"),
        F.count_distinct("l_partkey").cast("double").alias("in_corpus"), F.count_distinct("l_orderkey").cast("double").alias("cites"),
    )
    hits = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("score"))
    return rt.boost_provenance(hits, m, "s_suppkey").select("s_suppkey", F.round("factor", 6).alias("factor"), F.round("score", 6).alias("score"))


EDGES_SQL = "SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst"


def supplier_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src cites dst: the suppliers of neighbouring lines of an order."""
    from pyspark.sql.window import Window

    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    # dealt by rows, as lines sorted by order take far more memory than they take when compressed
    rows = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "l_orderkey").select(F.col("l_suppkey").alias("src"), nxt.alias("dst"))
    return rows.filter("dst is not null and src <> dst").distinct()


@query(f"""WITH e AS ({EDGES_SQL}), h AS (SELECT s_nationkey AS query_id, s_suppkey, s_acctbal AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier),
a AS (SELECT query_id, s_suppkey AS anchor FROM h WHERE rank <= 2),
n AS (SELECT query_id, src AS s, 1.05 AS f FROM a JOIN e ON anchor = dst UNION ALL SELECT query_id, dst, 1.03 FROM a JOIN e ON anchor = src),
b AS (SELECT query_id, s, max(f) AS f FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = n.query_id AND a.anchor = n.s) GROUP BY query_id, s)
SELECT CAST(h.query_id AS BIGINT) AS query_id, s_suppkey, CAST(coalesce(f, 1.0) AS DOUBLE) AS factor, round(CAST(score * coalesce(f, 1.0) AS DOUBLE), 6) AS score FROM h LEFT JOIN b ON h.query_id = b.query_id AND h.s_suppkey = b.s""")
def cite_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation by balance; those beside the first two in the citation graph are boosted."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    hits = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("query_id"), "s_suppkey", F.col("s_acctbal").alias("score"), F.row_number().over(w).alias("rank"))
    out = rt.boost_citations(hits, supplier_citations(spark, sf_dir), "s_suppkey")
    return out.select("query_id", "s_suppkey", "factor", F.round("score", 6).alias("score"))


@query(bm25_sql(_Q, _DOCS, "doc_id", False, 3, """,
w AS (SELECT query_id, text, round(1 / (1 + exp(-score / 50)), 6) AS similarity FROM r JOIN documents USING (doc_id)),
m AS (SELECT query_id, count(*) AS n, sum(length(text)) AS chars, max(similarity) AS best, coalesce(sum(coalesce(list_sum(list_transform(regexp_extract_all(text, '[^.!?\\n]{40,}[.!?]'), lambda s: length(s))), 0)) / nullif(sum(length(text)), 0), 0) AS narrative FROM w GROUP BY query_id)
SELECT query_id, n, CAST(chars AS BIGINT) AS chars, best, round(narrative, 6) AS narrative, concat_ws(',', CASE WHEN n < 2 THEN 'few' END, CASE WHEN chars < 300 THEN 'short' END, CASE WHEN best < 0.54 THEN 'far' END, CASE WHEN narrative < 0.3 THEN 'fragments' END) AS reasons FROM m"""))  # fmt: skip
def weak_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the three best documents of each benchmark item would be broadened."""
    docs = _docs(spark, sf_dir)
    hits = rt.bm25(docs, _bench_terms(spark, sf_dir), 3).join(docs.select("doc_id", "text"), "doc_id").withColumn("similarity", F.round(1 / (1 + F.exp(-F.col("score") / 50)), 6))
    return rt.weak_signals(hits).select("query_id", "n", "chars", "best", F.round("narrative", 6).alias("narrative"), F.concat_ws(",", "reasons").alias("reasons"))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND (quality = 1 AND toxic <> 1) AND source IN ('src1', 'src2', 'src3') AND n_chars >= 200")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a nested metadata filter; simple conditions reach the scans."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.filter(rt.where({"$and": [{"lang": "en"}, {"quality": 1, "toxic": {"$ne": 1}}], "source": {"$in": ["src1", "src2", "src3"]}, "n_chars": {"$gte": 200}})).select("doc_id")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, source AS query_id, coalesce(text, '')[:800] AS t FROM documents),
b AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT query_id, doc_id, CAST(length(t) AS BIGINT) AS n FROM b WHERE before < 2200""")
def budgeted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as hits, cut and kept while they start within the budget."""
    from pyspark.sql.window import Window

    hits = _docs(spark, sf_dir).select(F.col("source").alias("query_id"), "doc_id", "text", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"))
    return rt.within_budget(hits).select("query_id", "doc_id", F.length("text").cast("long").alias("n"))


@query("""WITH a AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), b AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM a),
c AS (SELECT item_id, w, min(i) AS i FROM b GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS k FROM c)
SELECT item_id, string_agg(w, ' ' ORDER BY k) AS words FROM d WHERE k <= 3 GROUP BY item_id""")
def broader_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest words of every benchmark item, for a second attempt."""
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(rt.or_split(F.col("text")), " ").alias("words"))
