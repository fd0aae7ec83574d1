"""Queries over the citation graph: suppliers of neighbouring order lines cite each other, customers cite parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators import converge as cv
from corpusloom.operators import directions as dr
from corpusloom.operators import graph as gr
from corpusloom.operators.retrieve import top_k
from corpusloom.plans.retrieval_queries import _BATCH, EDGES_SQL, _batch, supplier_citations
from corpusloom.sources.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _bought(spark, sf_dir) -> DataFrame:
    """Order lines with their customer."""
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


def _seeds(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seed"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT src, count(*) AS n FROM e GROUP BY src),
s AS (SELECT a.src AS seed, b.src AS other, count(*) AS shared FROM e a JOIN e b ON a.dst = b.dst WHERE a.src % 20 = 0 AND a.src <> b.src GROUP BY a.src, b.src),
j AS (SELECT seed, other, shared, round(shared / (x.n + y.n - shared), 9) AS jaccard FROM s JOIN n x ON x.src = seed JOIN n y ON y.src = other)
SELECT seed, other, shared, round(jaccard, 6) AS jaccard, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY jaccard DESC, other) AS rank FROM j) WHERE rank <= 10""")
def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers whose parts overlap most with those of every customer whose id is divisible by 20."""
    edges = _bought(spark, sf_dir).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    out = gr.coupling(edges, edges.filter("src % 20 = 0").select("src").distinct())
    return out.select("seed", "other", "shared", F.round("jaccard", 6).alias("jaccard"), F.col("rank").cast("long").alias("rank"))


@query("""WITH t AS (SELECT p_partkey, p_name, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS k FROM part), s AS (SELECT p_partkey AS seed, k FROM t WHERE p_partkey % 20 = 0),
h AS (SELECT DISTINCT l_suppkey AS paper, p_name AS hint, k FROM lineitem JOIN t ON l_partkey = p_partkey),
v AS (SELECT DISTINCT l_partkey AS seed, l_suppkey AS paper FROM lineitem WHERE l_quantity >= 48 AND l_partkey % 20 = 0),
g AS (SELECT DISTINCT seed, paper FROM s JOIN h ON len(list_intersect(s.k, h.k)) >= greatest(2, len(s.k) / 3))
SELECT seed, paper, CASE WHEN min(p) = 1 THEN 'verified' ELSE 'hint' END AS how FROM (SELECT seed, paper, 1 AS p FROM v UNION ALL SELECT seed, paper, 2 FROM g) GROUP BY seed, paper""")
def snowball_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that cite a part by a large order line, or a part of its name."""
    part, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    seeds = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("seed"), F.col("p_name").alias("title"))
    verified = line.filter("l_quantity >= 48").select(F.col("l_suppkey").alias("paper"), F.col("l_partkey").alias("seed")).distinct()
    hints = line.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select(F.col("l_suppkey").alias("paper"), F.col("p_name").alias("hint")).distinct()
    return gr.forward(seeds, verified, hints)


@query("""WITH c AS (SELECT DISTINCT o_custkey AS src, CASE WHEN l_quantity >= 40 THEN 'p' || p_partkey ELSE 'b' || p_brand || '/' || p_size END AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), n AS (SELECT src, count(*) AS n FROM c GROUP BY src),
s AS (SELECT a.src AS seed, b.src AS other, count(*) AS shared FROM c a JOIN c b ON a.dst = b.dst WHERE a.src % 20 = 0 AND a.src <> b.src GROUP BY a.src, b.src),
j AS (SELECT seed, other, shared, round(shared / (x.n + y.n - shared), 9) AS jaccard FROM s JOIN n x ON x.src = seed JOIN n y ON y.src = other)
SELECT seed, other, shared, round(jaccard, 6) AS jaccard, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY jaccard DESC, other) AS rank FROM j) WHERE rank <= 8""")
def coupling_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling of customers where large lines name a part and others only its brand and size, as author and year."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    line, sure = _bought(spark, sf_dir).join(part, "l_partkey"), F.col("l_quantity") >= 40
    named = line.select(F.col("o_custkey").alias("from"), F.when(sure, F.col("l_partkey")).alias("to"), F.col("p_brand").alias("to_author"), F.col("p_size").cast("string").alias("to_year"), sure.alias("resolved"))
    keys = gr.cited_keys(named)
    out = gr.coupling(keys, keys.filter("src % 20 = 0").select("src").distinct(), k=8)
    return out.select("seed", "other", "shared", F.round("jaccard", 6).alias("jaccard"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT p_partkey AS seed, lower(p_type) AS a, lower(split_part(p_name, ' ', 1)) AS b, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(1990 + p_size AS VARCHAR) END AS y FROM part WHERE p_partkey % 20 = 0),
m AS (SELECT DISTINCT l_suppkey AS paper, lower(CASE WHEN l_linenumber % 2 = 0 THEN p_type || 'son' ELSE split_part(p_name, ' ', 1) END) AS author, CAST(1990 + p_size AS VARCHAR) AS year FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 4),
v AS (SELECT DISTINCT l_partkey AS seed, l_suppkey AS paper FROM lineitem WHERE l_quantity >= 48 AND l_partkey % 20 = 0),
g AS (SELECT seed, paper FROM s JOIN m ON (a <> '' AND starts_with(author, a[1:4]) OR b <> '' AND starts_with(author, b[1:4])) AND (y = year OR y = ''))
SELECT seed, paper, CASE WHEN min(p) = 1 THEN 'verified' ELSE 'author_year' END AS how FROM (SELECT seed, paper, 1 AS p FROM v UNION ALL SELECT seed, paper, 3 FROM g) WHERE seed <> paper GROUP BY seed, paper""")
def snowball_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that cite a part by a large line, or name its type or the first word of its name as author and its size as year; every third part has no year."""
    part, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    first = F.substring_index("p_name", " ", 1)
    year = (F.lit(1990) + F.col("p_size")).cast("string")
    seeds = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("seed"), F.lit("").alias("title"), F.array("p_type", first).alias("surnames"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(year).alias("year"))
    verified = line.filter("l_quantity >= 48").select(F.col("l_suppkey").alias("paper"), F.col("l_partkey").alias("seed")).distinct()
    named = line.filter("l_linenumber <= 4").join(part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    mentions = named.select(F.col("l_suppkey").alias("paper"), F.when(F.col("l_linenumber") % 2 == 0, F.concat("p_type", F.lit("son"))).otherwise(first).alias("author"), year.alias("year"))
    return gr.forward(seeds, verified, mentions.select("paper", F.lit("").alias("hint")).limit(0), mentions, one_table=True)


@query("""WITH m AS (SELECT s_suppkey AS v, CASE WHEN s_suppkey % 11 > 0 THEN s_nationkey END AS c FROM supplier), s AS (SELECT s_suppkey AS v FROM supplier WHERE s_acctbal > 8000),
w AS (SELECT c, 0.5 + 0.5 * count(*) / sum(count(*)) OVER () AS near FROM s JOIN m ON s.v = m.v WHERE c IS NOT NULL GROUP BY c)
SELECT o_orderkey AS direction_id, round(max(CASE WHEN s.v IS NOT NULL THEN 1.0 ELSE coalesce(near, 0.0) END), 6) AS anchor FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN m ON m.v = l_suppkey LEFT JOIN s ON s.v = l_suppkey LEFT JOIN w ON w.c = m.c GROUP BY o_orderkey""")
def anchored_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the suppliers of every order are to the richest suppliers: one of them, of a nation that has some of them, or neither."""
    supplier = read(spark, sf_dir, "supplier")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("direction_id")).agg(F.collect_set("l_suppkey").alias("anchors"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("direction_id")).join(lines, "direction_id", "left")
    metrics = supplier.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 11 > 0, F.col("s_nationkey")).alias("community_id"))
    out = dr.anchor_scores(orders, supplier.filter("s_acctbal > 8000").select(F.col("s_suppkey").alias("source")), metrics)
    return out.select("direction_id", F.round("anchor", 6).alias("anchor"))


@query("""WITH r AS (SELECT l_suppkey AS paper, p_name || ' ' || p_type AS hint, min(CASE WHEN l_quantity >= 49 THEN l_partkey END) AS verified FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
h AS (SELECT DISTINCT hint, list_distinct(regexp_extract_all(lower(hint), '[\\p{L}\\p{N}]+')) AS k FROM r),
l AS (SELECT p_partkey AS id, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS k FROM part),
b AS (SELECT hint, id, round(len(list_intersect(h.k, l.k)) / len(list_distinct(list_concat(h.k, l.k))), 9) AS j FROM h, l),
g AS (SELECT hint, id FROM (SELECT hint, id, row_number() OVER (PARTITION BY hint ORDER BY j DESC, id) AS n FROM b WHERE j >= 0.5) WHERE n = 1)
SELECT paper, r.hint AS hint, coalesce(verified, id) AS target, CASE WHEN verified IS NOT NULL THEN 'verified' WHEN id IS NOT NULL THEN 'title' ELSE 'unresolved' END AS how FROM r LEFT JOIN g ON r.hint = g.hint""")
def snowball_bwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts named by each supplier's lines resolve to: a part of a large line, which counts as verified, a part of a similar name, or nothing."""
    part = read(spark, sf_dir, "part")
    named = read(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("hint")), "l_partkey")
    refs = named.groupBy(F.col("l_suppkey").alias("paper"), "hint").agg(F.min(F.when(F.col("l_quantity") >= 49, F.col("l_partkey"))).alias("verified"))
    return gr.backward(refs, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))


@query(f"""WITH e AS ({EDGES_SQL}) SELECT seed, node, CASE WHEN min(p) = 1 THEN 'cited_by' ELSE 'cites' END AS how FROM (
SELECT dst AS seed, src AS node, 1 AS p FROM e UNION ALL SELECT src, dst, 2 FROM e) GROUP BY seed, node""")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers beside every supplier."""
    return gr.neighbours(_seeds(spark, sf_dir), supplier_citations(spark, sf_dir))


@query("""WITH t AS (SELECT DISTINCT p_brand AS surname, CASE l_linenumber % 4 WHEN 0 THEN split_part(p_type, ' ', 1) WHEN 1 THEN 'Nobody' ELSE '' END AS secondary, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1990 + p_size + l_linenumber % 3 - 1 END AS year, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE '' END AS hint FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT p_partkey AS key, p_brand AS first, [p_brand, split_part(p_type, ' ', 1)] AS names, 1990 + p_size AS y, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) > 2)) AS b, p_size % 5 AS c, p_partkey % 3 AS i FROM part),
u AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(hint), '[a-z0-9]+'), lambda x: length(x) > 2)) AS a FROM t WHERE year > 0),
d AS (SELECT u.*, key, c, i, y, first = surname AS f, list_contains(names, secondary) AS met, 0.55 * CASE WHEN first = surname THEN 1.0 ELSE 0.6 END + 0.35 * CASE WHEN y = year THEN 1.0 ELSE 0.5 END + 0.10 * CASE WHEN secondary = '' THEN 0 WHEN list_contains(names, secondary) THEN 1 ELSE -1 END AS base,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 0.5 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.5 * len(list_intersect(a, b)) / least(len(a), len(b)) END AS ts FROM u JOIN r ON list_contains(names, surname) AND abs(y - year) <= 1),
e AS (SELECT *, round(CAST(CASE WHEN hint <> '' THEN 0.7 * base + 0.3 * ts ELSE base END AS DOUBLE), 9) AS score FROM d),
g AS (SELECT *, row_number() OVER w AS n, round(score - lead(score) OVER w, 9) AS gap FROM e WINDOW w AS (PARTITION BY surname, secondary, year, hint ORDER BY score DESC, c DESC, i DESC, key)),
h AS (SELECT *, CASE WHEN score >= 0.9 AND NOT coalesce(gap < 0.1, false) THEN 'strong' WHEN score >= 0.55 THEN 'weak' ELSE 'unmatched' END AS tier FROM g WHERE n = 1)
SELECT t.surname AS surname, t.secondary AS secondary, CAST(t.year AS INTEGER) AS year, t.hint AS hint, CASE WHEN tier <> 'unmatched' THEN key END AS key, round(coalesce(score, 0.0), 6) AS score, round(gap, 6) AS gap, coalesce(tier, 'unmatched') AS tier,
  CASE WHEN t.year = 0 THEN 'bad_target' WHEN tier IS NULL THEN 'no_candidate' WHEN tier = 'unmatched' THEN 'low_score' ELSE concat_ws('+', CASE WHEN f THEN 'first_author' ELSE 'any_author' END, CASE WHEN y = t.year THEN 'year' ELSE 'year_off' || abs(y - t.year) END, CASE WHEN t.secondary <> '' THEN CASE WHEN met THEN 'coauthor_match' ELSE 'coauthor_miss' END END, CASE WHEN gap < 0.1 THEN 'tiebreak' END) END AS method
FROM t LEFT JOIN h ON t.surname = h.surname AND t.secondary = h.secondary AND t.year = h.year AND t.hint = h.hint""")
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited (brand, second name, year, name) of every order line, resolved to parts within a year; a part's type is its second author."""
    part = read(spark, sf_dir, "part")
    second = F.substring_index("p_type", " ", 1)
    line = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").alias("n")).distinct().join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_name", second.alias("s")), "l_partkey")
    n = F.col("n")
    year = F.when(n == 7, 0).otherwise(F.lit(1990) + F.col("p_size") + n % 3 - 1).cast("int")
    targets = line.select(F.col("p_brand").alias("surname"), F.when(n % 4 == 0, F.col("s")).when(n % 4 == 1, "Nobody").otherwise("").alias("secondary"), year.alias("year"), F.when(n % 2 == 0, F.col("p_name")).otherwise("").alias("hint"))
    registry = part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("surname"), F.array("p_brand", second).alias("surnames"), (F.lit(1990) + F.col("p_size")).alias("year"), F.col("p_name").alias("title"), (F.col("p_size") % 5).alias("citations"), (F.col("p_partkey") % 3).alias("in_corpus"))
    out = gr.resolve(targets, registry)
    return out.withColumn("score", F.round("score", 6)).withColumn("gap", F.round("gap", 6))


_TRADE = "SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _trade(spark, sf_dir) -> DataFrame:
    return _bought(spark, sf_dir).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()


def _unrolled_pagerank(rounds: int, edges: str = _TRADE) -> str:
    parts = [
        f"e AS MATERIALIZED ({edges})", "o AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY src)",
        "n AS MATERIALIZED (SELECT node, out FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN o ON node = src)",
        "c AS MATERIALIZED (SELECT count(*) AS n FROM n)", "r0 AS MATERIALIZED (SELECT node, out, 1.0 / c.n::DOUBLE AS rank FROM n, c)",
    ]
    for i in range(rounds):
        parts.append(f"g{i} AS MATERIALIZED (SELECT dst AS node, sum(rank / out) AS got FROM e JOIN r{i} ON src = node GROUP BY dst)")
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, n.out, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE out IS NULL) / c.n) AS rank FROM n LEFT JOIN g{i} ON n.node = g{i}.node, c)")
    return "WITH " + ", ".join(parts) + f" SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@query(_unrolled_pagerank(20))
def pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of customers and suppliers after twenty rounds."""
    return gr.pagerank(_trade(spark, sf_dir), 20).select("node", F.round("rank", 8).alias("rank"))


@query(_unrolled_pagerank(60, EDGES_SQL).replace("round(rank, 8) AS rank", "round(rank, 7) AS rank, true AS converged"))
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of suppliers to an error of 1e-9."""
    out = cv.pagerank_until(supplier_citations(spark, sf_dir), 1e-9)
    return out.select("node", F.round("rank", 7).alias("rank"), (F.col("residual") <= 1e-9).alias("converged"))


def _unrolled_hits(rounds: int) -> str:
    parts = [f"e AS MATERIALIZED ({EDGES_SQL})", "n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)", "h0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS hub FROM n)"]
    for i in range(rounds):
        parts.append(f"x{i} AS MATERIALIZED (SELECT dst AS node, sum(hub) AS a FROM e JOIN h{i} ON src = node GROUP BY dst)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT node, a / (SELECT sum(a) FROM x{i}) AS authority FROM x{i})")
        parts.append(f"y{i} AS MATERIALIZED (SELECT src AS node, sum(authority) AS h FROM e JOIN a{i} ON dst = node GROUP BY src)")
        parts.append(f"h{i + 1} AS MATERIALIZED (SELECT n.node, coalesce(h / (SELECT sum(h) FROM y{i}), 0) AS hub FROM n LEFT JOIN y{i} ON n.node = y{i}.node)")
    last = rounds - 1
    return "WITH " + ", ".join(parts) + f" SELECT h.node AS node, round(coalesce(authority, 0), 7) AS authority, round(hub, 7) AS hub FROM h{rounds} h LEFT JOIN a{last} a ON h.node = a.node"


@query(_unrolled_hits(10))
def hits_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities and hubs of suppliers after ten rounds."""
    return gr.hits(supplier_citations(spark, sf_dir), 10).select("node", F.round("authority", 7).alias("authority"), F.round("hub", 7).alias("hub"))


@query(_unrolled_hits(40).replace(" FROM h40 h", ", 'power' AS how FROM h40 h"))
def hits_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities and hubs of suppliers when they stop changing."""
    out = cv.hits_until(supplier_citations(spark, sf_dir), 1e-10)
    return out.select("node", F.round("authority", 7).alias("authority"), F.round("hub", 7).alias("hub"), "how")


@query(f"WITH e AS ({EDGES_SQL}) SELECT node, round(sum(i) / (SELECT count(*) FROM e), 8) AS authority, round(sum(o) / (SELECT count(*) FROM e), 8) AS hub FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY node")
def degree_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degree_hits(supplier_citations(spark, sf_dir)).select("node", F.round("authority", 8).alias("authority"), F.round("hub", 8).alias("hub"))


@query(f"""WITH e AS ({EDGES_SQL}), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), s AS (SELECT s_suppkey AS seed FROM supplier),
w AS (SELECT seed, seed AS node, 0 AS hops FROM s UNION ALL SELECT seed, b, 1 FROM s JOIN b ON seed = a UNION ALL SELECT seed, y.b, 2 FROM s JOIN b x ON seed = x.a JOIN b y ON x.b = y.a)
SELECT seed, node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY seed, node""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers within two steps of every supplier."""
    return gr.reachable(_seeds(spark, sf_dir), supplier_citations(spark, sf_dir), 2)


def _unrolled_labels(rounds: int) -> str:
    parts = [f"e AS MATERIALIZED ({EDGES_SQL})", "b AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)", "l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM b)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY n DESC, label) AS k FROM (SELECT a AS node, label, count(*) AS n FROM b JOIN l{i} ON b.b = node GROUP BY a, label)) WHERE k = 1)")
    return "WITH " + ", ".join(parts) + f""", s AS (SELECT label, count(*) AS size, min(node) AS first FROM l{rounds} GROUP BY label), i AS (SELECT label, size, row_number() OVER (ORDER BY size DESC, first) - 1 AS id FROM s)
SELECT node, CAST(id AS BIGINT) AS community_id, CAST(size AS BIGINT) AS community_size FROM l{rounds} JOIN i USING (label)"""


@query(_unrolled_labels(5))
def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of suppliers by five rounds of label propagation, numbered by size."""
    return gr.communities(supplier_citations(spark, sf_dir), 5)


@query(f"""WITH e AS ({EDGES_SQL}), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), c AS (SELECT x.s_nationkey AS ca, y.s_nationkey AS cb FROM b JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey)
SELECT round((SELECT avg(CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END) FROM c) - (SELECT sum(s * s) FROM (SELECT count(*) / (SELECT count(*) FROM c) AS s FROM c GROUP BY ca)), 8) AS modularity""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the partition of suppliers by nation."""
    parts = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community_id"))
    return gr.modularity(supplier_citations(spark, sf_dir), parts).select(F.round("modularity", 8).alias("modularity"))


#: Shortest paths of up to six steps, more than a path in the fixtures' graph has: s, t, steps d, their number p.
_PATHS = f"""e AS MATERIALIZED ({EDGES_SQL}), n AS MATERIALIZED (SELECT src AS v FROM e UNION SELECT dst FROM e), p0 AS MATERIALIZED (SELECT v AS s, v AS t, 0 AS d, 1.0::DOUBLE AS p FROM n),
""" + ", ".join(
    f"p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL SELECT * FROM (SELECT x.s AS s, e.dst AS t, {i} AS d, sum(p) AS p FROM p{i - 1} x JOIN e ON x.t = e.src WHERE x.d = {i - 1} GROUP BY x.s, e.dst) y WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} z WHERE z.s = y.s AND z.t = y.t))"
    for i in range(1, 7)
) + """, b AS MATERIALIZED (SELECT v AS node, coalesce(sum(q), 0) / greatest((count(*) OVER () - 1) * (count(*) OVER () - 2), 1) AS b FROM n LEFT JOIN
  (SELECT x.t AS k, sum(x.p * y.p / z.p) AS q FROM p6 x JOIN p6 y ON x.t = y.s JOIN p6 z ON z.s = x.s AND z.t = y.t WHERE x.d > 0 AND y.d > 0 AND z.d = x.d + y.d GROUP BY x.t) ON k = v GROUP BY v)"""


@query(f"WITH {_PATHS} SELECT node, round(b, 8) AS betweenness FROM b")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact betweenness of suppliers."""
    return gr.betweenness(supplier_citations(spark, sf_dir)).select("node", F.round("betweenness", 8).alias("betweenness"))


@query(f"""WITH {_PATHS.split(", b AS MATERIALIZED")[0]}, z AS (SELECT count(*) AS n, least(count(*), ceil((count(*) / (count(*) - 1)) ** 2 * ln(2 * count(*) / 0.05) / (2 * 0.25 ** 2))) AS need FROM n),
c AS MATERIALIZED (SELECT v FROM n, z WHERE z.need >= z.n OR ('0x' || substr(md5(CAST(v AS VARCHAR)), 1, 8))::BIGINT < floor((z.need + 3 * sqrt(z.need)) / z.n * 4294967296)),
q AS (SELECT x.t AS k, sum(x.p * y.p / w.p) AS q FROM p6 x JOIN p6 y ON x.t = y.s JOIN p6 w ON w.s = x.s AND w.t = y.t WHERE x.d > 0 AND y.d > 0 AND w.d = x.d + y.d AND x.s IN (SELECT v FROM c) GROUP BY x.t), s AS (SELECT count(*) AS k FROM c)
SELECT v AS node, round(coalesce(q.q, 0) * z.n / s.k / greatest((z.n - 1) * (z.n - 2), 1), 8) AS betweenness, s.k AS sources, CASE WHEN s.k = z.n THEN 0.0::DOUBLE ELSE round(z.n / (z.n - 1) * sqrt(ln(2 * z.n / 0.05) / (2 * s.k)), 8) END AS error
FROM n LEFT JOIN q ON q.k = v CROSS JOIN z CROSS JOIN s""")
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of suppliers from as many sources as an error of 0.25 needs, all of them in small graphs."""
    out = gr.betweenness_sampled(supplier_citations(spark, sf_dir), error=0.25)
    return out.select("node", F.round("betweenness", 8).alias("betweenness"), "sources", F.round("error", 8).alias("error"))


@query(f"""WITH {_BATCH}, c AS (SELECT query_id, label, count(*) AS n FROM nn JOIN embeddings e ON nn.vec_id = e.vec_id GROUP BY query_id, label), s AS (SELECT query_id, label, n, sum(n) OVER (PARTITION BY query_id) AS t, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS k FROM c)
SELECT query_id, label, round(n / t, 6) AS share, n / t > 0.7 AS concentrated FROM s WHERE k = 1""")
def community_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest label among the neighbours of each query vector, flagged above seven tenths."""
    c = _batch(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    total = c.groupBy("query_id").agg(F.sum("n").alias("t"))
    best = top_k(c, 1, ["query_id"], [F.col("n").desc(), F.col("label")]).join(total, "query_id")
    return best.select("query_id", "label", F.round(F.col("n") / F.col("t"), 6).alias("share"), (F.col("n") / F.col("t") > 0.7).alias("concentrated"))


_METRICS = f"m AS (WITH e AS ({EDGES_SQL}) SELECT s_suppkey AS node, s_nationkey AS community, coalesce(i, 0) AS i, coalesce(o, 0) AS o, s_acctbal AS rcr FROM supplier LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY dst) ON dst = s_suppkey LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY src) ON src = s_suppkey)"


def _metrics(spark, sf_dir) -> DataFrame:
    e = supplier_citations(spark, sf_dir)
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"), F.col("s_acctbal").alias("rcr"))
    rows = rows.join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")), "node", "left").join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o")), "node", "left")
    return rows.fillna(0, ["i", "o"])


@query(f"WITH {_PATHS}, m AS (SELECT s_suppkey AS node, s_nationkey AS community, round(round(b, 8), 6) AS b FROM supplier JOIN b ON node = s_suppkey) SELECT min(node) AS node, community, b AS betweenness FROM m WHERE b > 0 AND (SELECT count(DISTINCT community) FROM m) >= 2 GROUP BY community, b")
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers between nations, by betweenness."""
    nation = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    return gr.bridges(gr.betweenness(supplier_citations(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 8)).join(nation, "node"))


@query(f"WITH {_METRICS} SELECT node, CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE s END AS score FROM (SELECT node, round((rcr / (SELECT max(rcr) FROM m)) * (1 - i / (SELECT max(i) FROM m)), 6) AS s FROM m)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.orphans(_metrics(spark, sf_dir).select("node", "rcr", F.col("i").alias("in_corpus"))).select("node", F.round("score", 6).alias("s")).select("node", F.when(F.col("s") == 0, 0.0).otherwise(F.col("s")).alias("score"))  # no negative zero


@query("""WITH p AS (SELECT p_partkey AS node, p_brand AS community, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}]+')) AS k FROM part),
b AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_partkey <> y.l_partkey)
SELECT s.node AS seed, o.node AS other, CAST(len(list_intersect(s.k, o.k)) AS BIGINT) AS shared FROM p s JOIN p o ON s.community = o.community AND s.node < o.node
WHERE len(list_intersect(s.k, o.k)) >= 2 AND NOT EXISTS (SELECT 1 FROM b WHERE b.a = s.node AND b.b = o.node)""")
def uncited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts of a brand with similar names that no order has together."""
    papers = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"), F.array_distinct(words(F.concat_ws(" ", "p_name", "p_type"))).alias("tokens"))
    # an order's parts of other brands take no pair away, so they don't meet
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(papers.select(F.col("node").alias("l_partkey"), "community"), "l_partkey")
    edges = line.withColumnRenamed("l_partkey", "src").join(line.withColumnRenamed("l_partkey", "dst"), ["l_orderkey", "community"]).filter("src < dst").select("src", "dst").distinct()
    return gr.uncited_pairs(None, papers, edges)


_TOPICS = "t AS (SELECT p_partkey AS node, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\\p{L}\\p{N}]+')) AS k FROM part)"


_FOLLOWS = "SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem"


@query(f"""WITH {_TOPICS}, e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), n AS (SELECT src, count(*) AS n FROM e GROUP BY src),
w AS (SELECT DISTINCT dst AS seed, src AS other FROM ({_FOLLOWS}) WHERE dst % 20 = 0 AND src <> dst),
c AS (SELECT a.src AS seed, b.src AS other, count(*) AS shared FROM e a JOIN e b ON a.dst = b.dst WHERE a.src % 20 = 0 AND a.src <> b.src GROUP BY a.src, b.src),
v AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
p AS (SELECT s.node AS seed, o.node AS other, len(list_intersect(s.k, o.k)) / len(list_distinct(list_concat(s.k, o.k))) AS topic, coalesce(list_sum(list_transform(range(1, 65), lambda i: x.v[i] * y.v[i])) / nullif(x.n * y.n, 0), 0) AS cosine
  FROM t s JOIN t o ON s.node <> o.node LEFT JOIN v x ON x.node = s.node LEFT JOIN v y ON y.node = o.node WHERE s.node % 20 = 0),
f AS (SELECT p.*, greatest(coalesce(0.6 * shared / (x.n + y.n - shared), 0), CASE WHEN w.seed IS NULL THEN 0 ELSE 1 END) AS cite FROM p LEFT JOIN c USING (seed, other) LEFT JOIN w USING (seed, other) LEFT JOIN n x ON x.src = seed LEFT JOIN n y ON y.src = other),
g AS (SELECT seed, other, round(0.40 * topic + 0.35 * cosine + 0.25 * cite, 9) AS score, concat_ws(',', CASE WHEN topic > 0 THEN 'topics' END, CASE WHEN cosine > 0 THEN 'vectors' END, CASE WHEN cite > 0 THEN 'citations' END) AS reasons FROM f)
SELECT seed, other, round(score, 6) AS score, reasons, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, other) AS rank FROM g WHERE score > 0.05) WHERE rank <= 10""")
def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts related to every part whose id is divisible by 20: by shared words, the vector of their number, shared suppliers, and parts that come just before them in an order."""
    from pyspark.sql.window import Window

    from corpusloom.operators.topics import related

    papers = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.array_distinct(words(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).alias("topics"))
    line = read(spark, sf_dir, "lineitem")
    edges = line.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    follows = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    forward = line.select(follows.alias("seed"), F.col("l_partkey").alias("other")).filter("seed is not null").distinct()
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    out = related(papers.filter("node % 20 = 0").select(F.col("node").alias("seed")), papers, edges, vectors=vectors, forward=forward)
    return out.select("seed", "other", F.round("score", 6).alias("score"), "reasons", F.col("rank").cast("long").alias("rank"))
