r"""Queries over metadata: read from texts, file names and model answers, joined with records. Texts are made up from the fixtures' names and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import answers as an
from corpusloom.functions import authors as au
from corpusloom.functions import metadata as md
from corpusloom.operators import bibliography as bib
from corpusloom.operators import graph as gr
from corpusloom.plans.retrieval_queries import EDGES_SQL, supplier_citations
from corpusloom.sources.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _s(c: Column) -> Column:
    return c.cast("string")


_TITLED = """SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Title: On ' || c_name || chr(10) END || CASE WHEN c_custkey % 3 = 0 THEN 'Author: Lee' || c_custkey || chr(10) ELSE 'Authors:  Lee, Ann; Wu' || c_custkey || '  ' || chr(10) END
  || CASE WHEN c_custkey % 5 = 0 THEN 'Year: 20' || chr(10) ELSE 'Year: ' || (1990 + c_custkey % 30) || chr(10) END || 'Journal: ' || c_mktsegment || chr(10) || 'doi:10.1/x' || c_custkey || chr(10) || chr(10) || 'Body of ' || c_name || chr(10) || 'Year: 1066' AS text, c_name, c_mktsegment FROM customer"""


def _titled(spark, sf_dir) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.concat(
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Title: On "), name, F.lit("\n"))), F.when(k % 3 == 0, F.concat(F.lit("Author: Lee"), _s(k), F.lit("\n"))).otherwise(F.concat(F.lit("Authors:  Lee, Ann; Wu"), _s(k), F.lit("  \n"))),
        F.when(k % 5 == 0, "Year: 20\n").otherwise(F.concat(F.lit("Year: "), _s(1990 + k % 30), F.lit("\n"))), F.lit("Journal: "), "c_mktsegment", F.lit("\ndoi:10.1/x"), _s(k), F.lit("\n\nBody of "), name, F.lit("\nYear: 1066"),
    )
    return read(spark, sf_dir, "customer").select(k.alias("k"), text.alias("text"), "c_name", "c_mktsegment")


@query(rf"""WITH a AS ({_TITLED}), f AS (SELECT *, nullif(trim(regexp_extract(text, '(?m)^Title:\s*(.+)$', 1)), '') AS title, nullif(trim(regexp_extract(text, '(?m)^Authors?:\s*(.+)$', 1)), '') AS authors, nullif(regexp_extract(text, '(?m)^Year:\s*([0-9]{{4}})', 1), '') AS year, nullif(trim(regexp_extract(text, '(?m)^Journal:\s*(.+)$', 1)), '') AS journal FROM a)
SELECT k, title, authors, year, journal, CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN text WHEN k % 3 = 0 THEN regexp_replace(text, '^[^\n]*\n', '') ELSE regexp_replace(text, '(?s)^.*?\n\n', '') END AS body, CASE WHEN year IS NULL AND k % 2 = 0 THEN '' ELSE concat_ws(chr(10), 'Title: ' || title, 'Year: ' || year, CASE WHEN k % 2 = 1 THEN 'doi:10.9/y' END) || chr(10) || chr(10) END AS block FROM f""".replace("CASE WHEN year IS NULL AND k % 2 = 0 THEN ''", "CASE WHEN title IS NULL AND year IS NULL AND k % 2 = 0 THEN ''"))  # fmt: skip
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines of a made-up paper for every customer, the paper without its leading block, and a new block."""
    rows = _titled(spark, sf_dir).withColumn("m", md.front_matter(F.col("text")))
    fields = {"Title": F.col("m.title"), "Year": F.col("m.year"), "doi": F.when(F.col("k") % 2 == 1, " 10.9/y ")}
    return rows.select("k", "m.title", "m.authors", "m.year", "m.journal", md.strip_front_matter(F.col("text")).alias("body"), md.format_front_matter(fields).alias("block"))


@query(r"""WITH a AS (SELECT p_partkey AS k, ['# Methods' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '## **On ' || p_name || ' and more**' WHEN 1 THEN '**' || p_name || ' studied again**' WHEN 2 THEN '## Two words' ELSE '' END || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'Copyright Elsevier' || chr(10) || (1980 + p_size) WHEN 1 THEN 'see 10.1101/' || (1960 + p_size) || '.1' ELSE 'in 1999' END,
  '## Abstract: ' || chr(10) || repeat(p_name || ' ', p_size % 12) || chr(10) || '## Next' || chr(10) || 'published 2001', '## Summary' || chr(10) || repeat('x ', 60)] AS s, p_name FROM part),
u AS (SELECT k, unnest(s) AS c, generate_subscripts(s, 1) AS i FROM a),
x AS (SELECT k, i, coalesce(nullif(regexp_extract(c[:2000], '(?is)(?:©|Copyright|published|received|preprint|Cite this as).{0,40}?(19[0-9]{2}|20[0-3][0-9])', 1), ''), nullif(regexp_extract(c[:2000], '10\.1101/(19[0-9]{2}|20[0-3][0-9])', 1), '')) AS y,
  trim(regexp_replace(regexp_extract(c, '(?is)##\s*\*?\*?(?:Abstract|Summary|Background|Introduction|Research\s+briefing)[:\s]*\n*(.*)', 1), '(?s)\n##\s.*$', ''), chr(10) || ' ') AS ab FROM u),
l AS (SELECT k, i, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1) AS j FROM u),
h AS (SELECT k, i, j, trim(regexp_extract(trim(line), '^#{1,6}\s*\*{0,2}(.+?)\*{0,2}\s*$', 1)) AS head, trim(regexp_extract(trim(line), '^\*\*(.+)\*\*$', 1)) AS bold FROM l),
t AS (SELECT k, arg_min(head, i * 1000 + j) FILTER (WHERE len(list_distinct(list_filter(regexp_extract_all(lower(head), '[a-z0-9]+'), lambda x: length(x) > 2))) >= 3) AS head, arg_min(bold, i * 1000 + j) FILTER (WHERE len(list_distinct(list_filter(regexp_extract_all(lower(bold), '[a-z0-9]+'), lambda x: length(x) > 2))) >= 3) AS bold FROM h GROUP BY k)
SELECT x.k AS k, arg_min(y, i) FILTER (WHERE y IS NOT NULL) AS year, coalesce(arg_min(ab, i) FILTER (WHERE length(ab) > 100), '') AS abstract, coalesce(any_value(head), any_value(bold), '') AS title FROM x JOIN t ON t.k = x.k GROUP BY x.k""")
def content_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, abstract and title that the sections of a made-up paper for every part tell."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    head = F.when(k % 4 == 0, F.concat(F.lit("## **On "), name, F.lit(" and more**"))).when(k % 4 == 1, F.concat(F.lit("**"), name, F.lit(" studied again**"))).when(k % 4 == 2, "## Two words").otherwise("")
    year = F.when(k % 3 == 0, F.concat(F.lit("Copyright Elsevier\n"), _s(1980 + size))).when(k % 3 == 1, F.concat(F.lit("see 10.1101/"), _s(1960 + size), F.lit(".1"))).otherwise("in 1999")
    second = F.concat(F.lit("## Abstract: \n"), F.expr("repeat(concat(p_name, ' '), p_size % 12)"), F.lit("\n## Next\npublished 2001"))
    sections = F.array(F.concat(F.lit("# Methods\n"), head, F.lit("\n"), year), second, F.concat(F.lit("## Summary\n"), F.expr("repeat('x ', 60)")))
    rows = read(spark, sf_dir, "part").select(k.alias("k"), sections.alias("s"))
    return rows.select("k", md.year_from_content(F.col("s")).alias("year"), md.abstract_of(F.col("s")).alias("abstract"), md.title_from_content(F.col("s")).alias("title"))


@query(r"""WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN (1000000 + o_orderkey) || '_md.json' WHEN 1 THEN '10_1111_2Fgcb_' || o_orderkey || '_md.json' WHEN 2 THEN '10_1038_s' || o_orderkey || '_x.json' WHEN 3 THEN 'Lee_2020_Nature_' || o_orderkey || '.json' WHEN 4 THEN '12.json' ELSE 'Wu 2019 Only ' || o_orderkey END AS f FROM orders)
SELECT k, nullif(regexp_extract(f, '^([0-9]{6,9})(?:_md)?\.json$', 1), '') AS pmid, CASE k % 6 WHEN 1 THEN '10.1111/gcb.' || k WHEN 2 THEN '10.1038/s' || k || '.x' END AS doi, nullif(y, '') AS year, CASE WHEN len(p) >= 2 THEN p[1] END AS journal, CASE WHEN len(p) >= 2 THEN array_to_string(p[2:], ' ') WHEN len(p) = 1 THEN p[1] END AS title
FROM (SELECT *, regexp_extract(f, '^(?:[\w\-.]+?)[_\s]+((?:19|20)[0-9]{2})[_\s]+(.*)$', 1) AS y, list_filter(list_transform(string_split(regexp_extract(f, '^(?:[\w\-.]+?)[_\s]+((?:19|20)[0-9]{2})[_\s]+(.*)$', 2), '_'), lambda x: trim(x)), lambda x: x <> '') AS p FROM a)""")
def filename_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file names of made-up papers, one for every order, carry."""
    k = F.col("o_orderkey")
    name = F.when(k % 6 == 0, F.concat(_s(1000000 + k), F.lit("_md.json"))).when(k % 6 == 1, F.concat(F.lit("10_1111_2Fgcb_"), _s(k), F.lit("_md.json"))).when(k % 6 == 2, F.concat(F.lit("10_1038_s"), _s(k), F.lit("_x.json")))
    name = name.when(k % 6 == 3, F.concat(F.lit("Lee_2020_Nature_"), _s(k), F.lit(".json"))).when(k % 6 == 4, "12.json").otherwise(F.concat(F.lit("Wu 2019 Only "), _s(k)))
    rows = read(spark, sf_dir, "orders").select(k.alias("k"), name.alias("f"))
    return rows.select("k", md.pmid_from_filename(F.col("f")).alias("pmid"), md.doi_from_filename(F.col("f")).alias("doi"), md.from_filename(F.col("f")).alias("n")).select("k", "pmid", "doi", "n.year", "n.journal", "n.title")


@query(r"""WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS title, 'Lee,Ann F.; Wu,' || s_suppkey || ';Kim, Bo;Last,One' AS authors, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Bone' END AS journal, 1990 + s_nationkey AS year FROM supplier),
e AS (SELECT *, list_filter(list_transform(string_split_regex(authors, '[;,]'), lambda x: trim(x)), lambda x: x <> '')[:5] AS e FROM a)
SELECT k, concat_ws(' ', title, array_to_string(list_filter(flatten(list_transform(e, lambda x: string_split_regex(x, '[,\s]+'))), lambda t: t <> ''), ' '), nullif(journal, ''), year::VARCHAR)[:2000] AS text FROM e""")
def metadata_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the metadata channel searches, for every supplier as a paper."""
    k = F.col("s_suppkey")
    authors = F.concat(F.lit("Lee,Ann F.; Wu,"), _s(k), F.lit(";Kim, Bo;Last,One"))
    text = md.metadata_text(F.when(k % 3 != 0, F.col("s_name")), authors, F.when(k % 2 == 0, "").otherwise("Bone"), 1990 + F.col("s_nationkey"))
    return read(spark, sf_dir, "supplier").select(k.alias("k"), text.alias("text"))


@query("""SELECT doc_id AS k, CASE doc_id % 6 WHEN 0 THEN 'a' || doc_id || '|b' WHEN 1 THEN 'x y' WHEN 2 THEN 'deep ' || doc_id WHEN 3 THEN '1|2.5' ELSE '' END AS queries FROM documents""")
def model_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in made-up model answers, one for every document: fenced, a bare list, amid prose, numbers, broken and empty."""
    k = F.col("doc_id")
    text = F.when(k % 6 == 0, F.concat(F.lit('```json\n{"queries": ["a'), _s(k), F.lit('", " b ", ""]}\n```'))).when(k % 6 == 1, '["x y"]').when(k % 6 == 2, F.concat(F.lit('Sure: {"note": 1, "queries": ["deep '), _s(k), F.lit('"]} as asked'))).when(k % 6 == 3, '{"queries": [1, 2.5]}').when(k % 6 == 4, '{"queries": ["a"')
    return read(spark, sf_dir, "documents").select(k.alias("k"), F.array_join(md.queries_of(text), "|").alias("queries"))


@query(r"""WITH a AS (SELECT p_partkey AS k, lower(p_brand) || ' ' || p_name AS topic, p_name AS h1, CASE WHEN p_size % 3 = 0 THEN 'generic' ELSE p_type END AS h2, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_type || ' bone' END AS h3 FROM part),
b AS (SELECT *, list_filter(string_split_regex(lower(topic), '\s+'), lambda w: w <> '') AS w0, list_filter(string_split_regex(lower(h2), '\s+'), lambda w: w <> '') AS w2, list_filter(string_split_regex(lower(h3), '\s+'), lambda w: w <> '') AS w3 FROM a),
c AS (SELECT *, h2 <> 'generic' AND len(list_filter(w2, lambda w: NOT list_contains(w0, w))) > 0 AS n2 FROM b),
d AS (SELECT *, coalesce(len(list_filter(w3, lambda w: NOT list_contains(CASE WHEN n2 THEN list_concat(w0, w2) ELSE w0 END, w))) > 0, false) AS n3 FROM c),
f AS (SELECT k, topic, list_distinct(regexp_extract_all(lower(topic), '[a-z0-9][a-z0-9\-]{2,}')) AS q, list_distinct(regexp_extract_all(lower(coalesce(h3, '')), '[a-z0-9][a-z0-9\-]{2,}')) AS t FROM a)
SELECT d.k AS k, concat_ws(' ', d.topic, CASE WHEN n2 THEN h2 END, CASE WHEN n3 THEN h3 END) AS query, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / len(q) END, 6) AS focus FROM d JOIN f USING (k)""")
def scoped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for every part with the hints that add words, and how much of it the last hint has."""
    topic = F.concat_ws(" ", F.lower("p_brand"), "p_name")
    h2, h3 = F.when(F.col("p_size") % 3 == 0, "generic").otherwise(F.col("p_type")), F.when(F.col("p_size") % 2 == 1, F.concat("p_type", F.lit(" bone")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), md.scoped_query(topic, [F.col("p_name"), h2, h3]).alias("query"), F.round(md.focus_overlap(topic, h3), 6).alias("focus"))


@query(r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])[ \t\n\r\f\v]+', E'\\1\x01', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(t, '([.!?])[ \t\n\r\f\v]+', E'\\1\x01', 'g'), chr(1)), 1) AS i FROM a),
c AS (SELECT doc_id, i, regexp_replace(trim(s), '^\s*(?:[#>\-*•]+\s*|[0-9]+[.)\]]\s*)+', '') AS s FROM s),
g AS (SELECT doc_id, arg_min(s, i) AS s FROM c WHERE length(s) >= 40 AND regexp_matches(s, '[.!?]["'')\]]?$') AND length(regexp_replace(s, '[^\p{L}]', '', 'g')) / length(s) >= 0.55 AND upper(s) <> s GROUP BY doc_id)
SELECT a.doc_id AS doc_id, coalesce(g.s, '') AS fact, CAST(len(string_split(regexp_replace(t, '([.!?])[ \t\n\r\f\v]+', E'\\1\x01', 'g'), chr(1))) AS BIGINT) AS ends, CAST(len(string_split(regexp_replace(t, '([.!?])[ \t\n\r\f\v]+([A-Z0-9])', E'\\1\x01\\2', 'g'), chr(1))) AS BIGINT) AS starts, CAST(len(string_split(t, '. ')) AS BIGINT) AS stops, CAST(len(regexp_extract_all(t, '[^.!?\n]{40,}[.!?]')) AS BIGINT) AS prose FROM a LEFT JOIN g ON g.doc_id = a.doc_id""")
def sentence_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clean sentence of every document, and its sentences by the four ways to cut."""
    t = F.coalesce("text", F.lit(""))
    n = lambda way: F.size(md.sentences_by(t, way)).cast("long").alias(way)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")  # a large file can be one row group
    return docs.select("doc_id", md.clean_sentence(t).alias("fact"), n("ends"), n("starts"), n("stops"), n("prose"))


@query("""WITH t AS (SELECT source, CASE WHEN count(*) % 2 = 0 THEN 'review' ELSE 'methods' END AS a, list_sort(list_distinct(list(lang)))[:2] AS t FROM documents WHERE source <> 'src3' GROUP BY source)
SELECT doc_id, d.source AS source, coalesce(a, 'old') AS article_type, array_to_string(CASE WHEN a IS NULL THEN [lang] ELSE t END, ',') AS topics FROM documents d LEFT JOIN t ON t.source = d.source""")
def tag_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with old tags, rewritten by their source's; one source has none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.lit("old").alias("article_type"), F.array("lang").alias("topics"), "lang")
    tags = docs.filter("source <> 'src3'").groupBy("source").agg(F.when(F.count("*") % 2 == 0, "review").otherwise("methods").alias("article_type"), F.slice(F.array_sort(F.collect_set("lang")), 1, 2).alias("topics"))
    return bib.apply_tags(docs, tags).select("doc_id", "source", "article_type", F.concat_ws(",", "topics").alias("topics"))


@query("SELECT source, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents WHERE source <> '' GROUP BY source")
def first_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and length of each source's first document."""
    return bib.first_metadata(read(spark, sf_dir, "documents"), ["lang", "n_chars"], "doc_id")


@query("""WITH e AS (SELECT '10.1000/' || s_suppkey AS d, s_name AS entry FROM supplier), p AS (SELECT o_orderkey AS key, '10.1000/' || o_custkey AS d FROM orders)
SELECT key, min(entry) AS entry, CASE WHEN min(entry) IS NULL THEN 'doi_no_bib' ELSE 'doi_bridge' END AS how FROM p LEFT JOIN e USING (d) GROUP BY key""")
def doi_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers as DOIs of papers, suppliers as entries with the DOI in another form."""
    entries = read(spark, sf_dir, "supplier").select(F.concat(F.lit("10.1000/"), _s(F.col("s_suppkey")), F.lit(".")).alias("doi"), F.col("s_name").alias("entry"))
    papers = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("https://doi.org/10.1000/"), _s(F.col("o_custkey"))).alias("doi"))
    return bib.doi_bridge(papers, entries).select("key", "entry", "how")


_SQUASH = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH p AS (SELECT p_partkey AS key, {_SQUASH.format("p_brand")} AS s, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE (1950 + p_size)::VARCHAR END AS y, {_SQUASH.format("p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE '' END")}[:50] AS t, {_SQUASH.format("p_type || ' of ' || p_name")} AS ab FROM part),
e AS (SELECT p_partkey AS entry, {_SQUASH.format("upper(p_brand)")} AS s, (1950 + p_size)::VARCHAR AS y, {_SQUASH.format("p_name || ' ' || p_type")} AS u, {_SQUASH.format("CASE WHEN p_partkey % 3 = 0 THEN p_type || ' of ' || p_name END")} AS ub FROM part WHERE p_partkey % 7 <> 0),
m AS (SELECT key, entry, len(list_intersect(list_distinct(string_split(u[:25], '')), list_distinct(string_split(t[:25], '')))) + CASE WHEN ab <> '' AND ub <> '' AND (contains(ab, ub[:30]) OR contains(ub, ab[:30])) THEN 10 ELSE 0 END AS score FROM p JOIN e USING (s, y) WHERE y <> '' AND u <> '' AND (contains(t, u[:25]) OR contains(u, t[:25]))),
r AS (SELECT key, entry, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY score DESC, entry) AS k FROM m)
SELECT p.key AS key, entry, CASE WHEN y = '' THEN 'no_year' WHEN n IS NULL THEN 'no_match' WHEN n = 1 THEN 'matched' ELSE 'multi_match' END AS status FROM p LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON r.key = p.key""")
def title_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as papers and, most of them, as entries: brand is the surname, size the year, names are titles cut short."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    abstract, year = F.concat_ws(" of ", "p_type", "p_name"), _s(1950 + F.col("p_size"))
    papers = part.select(k.alias("key"), F.col("p_brand").alias("surname"), F.when(k % 50 == 0, "").otherwise(year).alias("year"), F.when(k % 2 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name")).alias("title"), abstract.alias("abstract"))
    entries = part.filter("p_partkey % 7 <> 0").select(k.alias("entry"), F.upper("p_brand").alias("surname"), year.alias("year"), F.concat_ws("-", "p_name", "p_type").alias("title"), F.when(k % 3 == 0, abstract).alias("abstract"), F.lit("10.1/x").alias("doi"))
    return bib.by_title_prefix(papers, entries)


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS source, lower(CASE l_linenumber % 4 WHEN 0 THEN p_name || ' et al.' WHEN 1 THEN 'Blu & Wu' WHEN 2 THEN substring(p_name, 1, 3) || ', ' ELSE 'x' END) AS a, (1990 + p_size)::VARCHAR AS year, 'line ' || l_linenumber AS via FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT source, year, via, rtrim(regexp_replace(trim(string_split_regex(a, '\\s+et\\s+al\\.?$|\\s*&\\s*|\\s+and\\s+')[1]), ',$', '')) AS a FROM u),
n AS (SELECT p_partkey AS paper, (1990 + p_size)::VARCHAR AS year, unnest(string_split(lower(p_name), ' ')) AS s FROM part)
SELECT source, paper, min(via) AS via FROM b JOIN n ON n.year = b.year AND length(a) >= 3 AND starts_with(s, a[:4]) AND paper <> source GROUP BY source, paper""")
def name_year_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved citations of suppliers' lines, by the beginning of a name and the year; parts are papers and the words of their names surnames."""
    part, m = read(spark, sf_dir, "part"), F.col("l_linenumber") % 4
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey").distinct().join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size"), "l_partkey")
    author = F.when(m == 0, F.concat("p_name", F.lit(" et al."))).when(m == 1, "Blu & Wu").when(m == 2, F.concat(F.substring("p_name", 1, 3), F.lit(", "))).otherwise("x")
    asked = line.select(F.col("l_suppkey").alias("source"), author.alias("author"), _s(1990 + F.col("p_size")).alias("year"), F.concat(F.lit("line "), _s(F.col("l_linenumber"))).alias("via"))
    papers = part.select(F.col("p_partkey").alias("paper"), _s(1990 + F.col("p_size")).alias("year"), F.split(F.lower("p_name"), " ").alias("surnames"))
    return bib.cited_by_name(asked, papers)


@query("""WITH p AS (SELECT 's' || s_suppkey AS source, 100000 + s_suppkey // 2 AS pmid FROM supplier), r AS (SELECT DISTINCT 100000 + l_suppkey // 2 AS a, 100000 + l_partkey % 3000 AS b, l_linenumber % 2 AS w FROM lineitem),
e AS (SELECT a AS x, b AS y FROM r WHERE w = 0 UNION SELECT b, a FROM r WHERE w = 1)
SELECT DISTINCT s.source AS src, t.source AS dst FROM e JOIN p s ON s.pmid = x JOIN p t ON t.pmid = y WHERE x <> y AND s.source <> t.source""")
def registry_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations between suppliers, two of which share a PMID, from records made of order lines."""
    papers = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _s(F.col("s_suppkey"))).alias("source"), (100000 + F.floor(F.col("s_suppkey") / 2)).alias("pmid"))
    other = 100000 + F.col("l_partkey") % 3000
    line = read(spark, sf_dir, "lineitem").withColumn("pmid", 100000 + F.floor(F.col("l_suppkey") / 2))
    records = line.groupBy("pmid").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, other)).alias("cited_by"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, other)).alias("refs"))
    return bib.registry_edges(papers, records)


@query("""WITH p AS (SELECT p_partkey AS key, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda x: length(x) > 2)) AS a, CASE WHEN p_partkey % 4 = 0 THEN 1000000 + p_partkey END AS m, CASE WHEN p_partkey % 3 = 0 THEN '10.1000/abcdef' || (100 + p_partkey % 900) END AS d FROM part),
h AS (SELECT p.key AS key, l_linenumber AS hit, list_distinct(list_filter(regexp_extract_all(lower(CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE p_name || ' bone growth' END), '[a-z0-9]+'), lambda x: length(x) > 2)) AS b, CASE WHEN l_linenumber = 1 THEN 1000000 + p_partkey WHEN l_linenumber = 2 THEN 7777777 END AS n, CASE WHEN l_linenumber = 3 THEN '10.1000/abcdef' || (100 + p_partkey % 900) WHEN l_linenumber = 4 THEN '10.1000/other' END AS e, a, m, d
  FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) l JOIN part ON p_partkey = l_partkey JOIN p ON p.key = p_partkey),
s AS (SELECT *, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 0.5 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.5 * len(list_intersect(a, b)) / least(len(a), len(b)) END, 9) AS score FROM h),
v AS (SELECT *, CASE WHEN m IS NOT NULL AND n IS NOT NULL THEN CASE WHEN m = n THEN 'pmid-agrees' ELSE 'no' END WHEN d IS NOT NULL AND e IS NOT NULL THEN CASE WHEN d = e THEN 'doi-agrees' ELSE 'no' END WHEN score >= 0.6 THEN 'title-match' ELSE 'no' END AS reason FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY reason LIKE '%-agrees' DESC, score DESC, hit) AS k FROM v WHERE reason <> 'no')
SELECT p.key AS key, hit, round(score, 6) AS score, reason FROM p LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON b.key = p.key""")
def registry_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best verified candidate for every part as a paper; its order lines are candidates."""
    part, k, n = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("hit")
    none = F.lit(None).cast("string")
    doi = F.concat(F.lit("10.1000/abcdef"), _s(100 + k % 900))
    papers = part.select(k.alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.when(k % 3 == 0, doi).alias("doi"), F.when(k % 4 == 0, _s(1000000 + k)).alias("pmid"), none.alias("pmcid"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("hit")).distinct().join(part, "p_partkey")
    hits = lines.select(k.alias("key"), "hit", F.when(n % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" bone growth"))).alias("title"), F.when(n == 3, doi).when(n == 4, "10.1000/other").alias("doi"), F.when(n == 1, F.concat(F.lit("PMID: "), _s(1000000 + k))).when(n == 2, "7777777").alias("pmid"), none.alias("pmcid"))
    return bib.best_registry_hit(papers, hits).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT n_regionkey AS g, n_nationkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT n_name AS source, CASE i % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'methods' ELSE 'experimental' END AS article_type, CASE i % 4 WHEN 0 THEN 'bone' WHEN 1 THEN 'a,b,c,d,e' ELSE 'x' || k || ',y' END AS topics FROM r WHERE i % 4 <> 3""")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in a broken model answer for every region about its nations as papers; every fourth row is no class."""
    from pyspark.sql.window import Window

    rows = read(spark, sf_dir, "nation").withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    m = F.col("i") % 4
    value = F.when(m == 0, "Review: Bone").when(m == 1, "methods: a, b,c , d, e, f").when(m == 2, F.concat(F.lit("experimental: x"), _s(F.col("n_nationkey")), F.lit(", Y"))).otherwise("essay: z")
    row = F.concat(F.lit('"'), _s(F.col("i")), F.lit('": "'), value, F.lit('"'))
    batches = rows.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("i", "n_name", row.alias("r")))).alias("a"))
    batches = batches.select(F.transform("a", lambda x: x["n_name"]).alias("sources"), F.concat(F.lit("Here: {"), F.array_join(F.transform("a", lambda x: x["r"]), ", "), F.lit(', "99": "rev')).alias("answer"))
    return bib.classified(batches).withColumn("topics", F.concat_ws(",", "topics"))


@query(r"""WITH f AS (SELECT source, doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\v]+', E'\\1\x01', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\v]+', E'\\1\x01', 'g'), chr(1)), 1) AS i FROM documents),
c AS (SELECT source, doc_id, i, regexp_replace(trim(s), '^\s*(?:[#>\-*•]+\s*|[0-9]+[.)\]]\s*)+', '') AS s FROM f),
g AS (SELECT source, arg_min(s, doc_id * 100000 + i) AS s FROM c WHERE length(s) >= 40 AND regexp_matches(s, '[.!?]["'')\]]?$') AND length(regexp_replace(s, '[^\p{L}]', '', 'g')) / length(s) >= 0.55 AND upper(s) <> s GROUP BY source),
q AS (SELECT item_id AS pos, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE 'what of ' || item_id END AS query, ['nowhere', 'src' || (item_id % 20), 'src0'] AS gold FROM benchmark),
k AS (SELECT q.*, coalesce(a.s, b.s) AS fact, CASE WHEN a.s IS NOT NULL THEN gold[2] ELSE 'src0' END AS src FROM q LEFT JOIN g a ON a.source = gold[2] LEFT JOIN g b ON b.source = 'src0' WHERE trim(query) <> ''),
n AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM k WHERE fact IS NOT NULL)
SELECT 'fr-' || lpad(n::VARCHAR, 4, '0') AS id, query, array_to_string(gold, ',') AS expected, fact AS key_fact, false AS refusal_expected, 'key_fact from ' || src AS note FROM n WHERE n <= 25
UNION ALL SELECT 'rf-000' || i, x, '', '', true, 'designed refusal' FROM (VALUES (1, 'How are ships built?'), (2, 'What is a harbour?')) AS v(i, x)""")
def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold set of benchmark items as queries, their sources' first clean sentences, and two queries to refuse. The limit is the set's size."""
    i = F.col("item_id")
    asked = read(spark, sf_dir, "benchmark").select(i.alias("pos"), F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("what of "), _s(i))).alias("query"), F.array(F.lit("nowhere"), F.concat(F.lit("src"), _s(i % 20)), F.lit("src0")).alias("gold"))
    parents = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("content"))
    return bib.gold_rows(asked, parents, ["How are ships built?", "What is a harbour?"]).withColumn("expected", F.array_join("expected", ","))


@query(r"""WITH a AS (SELECT doc_id, 'ephrin-B1 (' || lang || ') ^骨折愈合 "x" 骨 ' || source AS q FROM documents), b AS (SELECT doc_id, lang, source FROM documents)
SELECT doc_id, '"ephrin-B1" ' || lang || ' x ' || source AS terms, '骨折愈合,骨' AS runs FROM b""")
def search_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and ideograph runs of a made-up query for every document."""
    q = F.concat(F.lit("ephrin-B1 ("), "lang", F.lit(') ^骨折愈合 "x" 骨 '), "source")
    terms, runs = md.fts_terms(q)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(terms, " ").alias("terms"), F.array_join(runs, ",").alias("runs"))


@query("""SELECT 'l_quantity' AS name, count(*) AS n, min(l_quantity) AS min, median(l_quantity) AS median, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS max, count(*) FILTER (WHERE l_quantity > 0) AS nonzero FROM lineitem
UNION ALL SELECT 'l_discount', count(*), min(l_discount), median(l_discount), round(avg(l_discount), 6), max(l_discount), count(*) FILTER (WHERE l_discount > 0) FROM lineitem""")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, middle, mean and greatest quantity and discount of order lines."""
    return gr.distribution(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]).withColumn("mean", F.round("mean", 6))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of suppliers by the Louvain method."""
    return gr.louvain(supplier_citations(spark, sf_dir))


@query(f"""WITH e AS ({EDGES_SQL}) SELECT (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM e) AS edges, true AS stable, true AS moved""")
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the fingerprint of suppliers by nation is the same for the rows in another order, and another one if one nation changes."""
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community_id"))
    edges = supplier_citations(spark, sf_dir)
    size = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))
    own = gr.graph_fingerprint(nodes, edges).toDF("a")
    shuffled = gr.graph_fingerprint(nodes.orderBy(F.desc("node")), edges).toDF("b")
    other = gr.graph_fingerprint(nodes.withColumn("community_id", F.when(F.col("node") == 1, 99).otherwise(F.col("community_id"))), edges).toDF("c")
    return size.join(own).join(shuffled).join(other).select("nodes", "edges", (F.col("a") == F.col("b")).alias("stable"), (F.col("a") != F.col("c")).alias("moved"))


@query("""WITH d AS (SELECT *, source || doc_id AS s FROM documents WHERE length(text) >= 500 AND doc_id % 5 <> 0),
w AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1]) AS first FROM d)
SELECT s AS source, CAST(length(concat_ws('. ', CASE WHEN length(first) > 20 AND length(first) < 300 THEN first WHEN length(s) > 10 THEN s ELSE '' END, array_to_string(w[1:200], ' '))) AS BIGINT) AS n, regexp_extract(text, '\\b(19[0-9]{2}|20[0-9]{2})\\b', 1) AS year FROM w""")
def to_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would read of every document that isn't classified yet; every fifth one is."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat("source", _s(F.col("doc_id"))).alias("source"), "text")
    return bib.papers_to_classify(docs, docs.filter("doc_id % 5 = 0")).select("source", F.length("entry").cast("long").alias("n"), "year")


@query("""WITH h AS (SELECT source AS query_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)
SELECT query_id, CAST(rank AS BIGINT) AS rank, '[' || rank || '] ' || CASE WHEN doc_id % 2 = 0 THEN 'On ' || query_id ELSE 'Unknown' END || ' (' || CASE WHEN doc_id % 2 = 0 THEN '2001' ELSE 'N/A' END || '), relevance 0.500' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'doi 10.1/' || doc_id ELSE '' END || chr(10) || '"' || replace(coalesce(text, '')[:400], chr(10), ' ') || '..."' AS line FROM h WHERE rank <= 3""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each source as cited evidence; every second one has no record."""
    from pyspark.sql.window import Window

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    hits = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("rank <= 3").select(F.col("source").alias("query_id"), F.col("doc_id").alias("source"), "text", F.lit(0.5).alias("similarity"), "rank")
    papers = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("source"), F.concat(F.lit("On "), "source").alias("title"), F.lit("2001").alias("year"), F.lit("").alias("key"), F.concat(F.lit("10.1/"), _s(F.col("doc_id"))).alias("doi"))
    return bib.evidence_lines(hits, papers).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents), v AS (SELECT DISTINCT 'src' || (l_suppkey % 25) AS src, 'src' || (l_partkey % 25) AS dst FROM lineitem),
r AS (SELECT source AS f, NULL AS t, 'Smith' AS a, '2020' AS y, '' AS h, false AS resolved FROM s UNION ALL SELECT source, NULL, 'Lee', '2019', 'Growth of ' || source, false FROM s
UNION ALL SELECT src, dst, NULL, NULL, NULL, true FROM v WHERE src <> dst AND src IN (SELECT source FROM s) AND dst IN (SELECT source FROM s))
SELECT f AS "from", t AS "to", a AS to_author, y AS to_year, h AS to_title_hint, resolved FROM r""")
def reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference graph of a made-up paper for every source, with verified citations, some of them of papers that don't exist."""
    text = F.concat(F.lit("Bone grows (Smith et al., 2020). It does (Smith, 2020).\n# References\n[1] Lee B. (2019) Growth of "), "source")
    docs = read(spark, sf_dir, "documents").select("source").distinct().select("source", text.alias("text"))
    line = read(spark, sf_dir, "lineitem")
    verified = line.select(F.concat(F.lit("src"), _s(F.col("l_suppkey") % 25)).alias("src"), F.concat(F.lit("src"), _s(F.col("l_partkey") % 25)).alias("dst"))
    return gr.reference_graph(docs, verified)


_PARTICLES_SQL = "['" + "', '".join(x.replace("'", "''") for x in au.PARTICLES) + "']"
#: Names from parts' names: and types' first four words, in the forms that registries and citations have.
_NAMED = """n AS (SELECT p_partkey AS k, string_split(lower(p_name || ' ' || p_type || ' x y'), ' ') AS w FROM part),
c AS (SELECT k, upper(w[1][1]) || w[1][2:] AS a, upper(w[2][1]) || w[2][2:] AS b, upper(w[3][1]) || w[3][2:] AS c, w[4] AS d FROM n)"""


def _names(spark, sf_dir) -> DataFrame:
    w = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", F.lit("x y"))), " ")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *[F.initcap(w[i]).alias(x) for i, x in enumerate("abc")], w[3].alias("d"))


@query(rf"""WITH {_NAMED}, r AS (SELECT k, CASE k % 7 WHEN 0 THEN a || ',' || b || '; ' || c || ', X' WHEN 1 THEN a || ' WA; van der ' || b || ' F;  ' WHEN 2 THEN a || ', ' || d || ', De ' || b || ', T. J.' WHEN 3 THEN a || ' Q.' WHEN 4 THEN 'von  de' WHEN 5 THEN ' ; ,' ELSE 'le ' || a || ' ' || b END AS t FROM c),
s AS (SELECT k, CASE WHEN contains(t, ';') THEN list_filter(list_transform(string_split(t, ';'), lambda x: trim(x)), lambda x: x <> '') WHEN contains(t, ',') THEN list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') ELSE [trim(t)] END AS segs FROM r),
e AS (SELECT k, seg, i FROM (SELECT s.k, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i, contains(t, ';') OR NOT contains(t, ',') AS every FROM s JOIN r ON r.k = s.k) WHERE every OR i % 2 = 1),
w AS (SELECT k, i, list_filter(string_split(trim(string_split(seg, ',')[1]), ' '), lambda x: x <> '') AS w FROM e),
h AS (SELECT k, i, w, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains({_PARTICLES_SQL}, lower(trim(w[j], '.'))))), 0) AS n FROM w WHERE len(w) > 0),
f AS (SELECT k, i, CASE WHEN n = 0 THEN [w[1]] WHEN n = 1 OR regexp_matches(w[n], '^[A-Z]{{1,3}}\.?$') THEN [array_to_string(w[1:n], '')] ELSE [array_to_string(w[1:n], ''), w[n]] END AS x FROM h),
g AS (SELECT k, i, list_filter(list_transform(x, lambda y: regexp_replace(lower(y), '[^a-z0-9]', '', 'g')), lambda y: length(y) > 1) AS x FROM f),
z AS (SELECT k, flatten(list(x ORDER BY i)) AS x FROM g GROUP BY k)
SELECT r.k, coalesce(x[1], '') AS first, coalesce((SELECT string_agg(y, ' ' ORDER BY y) FROM (SELECT DISTINCT unnest(x) AS y)), '') AS surnames, coalesce(len(x) > 0, false) AS ok FROM r LEFT JOIN z ON r.k = z.k""")
def registry_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames in registry records made of every part's name, in seven forms."""
    a, b, c, d, k = (F.col(x) for x in "abcdk")
    text = F.when(k % 7 == 0, F.concat(a, F.lit(","), b, F.lit("; "), c, F.lit(", X"))).when(k % 7 == 1, F.concat(a, F.lit(" WA; van der "), b, F.lit(" F;  "))).when(k % 7 == 2, F.concat(a, F.lit(", "), d, F.lit(", De "), b, F.lit(", T. J.")))
    text = text.when(k % 7 == 3, F.concat(a, F.lit(" Q."))).when(k % 7 == 4, "von  de").when(k % 7 == 5, " ; ,").otherwise(F.concat(F.lit("le "), a, F.lit(" "), b))
    out = _names(spark, sf_dir).select("k", au.registry_authors(text).alias("r"))
    return out.select("k", "r.first", F.array_join(F.array_sort("r.surnames"), " ").alias("surnames"), "r.ok")


@query(rf"""WITH {_NAMED}, r AS (SELECT k, CASE k % 6 WHEN 0 THEN a || ' and ' || b WHEN 1 THEN 'van der ' || a || ' et al.' WHEN 2 THEN a || ' & De ' || b || ', ' || d WHEN 3 THEN a || '  et . al., 2004' WHEN 4 THEN 'X and ' || b ELSE a END AS t FROM c),
s AS (SELECT k, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '\bet\s+\.?\s*al\.?', '', 'g'), '\s+and\s+|\s*&\s+', ' § ', 'g'), ',.*$', ''), ' § '), lambda x: trim(x)), lambda x: x <> '')[1:2] AS parts FROM r),
e AS (SELECT k, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s), w AS (SELECT k, i, list_filter(string_split(part, ' '), lambda x: x <> '') AS w FROM e),
h AS (SELECT k, i, w, coalesce(list_min(list_filter(range(1, len(w)), lambda j: NOT list_contains({_PARTICLES_SQL}, lower(trim(w[j], '.'))))), len(w)) AS n FROM w),
f AS (SELECT k, i, regexp_replace(lower(array_to_string(w[1:n], '')), '[^a-z0-9]', '', 'g') AS x FROM h), z AS (SELECT k, list(x ORDER BY i) AS x FROM f WHERE length(x) > 1 GROUP BY k)
SELECT r.k, coalesce(x[1], '') AS "primary", coalesce(x[2], '') AS secondary FROM r LEFT JOIN z ON r.k = z.k""")
def target_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames in citations made of every part's name, in six forms."""
    a, b, d, k = (F.col(x) for x in "abdk")
    text = F.when(k % 6 == 0, F.concat(a, F.lit(" and "), b)).when(k % 6 == 1, F.concat(F.lit("van der "), a, F.lit(" et al."))).when(k % 6 == 2, F.concat(a, F.lit(" & De "), b, F.lit(", "), d)).when(k % 6 == 3, F.concat(a, F.lit("  et . al., 2004"))).when(k % 6 == 4, F.concat(F.lit("X and "), b)).otherwise(a)
    return _names(spark, sf_dir).select("k", au.target_authors(text).alias("t")).select("k", "t.primary", "t.secondary")


_ANSWERS = r"""a AS (SELECT doc_id AS k, CASE doc_id % 6 WHEN 0 THEN '```json' || chr(10) || '{"claim": " ' || source || ' grows ", "rationale": "r", "expected_evidence": ["x' || doc_id || '", " ", "y"], "falsifier": "' || lang || '", "scores": {"interesting": 6.5, "feasible": "12", "testable": "no"}}' || chr(10) || '```'
  WHEN 1 THEN 'Here: {"claim": "' || lang || ' {nested} ", "expected_evidence": "alone", "scores": 4, "verdict": "Supported", "reason": " so "} done' WHEN 2 THEN '{"claim": "cut off ' || source || '", "rationale": "beca' WHEN 3 THEN '{"claim": "", "verdict": "contradicted"}'
  WHEN 4 THEN '{"verdict": "maybe", "claim": "' || n_chars || '", "scores": {"interesting": -3, "feasible": 2.5, "testable": 1e3}}' ELSE '' END AS t FROM documents),
b AS (SELECT k, trim(regexp_replace(regexp_replace(t, '^```[a-zA-Z]*\s*', ''), '\s*```$', '')) AS t FROM a),
o AS (SELECT k, CASE WHEN starts_with(t, '{') AND json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '(?s)\{.*\}')) THEN regexp_extract(t, '(?s)\{.*\}') END AS j FROM b)"""


_SCORED = ", ".join(f"CASE WHEN TRY_CAST(json_extract_string(j, '$.scores.{x}') AS DOUBLE) IS NOT NULL THEN CAST(least(greatest(round_even(TRY_CAST(json_extract_string(j, '$.scores.{x}') AS DOUBLE), 0), 1), 10) AS INTEGER) END AS {x}" for x in an.SCORES)


def _answers(spark, sf_dir) -> DataFrame:
    k, s = F.col("doc_id"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    text = F.when(k % 6 == 0, s('```json\n{"claim": " ', F.col("source"), ' grows ", "rationale": "r", "expected_evidence": ["x', k, '", " ", "y"], "falsifier": "', F.col("lang"), '", "scores": {"interesting": 6.5, "feasible": "12", "testable": "no"}}\n```'))
    text = text.when(k % 6 == 1, s('Here: {"claim": "', F.col("lang"), ' {nested} ", "expected_evidence": "alone", "scores": 4, "verdict": "Supported", "reason": " so "} done')).when(k % 6 == 2, s('{"claim": "cut off ', F.col("source"), '", "rationale": "beca'))
    text = text.when(k % 6 == 3, '{"claim": "", "verdict": "contradicted"}').when(k % 6 == 4, s('{"verdict": "maybe", "claim": "', F.col("n_chars"), '", "scores": {"interesting": -3, "feasible": 2.5, "testable": 1e3}}')).otherwise("")
    return read(spark, sf_dir, "documents").select(k.alias("k"), text.alias("t"))


@query(f"""WITH {_ANSWERS}, x AS (SELECT k, trim(coalesce(json_extract_string(j, '$.claim'), '')) AS claim, json_extract(j, '$.expected_evidence') AS ev, j FROM o)
SELECT k, claim, trim(coalesce(json_extract_string(j, '$.falsifier'), '')) AS falsifier, array_to_string(list_filter(list_transform(CASE WHEN json_type(ev) = 'ARRAY' THEN CAST(ev AS VARCHAR[]) WHEN ev IS NULL THEN [] ELSE [json_extract_string(j, '$.expected_evidence')] END, lambda e: trim(e)), lambda e: e <> ''), '|') AS evidence,
{_SCORED} FROM x WHERE claim <> ''""")
def model_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses in made-up answers, one for every document: fenced, amid prose, cut off, without a claim, with scores out of range, empty."""
    out = _answers(spark, sf_dir).select("k", an.hypothesis(F.col("t")).alias("h")).filter("h is not null")
    return out.select("k", "h.claim", "h.falsifier", F.coalesce(F.array_join("h.expected_evidence", "|"), F.lit("")).alias("evidence"), "h.interesting", "h.feasible", "h.testable")


@query(f"""WITH {_ANSWERS}, v AS (SELECT k, lower(trim(coalesce(json_extract_string(j, '$.verdict'), ''))) AS verdict, trim(coalesce(json_extract_string(j, '$.reason'), '')) AS reason FROM o)
SELECT * FROM v WHERE verdict IN ('supported', 'contradicted', 'inconclusive')""")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in the same answers."""
    return _answers(spark, sf_dir).select("k", an.verdict(F.col("t")).alias("v")).filter("v is not null").select("k", "v.verdict", "v.reason")


# a DOI of every supplier, with the rest of a link behind some; of the registry's answers some failed, some know nothing, and half of the DOIs are in capitals
_DOIS = f"""p AS (SELECT 's' || s_suppkey AS source, '10.1000/s' || s_suppkey AS doi, s_name, s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 9 <> 0), c AS ({EDGES_SQL}),
r AS (SELECT '10.1000/s' || src AS doi, src, '10.1000/s' || dst AS ref FROM c WHERE src % 7 NOT IN (0, 1) AND src % 5 <> 0),
s AS (SELECT DISTINCT '10.1000/s' || src AS doi, src % 7 = 0 AS failed FROM c WHERE src % 5 <> 0),
d AS (SELECT DISTINCT x.source AS src, y.source AS dst FROM r JOIN p x ON x.doi = r.doi JOIN p y ON y.doi = r.ref WHERE x.source <> y.source)"""


def _doi_papers(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    doi = F.concat(F.lit("10.1000/S"), _s(key), F.when(key % 4 == 0, F.concat(F.lit("](https://doi.org/10.1000/s"), _s(key), F.lit(")"))).otherwise(""))
    rows = read(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", F.concat(F.lit("s"), _s(key)).alias("source"), F.when(key % 9 != 0, doi).otherwise("none").alias("doi"), F.concat("s_name", F.lit(" "), F.repeat("s_name", 6)).alias("title"), (1990 + F.col("s_nationkey")).alias("year"), F.lit(None).cast("string").alias("journal"))


def _doi_snapshot(spark, sf_dir) -> DataFrame:
    """What a first run got, and a second one's answers for what had failed."""
    name = lambda c, p="10.1000/s": F.concat(F.lit(p), _s(F.col(c)))
    edges = supplier_citations(spark, sf_dir).filter("src % 5 <> 0")
    refs = edges.groupBy("src").agg(F.collect_set(name("dst", "10.1000/S")).alias("refs"))
    status = F.when(F.col("src") % 7 == 0, "timeout").when(F.col("src") % 7 == 1, "404").otherwise("ok")
    late = F.col("src") % 7 == 2
    empty = spark.createDataFrame([], "doi string, refs array<string>")
    first = bib.with_answers(empty, refs.select(name("src").alias("doi"), F.when(late, "timeout").otherwise(status).alias("status"), "refs"))
    return bib.with_answers(first, refs.filter(late | (F.col("src") % 7 == 0)).select(name("src", "10.1000/S").alias("doi"), status.alias("status"), "refs"))


@query(f"WITH {_DOIS} SELECT src, dst FROM d")
def doi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations between suppliers by registered references."""
    return bib.doi_edges(_doi_papers(spark, sf_dir), _doi_snapshot(spark, sf_dir))


@query(f"WITH {_DOIS} SELECT p.doi AS doi, CASE WHEN s.doi IS NULL THEN 'new' ELSE 'again' END AS why FROM p LEFT JOIN s ON s.doi = p.doi WHERE s.doi IS NULL OR failed")
def dois_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs of suppliers that a registry must still be asked for."""
    return bib.dois_to_ask(_doi_papers(spark, sf_dir), _doi_snapshot(spark, sf_dir))


@query(f"""WITH {_DOIS}, m AS ({SQL["registry_edges"]}), e AS (SELECT src, dst FROM d UNION SELECT src, dst FROM m)
SELECT n.source AS source, coalesce(p.doi, '') AS doi, n.title AS title, n.year AS year, '' AS journal, (SELECT count(*) FROM e WHERE dst = n.source) AS in_corpus_cited_by, (SELECT count(*) FROM e WHERE src = n.source) AS in_corpus_cites
FROM (SELECT 's' || s_suppkey AS source, left(s_name || ' ' || repeat(s_name, 6), 90) AS title, CAST(1990 + s_nationkey AS VARCHAR) AS year FROM supplier) n LEFT JOIN p ON p.source = n.source""")
def citation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their degrees in the union of both registries' citations."""
    papers = _doi_papers(spark, sf_dir)
    return bib.citation_graph(papers.drop("s_suppkey"), bib.doi_edges(papers, _doi_snapshot(spark, sf_dir)), registry_edges(spark, sf_dir))[0]
