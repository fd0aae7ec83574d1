"""Queries over text: cleaning, identifiers, tokens, chunking, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import identifiers as ids
from corpusloom.functions import text as tx
from corpusloom.functions import titles as tt
from corpusloom.operators import chunking
from corpusloom.sources import bibtex, html
from corpusloom.sources.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


@query(r"""
WITH a AS (SELECT doc_id, string_split('==> Image ' || doc_id || ' omitted' || chr(10) || coalesce(text, '') || chr(10) || '  © ' || doc_id || ' all rights reserved' || chr(10) || '© ' || lang, chr(10)) AS s FROM documents),
b AS (SELECT doc_id, list_filter(s, lambda x: NOT (contains(lower(x), '==> image') OR contains(lower(x), '==> picture') OR (starts_with(trim(x, ' '), '©') AND contains(x, 'rights reserved')) OR contains(x, 'As a library, NLM provides access'))) AS k FROM a)
SELECT doc_id, md5(array_to_string(k, chr(10))) AS digest, CAST(len(k) AS BIGINT) AS n_lines FROM b
""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image markers and rights lines, added to every document, go; its own lines stay."""
    docs = _text(read(spark, sf_dir, "documents"))
    i = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("==> Image "), i, F.lit(" omitted\n"), "text", F.lit("\n  © "), i, F.lit(" all rights reserved\n© "), "lang")
    out = docs.withColumn("clean", tx.clean_lines(raw))
    return out.select("doc_id", F.md5("clean").alias("digest"), F.size(F.split("clean", "\n", -1)).cast("long").alias("n_lines"))


@query(r"""
WITH a AS (SELECT doc_id, coalesce(text, '') || chr(10) || '# References' || chr(10) || 'Smith 2020' AS t FROM documents),
b AS (SELECT doc_id, string_split(t, chr(10)) AS s FROM a),
c AS (SELECT doc_id, s, list_position(list_transform(s, lambda x: regexp_matches(x, '(?i)^#*\s*\*{0,2}\s*(REFERENCES?|BIBLIOGRAPHY|LITERATURE CITED)\s*\*{0,2}\s*$')), true) AS p FROM b)
SELECT doc_id, md5(array_to_string(s[1:p - 1], chr(10))) AS digest, CAST(p - 1 AS BIGINT) AS kept FROM c
""")
def truncate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference list added to every document is cut off at its header."""
    docs = _text(read(spark, sf_dir, "documents"))
    out = docs.withColumn("cut", tx.before_references(F.concat("text", F.lit("\n# References\nSmith 2020"))))
    return out.select("doc_id", F.md5("cut").alias("digest"), F.size(F.split("cut", "\n", -1)).cast("long").alias("kept"))


_APART = [("a", "a\u0301\u0323"), ("o", "o\u0308"), ("é", "e\u0301"), ("fi", "\ufb01"), (" ", "\u3000"), ("1", "\u2460"), ("ko", "\u1112\u1161\u11ab")]
_DECORATED = "coalesce(text, '')"
for _plain, _other in _APART:
    _DECORATED = f"replace({_DECORATED}, '{_plain}', '{_other if _other not in '\ufb01\u3000\u2460' else _plain}')"


@query(f"""
SELECT doc_id, md5(nfc_normalize({_DECORATED})) AS composed, CAST(length(nfc_normalize({_DECORATED})) AS BIGINT) AS n_chars, md5(regexp_replace(lower(strip_accents({_DECORATED})), '[^a-z0-9]+', '', 'g')) AS folded
FROM documents""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose letters got separate accents in the wrong order, ligatures, wide spaces, numbers in circles and parts of syllables: composed and folded."""
    text = F.col("text")
    for plain, other in _APART:
        text = F.replace(text, F.lit(plain), F.lit(other))
    docs = _text(read(spark, sf_dir, "documents")).select("doc_id", "text").repartition("doc_id")  # a large file can be one row group
    composed = docs.select("doc_id", tx.nfkc(text).alias("c"), F.md5(tx.squash(text)).alias("folded"))
    return composed.select("doc_id", F.md5("c").alias("composed"), F.length("c").cast("long").alias("n_chars"), "folded")


_RAW = [
    "concat('see https://doi.org/10.', cast(1000 + doc_id % 9000 as string), '/J.ABC.', cast(doc_id as string), 'v2).')",
    "concat('arXiv:', cast(1000 + doc_id % 9000 as string), '.', cast(10000 + doc_id % 80000 as string), 'v3')",
    "concat('PMCID: PMC', cast(1000000 + doc_id as string))",
    "concat('PMID: ', cast(2000000 + doc_id as string))",
    "concat('none in ', source)",
]
_RAW_CASE = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_RAW)) + " END"


@query(rf"""
WITH a AS (SELECT doc_id, {_RAW_CASE.replace(' as string)', ' AS VARCHAR)')} AS raw FROM documents),
b AS (SELECT *, nullif(regexp_replace(regexp_replace(lower(regexp_extract(raw, '(?i)(10\.[0-9]{{4,9}}/\S+)', 1)), '[)\]>,.;:!?"\s]+$', ''), '([0-9])\.?v[0-9]+$', '\1'), '') AS doi,
  nullif(regexp_extract(raw, '([0-9]{{4}}\.[0-9]{{4,5}})', 1), '') AS arxiv, nullif('PMC' || regexp_extract(raw, '(?i)\bPMC\s?([0-9]{{5,9}})\b', 1), 'PMC') AS pmcid,
  nullif(regexp_extract(trim(raw), '(?i)^\s*(?:pmid[:\s]*)?([0-9]{{1,9}})\s*$', 1), '') AS pmid FROM a)
SELECT doc_id, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN arxiv IS NOT NULL THEN 'arxiv' WHEN pmcid IS NOT NULL THEN 'pmcid' WHEN pmid IS NOT NULL THEN 'pmid' ELSE 'unknown' END AS kind,
  coalesce(doi, arxiv, pmcid, pmid) AS id FROM b
""")
def identifier_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifier in a synthetic note of every document, by precedence of kinds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW_CASE).alias("raw"))
    return docs.select("doc_id", ids.detect_identifier(F.col("raw")).alias("d")).select("doc_id", "d.kind", "d.id")


@query(r"""
WITH a AS (SELECT doc_id, '10.1016/j.x.' || doc_id AS x, CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/10.1016/J.X.' || doc_id || 'v2' WHEN 1 THEN '10.1016/j.x' WHEN 2 THEN '10.1016/j.x.9' || doc_id ELSE 'none' END AS y FROM documents),
b AS (SELECT doc_id, x, nullif(regexp_replace(lower(regexp_extract(y, '(?i)(10\.[0-9]{4,9}/\S+)', 1)), '([0-9])\.?v[0-9]+$', '\1'), '') AS y FROM a)
SELECT doc_id, CASE WHEN y IS NULL THEN NULL ELSE x = y OR (starts_with(CASE WHEN length(x) <= length(y) THEN y ELSE x END, CASE WHEN length(x) <= length(y) THEN x ELSE y END) AND least(length(x), length(y)) >= 8) END AS agree FROM b
""")
def doi_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued comparison of two DOIs for every document."""
    i = F.col("doc_id").cast("string")
    a = F.concat(F.lit("10.1016/j.x."), i)
    b = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://doi.org/10.1016/J.X."), i, F.lit("v2"))).when(F.col("doc_id") % 4 == 1, "10.1016/j.x").when(F.col("doc_id") % 4 == 2, F.concat(F.lit("10.1016/j.x.9"), i)).otherwise("none")
    return read(spark, sf_dir, "documents").select("doc_id", ids.doi_agree(a, b).alias("agree"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOPWORDS)


@query(rf"""
WITH a AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
b AS (SELECT doc_id, list_filter(regexp_extract_all(lower(t), '[a-z][a-z\-]*[0-9]*[a-z0-9]|[0-9]+'), lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x)) AS k FROM a)
SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, CAST(len(list_distinct(k)) AS BIGINT) AS n_distinct, md5(array_to_string(list_sort(list_distinct(k)), ' ')) AS digest FROM b
""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim tokens of every document."""
    docs = _text(read(spark, sf_dir, "documents")).select("doc_id", tx.claim_tokens(F.col("text")).alias("k"))
    return docs.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"), F.md5(F.array_join(F.array_sort(F.array_distinct("k")), " ")).alias("digest"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_extract_all('细胞' || doc_id || '骨 BMP4 软骨发育' || lang || '胚', '[㐀-䶿一-鿿]+') AS r FROM documents),
b AS (SELECT doc_id, flatten(list_transform(r, lambda x: CASE WHEN length(x) = 1 THEN [x] ELSE list_transform(range(1, length(x)), lambda i: substring(x, CAST(i AS BIGINT), 2)) END)) AS g FROM a)
SELECT doc_id, array_to_string(g, ' ') AS bigrams, CAST(len(g) AS BIGINT) AS n FROM b
""")
def cjk_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams of Chinese runs in a synthetic note of every document."""
    raw = F.concat(F.lit("细胞"), F.col("doc_id").cast("string"), F.lit("骨 BMP4 软骨发育"), F.col("lang"), F.lit("胚"))
    docs = read(spark, sf_dir, "documents").select("doc_id", tx.cjk_bigrams(raw).alias("g"))
    return docs.select("doc_id", F.array_join("g", " ").alias("bigrams"), F.size("g").cast("long").alias("n"))


_HTML_SQL = r"""
a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?is)<nav\b.*?</nav\s*>', ' ', 'g'), '(?is)<aside\b.*?</aside\s*>', ' ', 'g'), '(?is)<footer\b.*?</footer\s*>', ' ', 'g'), '(?is)<form\b.*?</form\s*>', ' ', 'g') AS v FROM a),
c AS (SELECT page_id, regexp_extract_all(v, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1) AS hs, string_split_regex(v, '(?i)<p(?:\s[^>]*)?>')[2:] AS ps FROM b),
d AS (SELECT page_id, list_transform(hs, lambda x: plain(x)) AS hs, list_filter(list_transform(ps, lambda p: plain(regexp_replace(p, '(?is)</p>.*$', ''))), lambda x: x <> '') AS ps FROM c)
"""


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_HTML_SQL = _HTML_SQL.replace("plain(x)", _plain("x")).replace("plain(regexp_replace(p, '(?is)</p>.*$', ''))", _plain("regexp_replace(p, '(?is)</p>.*$', '')"))


@query(f"WITH {_HTML_SQL} SELECT page_id, CASE WHEN len(hs) > 0 THEN hs[1] END AS title, CAST(len(ps) AS BIGINT) AS n_paragraphs, md5(array_to_string(list_concat(list_transform(hs, lambda h: '# ' || h), ps), chr(10) || chr(10))) AS digest FROM d")
def sections_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown sections: title, paragraphs, digest of the Markdown."""
    pages = read(spark, sf_dir, "pages").select("page_id", html.headings(html.visible(F.col("html"))).alias("hs"), html.paragraphs(F.col("html")).alias("ps"))
    md = F.array_join(F.concat(F.transform("hs", lambda h: F.concat(F.lit("# "), h)), "ps"), "\n\n")
    return pages.select("page_id", F.get("hs", F.lit(0)).alias("title"), F.size("ps").cast("long").alias("n_paragraphs"), F.md5(md).alias("digest"))


_PAPER = "'Intro line' || chr(10) || '# Abstract' || chr(10) || lang || ' study ' || doc_id || chr(10) || 'METHODS' || chr(10) || coalesce(text, '') || chr(10) || '## Results' || chr(10) || 'first ' || doc_id || chr(10) || 'RESULTS' || chr(10) || 'second ' || source || chr(10) || chr(10) || 'Figure 3: shows ' || source || chr(10) || chr(10) || 'Table S2. lists ' || lang"


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Intro line\n# Abstract\n"), "lang", F.lit(" study "), i, F.lit("\nMETHODS\n"), "text", F.lit("\n## Results\nfirst "), i, F.lit("\nRESULTS\nsecond "), "source", F.lit("\n\nFigure 3: shows "), "source", F.lit("\n\nTable S2. lists "), "lang")
    return _text(read(spark, sf_dir, "documents")).select("doc_id", text.alias("text"))


@query(rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents)
SELECT doc_id, section, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS digest FROM (
  SELECT doc_id, 'abstract' AS section, lang || ' study ' || doc_id AS content FROM a
  UNION ALL SELECT doc_id, 'methods', trim(t, ' ') FROM a
  UNION ALL SELECT doc_id, 'results', 'second ' || source || chr(10) || chr(10) || 'Figure 3: shows ' || source || chr(10) || chr(10) || 'Table S2. lists ' || lang FROM a)
""")
def extract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a synthetic paper around every document; a repeated header replaces its earlier section."""
    found = chunking.sections(_papers(spark, sf_dir), "doc_id")
    return found.select("doc_id", "section", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


@query("""SELECT doc_id, section, label, content FROM (
  SELECT doc_id, 'figure_caption' AS section, '3' AS label, 'Figure 3: shows ' || source AS content FROM documents
  UNION ALL SELECT doc_id, 'table_caption', 'S2', 'Table S2. lists ' || lang FROM documents WHERE false)""")
def extract_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption paragraphs of the synthetic papers; a table without a number right after its name is none."""
    return chunking.captions(_papers(spark, sf_dir), "doc_id").select("doc_id", "section", "label", "content")


@query(r"""
WITH a AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents))
SELECT doc_id, CAST(pos AS INTEGER) AS idx, md5(line) AS digest, CAST(length(line) AS BIGINT) AS n_chars FROM a
""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines as numbered chunks."""
    docs = _text(read(spark, sf_dir, "documents"))
    each = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")).alias("idx", "line"))
    return each.select("doc_id", "idx", F.md5("line").alias("digest"), F.length("line").cast("long").alias("n_chars"))


@query()
def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping children of every document; lines act as paragraphs."""
    docs = _text(read(spark, sf_dir, "documents"))
    out = chunking.children(docs, "doc_id", "text", "\n")
    return out.select("doc_id", "idx", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, source || '#full_text#' || substring(md5(source || ':full_text:' || substring(coalesce(text, ''), 1, 200)), 1, 16) AS parent_id FROM documents")
def parent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _text(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", chunking.parent_id(F.col("source"), F.lit("full_text"), F.col("text")).alias("parent_id"))


@query("""
WITH d AS (SELECT doc_id, substring(md5(text), 1, 16) AS hash FROM documents WHERE length(text) >= 500),
g AS (SELECT doc_id, CASE WHEN quality = 1 THEN substring(md5(text), 1, 16) ELSE 'stale' END AS hash FROM documents JOIN labels USING (doc_id))
SELECT doc_id, hash FROM d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.hash = d.hash)
""")
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to ingest: labelled ones count as logged, those of low quality with an old hash."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    log = docs.join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, chunking.content_hash(F.col("text"))).otherwise("stale").alias("hash"))
    return chunking.changed(docs, log, "doc_id").select("doc_id", "hash")


@query(r"""
WITH a AS (SELECT c_custkey, c_name AS t, CASE c_custkey % 4 WHEN 0 THEN 'Customer#' WHEN 1 THEN c_name || ' of ' || c_mktsegment WHEN 2 THEN '2020 - ' || c_name ELSE 'Editorial' END AS u FROM customer),
b AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(t), '[a-z0-9]+'), lambda x: length(x) > 2)) AS k, list_distinct(list_filter(regexp_extract_all(lower(u), '[a-z0-9]+'), lambda x: length(x) > 2)) AS l FROM a),
c AS (SELECT *, len(list_intersect(k, l)) AS i, len(list_distinct(list_concat(k, l))) AS n FROM b)
SELECT c_custkey, CASE WHEN n = 0 THEN 1.0 ELSE i / n END AS jaccard, CASE WHEN least(len(k), len(l)) = 0 THEN 0.0 ELSE i / greatest(len(k), len(l)) END AS overlap,
  0.5 * CASE WHEN n = 0 THEN 1.0 ELSE i / n END + 0.5 * CASE WHEN least(len(k), len(l)) = 0 THEN 0.0 ELSE i / least(len(k), len(l)) END AS blended FROM c
""")
def title_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three similarities of a name and a variant of it."""
    m = F.col("c_custkey") % 4
    u = F.when(m == 0, "Customer#").when(m == 1, F.concat("c_name", F.lit(" of "), "c_mktsegment")).when(m == 2, F.concat(F.lit("2020 - "), "c_name")).otherwise("Editorial")
    rows = read(spark, sf_dir, "customer").select("c_custkey", tt.title_tokens(F.col("c_name")).alias("k"), tt.title_tokens(u).alias("l"))
    return rows.select("c_custkey", tt.jaccard(F.col("k"), F.col("l")).alias("jaccard"), tt.overlap(F.col("k"), F.col("l")).alias("overlap"), tt.blended_similarity(F.col("k"), F.col("l")).alias("blended"))


@query(r"""
WITH a AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Smith' || s_suppkey || '_et_al__-_2019_On bone' WHEN 1 THEN 'Lee_2020_Growth plate ' || s_suppkey ELSE 'notes ' || s_suppkey END AS f FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'smith' || s_suppkey WHEN 1 THEN 'lee' END AS lastname, CASE s_suppkey % 3 WHEN 0 THEN '2019' WHEN 1 THEN '2020' END AS year,
  CASE s_suppkey % 3 WHEN 0 THEN 'onbone' WHEN 1 THEN 'growthplate' || s_suppkey END AS title FROM a
""")
def filename_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, year and title that a file name carries."""
    i, m = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    f = F.when(m == 0, F.concat(F.lit("Smith"), i, F.lit("_et_al__-_2019_On bone"))).when(m == 1, F.concat(F.lit("Lee_2020_Growth plate "), i)).otherwise(F.concat(F.lit("notes "), i))
    return read(spark, sf_dir, "supplier").select("s_suppkey", f.alias("f")).select("s_suppkey", tt.filename_key(F.col("f")).alias("k")).select("s_suppkey", "k.lastname", "k.year", "k.title")


@query()
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a synthetic BibTeX file for every supplier, with nested braces and a date for a year."""
    i = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("@article{key"), i, F.lit(",\n\ttitle = {On {Bone} "), "s_name", F.lit("},\n\tauthor = {Smith, Ann and Lee, Bo},\n\tdate = {2021-03-01},\n\tdoi = {10.1000/"), i, F.lit("}\n}\n@misc{b"), i, F.lit(", year = 2019, title = \"Notes\"}"))
    return bibtex.parse(read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))).select("s_suppkey", "kind", "key", "title", "author", "year", "doi")


@query("""
WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_linenumber AS INTEGER)))) AS p FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, p, list_filter(p, lambda x: NOT list_contains(p, x - 1)) AS s, list_filter(p, lambda x: NOT list_contains(p, x + 1)) AS e FROM a)
SELECT l_orderkey, array_to_string(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i] = e[i] THEN CAST(s[i] AS VARCHAR) ELSE s[i] || '-' || e[i] END), ',') AS spec, CAST(len(p) AS BIGINT) AS n FROM r
""")
def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of every order as a page spec, expanded again to count them."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("p"))
    rows = rows.select("l_orderkey", tx.format_pages(F.col("p")).alias("spec"))
    return rows.select("l_orderkey", "spec", F.size(tx.expand_pages(F.col("spec"))).cast("long").alias("n"))


@query(r"""WITH a AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '3-' || (o_custkey % 40 + 1) || ', 2' WHEN 1 THEN '1-2147483640' WHEN 2 THEN '0' WHEN 3 THEN '5,' || o_custkey || '-' || (o_custkey + 3) WHEN 4 THEN '1-30,40-60' WHEN 5 THEN 'x' WHEN 6 THEN '0-3' WHEN 7 THEN '7' WHEN 8 THEN ' 4 - 9 , 8' END AS spec, o_custkey AS c FROM orders)
SELECT o_orderkey, spec, CASE o_orderkey % 9 WHEN 0 THEN CASE WHEN c % 40 + 1 >= 3 THEN (SELECT list(v ORDER BY v) FROM (SELECT DISTINCT unnest(list_append(range(3, c % 40 + 2), 2)) AS v)) END WHEN 3 THEN CASE WHEN c > 0 THEN (SELECT list(v ORDER BY v) FROM (SELECT DISTINCT unnest(list_append(range(c, c + 4), 5)) AS v)) END WHEN 7 THEN [7] WHEN 8 THEN range(4, 10) END AS pages,
  CASE o_orderkey % 9 WHEN 0 THEN CASE WHEN c % 40 + 1 < 3 THEN 'invalid' END WHEN 1 THEN 'too_many' WHEN 2 THEN 'nonpositive' WHEN 3 THEN CASE WHEN c = 0 THEN 'nonpositive' END WHEN 4 THEN 'too_many' WHEN 5 THEN 'invalid' WHEN 6 THEN 'nonpositive' END AS error FROM a""")
def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up page specs of every order, sound and faulty."""
    m, c = F.col("o_orderkey") % 9, F.col("o_custkey")
    text = lambda x: x.cast("string")
    spec = F.when(m == 0, F.concat(F.lit("3-"), text(c % 40 + 1), F.lit(", 2"))).when(m == 1, "1-2147483640").when(m == 2, "0").when(m == 3, F.concat(F.lit("5,"), text(c), F.lit("-"), text(c + 3))).when(m == 4, "1-30,40-60").when(m == 5, "x").when(m == 6, "0-3").when(m == 7, "7").otherwise(" 4 - 9 , 8")
    return read(spark, sf_dir, "orders").select("o_orderkey", spec.alias("spec"), tx.read_pages(spec).alias("r")).select("o_orderkey", "spec", "r.pages", "r.error")


@query("SELECT s_suppkey, 'A glass of gl.ss: ' || replace(s_name, 'Supplier', 'firm $1') AS text FROM supplier")
def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal terms of a glossary replaced in any case, in order; signs in them mean nothing."""
    text = F.concat(F.lit("A GLASS of gL.sS: "), "s_name")
    return read(spark, sf_dir, "supplier").select("s_suppkey", tx.replace_terms(text, [("glass", "glass"), ("gl.ss", "gl.ss"), ("SUPPLIER", "firm $1")]).alias("text"))


@query("""SELECT s_suppkey AS src, s_name AS src_title, s_nationkey AS src_year, n_nationkey + 1000000 AS dst, NULL AS dst_title, NULL AS dst_year FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT s_suppkey, s_name, s_nationkey, 1, (SELECT s_name FROM supplier WHERE s_suppkey = 1), (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1) FROM supplier""")
def edge_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from every supplier to the first and to one that is no paper, with titles and years."""
    from corpusloom.sources import sinks

    s = read(spark, sf_dir, "supplier")
    papers = s.select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("year"))
    edges = s.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + 1000000).cast("long").alias("dst")).unionByName(s.select(F.col("s_suppkey").alias("src"), F.lit(1).cast("long").alias("dst")))
    return sinks.edge_mirror(edges, papers)


@query(r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, 'Figure 3: shows ' || source AS cap FROM documents),
p AS (SELECT doc_id, 'methods' AS section, 'section' AS chunk_type, NULL AS label, trim(t, ' ') AS content, doc_id || ':methods:' || trim(t, ' ')[:200] AS id FROM a WHERE doc_id % 5 <> 0 AND length(trim(t, ' ')) >= 200
  UNION ALL SELECT doc_id, 'figure_caption', 'figure_caption', '3', cap, doc_id || ':figure_caption:3:' || cap[:200] FROM a WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 'full_text', 'section', NULL, t, doc_id || ':full' FROM a WHERE doc_id % 5 = 0 AND trim(t, ' ') <> '')
SELECT doc_id, section, chunk_type, label, doc_id || '#' || CASE WHEN section = 'full_text' THEN 'full' ELSE section END || '#' || md5(id)[:16] AS parent_id, CAST(length(content) AS BIGINT) AS char_count, CAST(len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS BIGINT) AS word_count FROM p""")
def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of the synthetic papers; every fifth document has no sections and is one parent."""
    raw = _text(read(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("_raw"))
    papers = _papers(spark, sf_dir).join(raw, "doc_id").select(F.col("doc_id").cast("string").alias("source"), F.when(F.col("doc_id") % 5 == 0, F.col("_raw")).otherwise(F.col("text")).alias("text"))
    return chunking.parents(papers).select(F.col("source").cast("long").alias("doc_id"), "section", "chunk_type", "label", "parent_id", "char_count", "word_count")
