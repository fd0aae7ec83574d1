"""Queries over guards, ledgers and verification: conversations stand for sessions, made-up tool messages and evidence are built from their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.operators import directions, evaluate, guard, quality
from corpusloom.plans.quality_queries import _claim_sql
from corpusloom.sources.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_FOLD = r"regexp_replace({}, '[^\p{{L}}\p{{N}}_\-]', '_', 'g')"
#: A session is ten documents; each is a parent of its own file, and a line names it in one of six ways or invents something.
_PARENTS = """known AS (SELECT doc_id // 10 AS session, doc_id, 'paper_' || doc_id || '_of_' || lang || '.md' AS src, 'paper_' || doc_id || '_of_' || lang || '.md#intro#' || md5(doc_id::VARCHAR)[1:6] AS parent_id, 'Growth of ' || lang || ' tissue under number' || doc_id || ' strain conditions' AS title FROM documents),
lines AS (SELECT session, doc_id AS pos, CASE doc_id % 7 WHEN 0 THEN 'see ' || parent_id || ' there' WHEN 1 THEN 'cited: ' || src || ', p. 3' WHEN 2 THEN upper(src[1:-4]) || '.PDF' WHEN 3 THEN 'as in ' || upper(src[1:-4]) || ' and others'
  WHEN 4 THEN 'Parent ID: ' || parent_id WHEN 5 THEN upper(title[1:-12]) ELSE 'invented ' || doc_id END AS line FROM known)"""


def _parents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id").cast("string")
    src = F.concat(F.lit("paper_"), i, F.lit("_of_"), "lang", F.lit(".md"))
    pid = F.concat(src, F.lit("#intro#"), F.substring(F.md5(i), 1, 6))
    title = F.concat(F.lit("Growth of "), "lang", F.lit(" tissue under number"), i, F.lit(" strain conditions"))
    stem = F.upper(F.regexp_replace(src, r"\.md$", ""))
    m = F.col("doc_id") % 7
    line = F.when(m == 0, F.concat(F.lit("see "), pid, F.lit(" there"))).when(m == 1, F.concat(F.lit("cited: "), src, F.lit(", p. 3"))).when(m == 2, F.concat(stem, F.lit(".PDF"))).when(m == 3, F.concat(F.lit("as in "), stem, F.lit(" and others")))
    line = line.when(m == 4, F.concat(F.lit("Parent ID: "), pid)).when(m == 5, F.upper(F.regexp_replace(title, ".{11}$", ""))).otherwise(F.concat(F.lit("invented "), i))
    rows = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("session"), "doc_id", pid.alias("parent_id"), title.alias("title"), line.alias("line"))
    return rows.select("session", "parent_id", "title"), rows.select("session", F.col("doc_id").alias("pos"), "line")


@query(f"""WITH {_PARENTS}, k AS (SELECT *, {_claim_sql("title")} AS tk, lower(src[1:-4]) AS stem, contains(parent_id, '#') AS marked FROM known),
l AS (SELECT *, regexp_extract_all(line, '(?i)[\\w\\-.]+\\.(?:md|pdf|txt|docx|doc)\\b') AS files, {_claim_sql("line")} AS lk FROM lines),
b AS (SELECT l.session AS session, l.pos AS pos, line, parent_id, CASE WHEN contains(line, parent_id) THEN 'id' WHEN list_contains(files, src) OR list_contains(list_transform(files, lambda f: lower(regexp_replace(f, '\\.[^.]*$', ''))), stem) THEN 'file'
  WHEN length(stem) >= 8 AND contains(lower(line), stem) THEN 'stem' WHEN regexp_extract(line, 'Parent ID:\\s*(\\S.+?)\\s*$', 1) = parent_id THEN 'hint' WHEN len(list_intersect(lk, tk)) / len(list_distinct(list_concat(lk, tk))) >= 0.6 THEN 'title' END AS how,
  len(list_intersect(lk, tk)) / len(list_distinct(list_concat(lk, tk))) AS j FROM l JOIN k USING (session)),
r AS (SELECT *, row_number() OVER (PARTITION BY session, pos ORDER BY list_position(['id', 'file', 'stem', 'hint', 'title'], how), CASE WHEN how = 'title' THEN -j ELSE 0 END, parent_id) AS n FROM b WHERE how IS NOT NULL)
SELECT lines.session AS session, lines.pos AS pos, lines.line AS line, parent_id, how FROM lines LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON r.session = lines.session AND r.pos = lines.pos""")
def source_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source line for every document, resolved against the parents of its session."""
    known, lines = _parents(spark, sf_dir)
    return guard.resolve_lines(lines, known).select("session", "pos", "line", "parent_id", "how")


@query(f"""WITH {_PARENTS}, s AS (SELECT session, string_agg('- ' || CASE WHEN pos % 7 IN (0, 6) THEN line ELSE 'nothing ' || pos END, chr(10) ORDER BY pos) AS l, count(*) AS n, count(*) FILTER (WHERE pos % 7 = 0) AS good FROM lines GROUP BY session),
k AS (SELECT session, string_agg('- ' || line || CASE WHEN pos % 2 = 1 THEN '  ⚠️[unverified: parent store miss]' WHEN pos % 4 = 2 THEN '  ⚠️[low lexical support: 0.00]' ELSE '' END, chr(10) ORDER BY pos) AS l, count(*) FILTER (WHERE pos % 4 <> 0) AS annotated FROM lines WHERE pos % 7 = 0 GROUP BY session)
SELECT s.session AS session, 'Osteoblasts mineralize trabecular scaffolds during prolonged mechanical loading experiments.' || CASE WHEN good > 0 THEN chr(10) || chr(10) || chr(10) || '## Sources:' || chr(10) || k.l ELSE '' END
  || chr(10) || chr(10) || '<!-- citation_guard: ' || (n - good) || ' source line(s) could not be matched to any retrieved parent chunk and were removed -->' AS answer, good AS kept, n - good AS dropped, coalesce(annotated, 0) AS annotated FROM s LEFT JOIN k USING (session) WHERE n > good
UNION ALL SELECT s.session, 'Osteoblasts mineralize trabecular scaffolds during prolonged mechanical loading experiments.' || chr(10) || chr(10) || chr(10) || '## Sources:' || chr(10) || k.l, good, 0, annotated FROM s JOIN k USING (session) WHERE n = good""")
def citation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every session with good and invented source lines; of the parents every second isn't in the store, every fourth is about something else."""
    known, lines = _parents(spark, sf_dir)
    body = "Osteoblasts mineralize trabecular scaffolds during prolonged mechanical loading experiments."
    line = F.when((F.col("pos") % 7).isin(0, 6), F.col("line")).otherwise(F.concat(F.lit("nothing "), F.col("pos").cast("string")))
    answers = lines.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))).alias("l"))
    answers = answers.select("session", F.concat(F.lit(body + "\n\n## Sources:\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["l"])), "\n")).alias("text"))
    number = F.regexp_extract("parent_id", "^paper_([0-9]+)_", 1).cast("long")
    parents = known.filter(number % 2 == 0).select("parent_id", F.when(number % 4 == 0, body).otherwise("Quite another matter altogether, namely ships and harbours").alias("content"))
    return guard.enforce_citations(answers, known, parents)


_CLAIMS = """c AS (SELECT conv_id AS session, turn AS pos, CASE turn % 6 WHEN 5 THEN 'bad id' ELSE 'C' || (turn % 4) END AS claim_id, coalesce(text, '') AS text, CASE turn % 3 WHEN 0 THEN 'Strong' WHEN 1 THEN NULL ELSE 'sure' END AS confidence FROM conversations WHERE role = 'assistant'),
e AS (SELECT session, pos, 0 AS n, 'chunk' AS kind, 'p' || (length(text) % 7) AS ref FROM c WHERE pos % 5 <> 4
  UNION ALL SELECT session, pos, 1, 'citation', CASE session % 3 WHEN 0 THEN '1234567' WHEN 1 THEN 'abc' ELSE CASE WHEN session % 2 = 0 THEN '10.1/x' END END FROM c WHERE pos % 2 = 1
  UNION ALL SELECT session, pos, 2, 'tool_call', 't' || (session % 4) FROM c WHERE pos % 3 = 0 UNION ALL SELECT session, pos, 3, 'artifact', 'f' || (pos % 3) FROM c WHERE session % 5 = 0 UNION ALL SELECT session, pos, 4, 'rumour', '' FROM c WHERE session % 7 = 0),
k AS (SELECT conv_id AS session, 'parent::p' || (length(coalesce(text, '')) % 5) || '#s' AS key FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id AS session, 't' || (turn % 3) AS id, bool_or(turn % 4 = 0) AS failed FROM conversations WHERE role = 'user' GROUP BY ALL),
v AS (SELECT e.*, CASE kind WHEN 'chunk' THEN CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.session = e.session AND contains(key, ref)) THEN 'verified' ELSE 'unresolved' END WHEN 'citation' THEN 'external'
  WHEN 'tool_call' THEN CASE WHEN failed = false THEN 'verified' ELSE 'unresolved' END WHEN 'artifact' THEN CASE WHEN ref = 'f' || (e.session % 2) AND ref <> 'f2' THEN 'verified' ELSE 'unresolved' END ELSE 'unresolved' END AS status, failed FROM e LEFT JOIN t ON t.session = e.session AND t.id = e.ref AND kind = 'tool_call'),
x AS (SELECT *, CASE WHEN kind = 'rumour' THEN 'unknown-kind' WHEN kind = 'chunk' AND status = 'unresolved' THEN 'chunk-not-retrieved' WHEN kind = 'tool_call' AND failed IS NULL THEN 'call-not-in-trace' WHEN kind = 'tool_call' AND failed THEN 'call-failed'
  WHEN kind = 'artifact' AND ref = 'f2' THEN 'artifact-missing' WHEN kind = 'artifact' AND status = 'unresolved' THEN 'artifact-changed' WHEN kind = 'citation' AND ref IS NULL THEN 'citation-empty' WHEN kind = 'citation' AND session % 3 = 1 THEN 'pmid-malformed' END AS err, CASE WHEN kind = 'citation' AND ref LIKE '10.%' THEN 'doi-malformed' END AS warn FROM v),
g AS (SELECT session, pos, count(*) FILTER (WHERE status = 'verified') AS v, count(*) FILTER (WHERE status = 'external') AS ext, count(*) FILTER (WHERE status = 'unresolved') AS u, string_agg(lpad(n::VARCHAR, 3, '0') || ':' || err, ',' ORDER BY n) AS errs, string_agg(lpad(n::VARCHAR, 3, '0') || ':' || warn, ',' ORDER BY n) AS warns FROM x GROUP BY session, pos),
h AS (SELECT c.*, row_number() OVER (PARTITION BY session, claim_id ORDER BY pos) AS nth FROM c),
f AS (SELECT h.session AS session, h.pos AS pos, claim_id, lower(coalesce(confidence, 'moderate')) AS said, coalesce(v, 0) AS v, coalesce(ext, 0) AS ext, coalesce(u, 0) AS u, errs, warns, CASE WHEN claim_id = 'bad id' THEN 'id-form' WHEN nth > 1 THEN 'id-repeated' WHEN trim(text) = '' THEN 'text-missing' END AS early FROM h LEFT JOIN g USING (session, pos)),
claims AS (SELECT session, pos, claim_id, CASE WHEN said = 'sure' THEN 'moderate' ELSE said END AS confidence, early IS NULL AND v + ext > 0 AS kept, v AS n_verified, ext AS n_external, u AS n_unresolved,
  CASE WHEN early IS NOT NULL THEN early ELSE concat_ws(',', errs, CASE WHEN v + ext + u = 0 THEN 'evidence-missing' WHEN v + ext = 0 THEN 'all-unresolved' END) END AS errors, CASE WHEN early IS NULL THEN concat_ws(',', CASE WHEN said = 'sure' THEN 'confidence' END, warns) ELSE '' END AS warnings FROM f)"""


def _ledger(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Assistant turns as claims with made-up evidence of all four kinds and one unknown; user turns say what was retrieved and called."""
    conv = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    c, s, t = conv.filter("role = 'assistant'"), F.col("conv_id"), F.col("turn")
    claims = c.select(s.alias("session"), t.alias("pos"), F.when(t % 6 == 5, "bad id").otherwise(F.concat(F.lit("C"), (t % 4).cast("string"))).alias("claim_id"), "text", F.when(t % 3 == 0, "Strong").when(t % 3 == 2, "sure").alias("confidence"))
    none = F.lit(None).cast("string")

    def kind(n: int, name: str, rule: str, **refs) -> DataFrame:
        fields = [refs.get(f, none).alias(f) for f in ("path", "sha256", "parent_id", "tool_use_id", "pmid", "doi", "url")]
        return c.filter(rule).select(s.alias("session"), t.alias("claim_id"), F.lit(n).alias("n"), F.lit(name).alias("kind"), *fields)

    ref = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    rows = kind(0, "chunk", "turn % 5 <> 4", parent_id=ref("p", F.length("text") % 7))
    rows = rows.unionByName(kind(1, "citation", "turn % 2 = 1", pmid=F.when(s % 3 == 0, "1234567").when(s % 3 == 1, "abc"), doi=F.when((s % 3 == 2) & (s % 2 == 0), "10.1/x")))
    rows = rows.unionByName(kind(2, "tool_call", "turn % 3 = 0", tool_use_id=ref("t", s % 4))).unionByName(kind(3, "artifact", "conv_id % 5 = 0", path=ref("f", t % 3), sha256=ref("x", s % 2))).unionByName(kind(4, "Rumour", "conv_id % 7 = 0"))
    u = conv.filter("role = 'user'")
    keys = u.select(s.alias("session"), F.concat(F.lit("parent::p"), (F.length("text") % 5).cast("string"), F.lit("#s")).alias("key"))
    results = u.select(s.alias("session"), ref("t", t % 3).alias("tool_use_id"), (t % 4 == 0).alias("is_error"), F.lit("fine").alias("text"))
    events = guard.tool_events(results.select("session", "tool_use_id", F.lit("search").alias("name")), results)
    artifacts = spark.createDataFrame([("f0", "x0"), ("f1", "x1")], "path string, sha256 string")
    return claims, rows, keys, events, artifacts


@query(f"WITH {_CLAIMS} SELECT * FROM claims")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict validation of the made-up claims."""
    out = guard.validate_claims(*_ledger(spark, sf_dir))
    return out.withColumn("errors", F.concat_ws(",", "errors")).withColumn("warnings", F.concat_ws(",", "warnings"))


@query(r"""WITH a AS (SELECT conv_id, turn, 'grew ' || (conv_id % 4) || '.5-fold in ' || (2000 + turn) || ' or ' || (conv_id % 7) || ',000 times' AS claim, ['it grew by ' || (conv_id % 5) || '000', CASE WHEN turn % 2 = 0 THEN 'a value of 11.5, then 12.50' END] AS evidence, 2000 + conv_id % 3 AS y FROM conversations),
b AS (SELECT conv_id, turn, list_distinct(list_concat(regexp_extract_all(replace(claim, ',', ''), '(?i)([0-9]+(?:\.[0-9]+)?)\s*-?\s*(?:fold|×|x)\b', 1), regexp_extract_all(replace(claim, ',', ''), '[0-9]+(?:\.[0-9]+)?'))) AS n, list_append(list_transform(list_filter(evidence, lambda e: e IS NOT NULL), lambda e: replace(e, ',', '')), y::VARCHAR) AS hay FROM a)
SELECT conv_id, turn, len(list_filter(n, lambda x: len(list_filter(hay, lambda h: regexp_matches(h, '(^|[^0-9.])' || replace(x, '.', '\.') || '($|[^0-9])'))) > 0)) = 0 AS mismatch FROM b""")
def numeric_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a made-up claim for every turn, looked up in made-up evidence and the years of its sources."""
    c, t = F.col("conv_id"), F.col("turn")
    text = lambda x: x.cast("string")
    claim = F.concat(F.lit("grew "), text(c % 4), F.lit(".5-fold in "), text(2000 + t), F.lit(" or "), text(c % 7), F.lit(",000 times"))
    evidence = F.array(F.concat(F.lit("it grew by "), text(c % 5), F.lit("000")), F.when(t % 2 == 0, "a value of 11.5, then 12.50"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", guard.numeric_mismatch(claim, evidence, F.array((2000 + c % 3).cast("int"))).alias("mismatch"))


@query(f"""WITH k AS (SELECT conv_id AS session, regexp_extract('search::' || translate(text, chr(10), ' '), '^search::(.+)$', 1) AS q FROM conversations WHERE role = 'user' AND text IS NOT NULL),
m AS (SELECT conv_id AS session, CASE WHEN conv_id % 4 = 0 OR conv_id % 4 = 2 AND turn % 4 = 1 THEN 'NO_RELEVANT_CHUNKS: --- RESULT none' WHEN conv_id % 4 = 1 OR conv_id % 4 = 2 THEN '--- RESULT 1' || chr(10) || 'x' || chr(10) || '--- PARENT 2' ELSE coalesce(text, '') END AS text FROM conversations WHERE role = 'assistant'),
a AS (SELECT session, count(DISTINCT trim(q, ' ')) AS queries FROM k WHERE length(trim(q, ' ')) >= 8 GROUP BY session),
b AS (SELECT session, count(*) FILTER (WHERE e) AS empty, CAST(sum(CASE WHEN e THEN 0 ELSE len(regexp_extract_all(text, '--- RESULT|--- PARENT')) END) AS BIGINT) AS blocks FROM (SELECT *, regexp_matches(text, '{"|".join(guard.EMPTY_MARKERS)}') AS e FROM m WHERE text <> '') GROUP BY session),
f AS (SELECT coalesce(a.session, b.session) AS session, coalesce(queries, 0) AS queries, coalesce(empty, 0) AS empty, coalesce(blocks, 0) AS blocks FROM a FULL JOIN b ON a.session = b.session)
SELECT *, queries > 0 AND empty > 0 AND blocks = 0 AS no_evidence, CASE WHEN queries > 0 AND blocks = 0 THEN CASE WHEN empty > 0 THEN '{guard.NO_EVIDENCE}' ELSE '{guard.NOT_VISIBLE}' END ELSE '' END AS note FROM f""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as searches; what assistants say is made into empty results, result blocks, both or neither."""
    conv, s, t = read(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    keys = conv.filter("role = 'user' and text is not null").select(s.alias("session"), F.concat(F.lit("search::"), F.translate("text", "\n", " ")).alias("key"))
    text = F.when((s % 4 == 0) | (s % 4 == 2) & (t % 4 == 1), "NO_RELEVANT_CHUNKS: --- RESULT none").when((s % 4).isin(1, 2), "--- RESULT 1\nx\n--- PARENT 2").otherwise(F.col("text"))
    return guard.evidence_gate(keys, conv.filter("role = 'assistant'").select(s.alias("session"), text.alias("text")))


_ANSWER = """a AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'It is Not Answerable from this.' WHEN 1 THEN 'Growth is likely.' || chr(10) || '**Sources:**' || chr(10) || '- s' || o_custkey || '.md#intro#ab' || chr(10) || '2. other ' || o_orderkey
  WHEN 2 THEN 'Bone.' || chr(10) || '# Sources' || chr(10) || '* no supporting evidence.md' WHEN 3 THEN 'sources say: no literature supporting this' || chr(10) || 'Sources:' || chr(10) || chr(10) ELSE 'Plain' END AS answer,
  ['s' || o_custkey || '.md', 'never here'] AS expected, o_orderkey % 3 = 0 AS refusal_expected FROM orders)"""


@query(rf"""WITH {_ANSWER}, p AS (SELECT *, string_split_regex(answer, '(?im)^[#>\*\s-]*sources?\b[^a-z]*$') AS parts FROM a),
q AS (SELECT id, refusal_expected, parts[1] AS body, CASE WHEN len(parts) > 1 THEN list_filter(list_transform(string_split(parts[-1], chr(10)), lambda x: regexp_extract(x, '^\s*(?:[-*•]|[0-9]+[.)])?\s*(.+?)\s*$', 1)), lambda x: x <> '') ELSE [] END AS l, list_transform(expected, lambda x: {_FOLD.format("x")}) AS e FROM p),
c AS (SELECT l_orderkey AS id, l_linenumber % 4 <> 0 AS kept, l_linenumber % 3 = 1 AS ver, l_linenumber % 5 = 2 AS ext, l_linenumber % 2 = 0 AS unr FROM lineitem WHERE l_quantity < 25),
s AS (SELECT id, count(*) FILTER (WHERE kept) AS k, count(*) FILTER (WHERE kept AND NOT ver AND NOT ext) AS h, count(*) FILTER (WHERE kept AND NOT ver AND NOT ext AND unr) AS u FROM c GROUP BY id)
SELECT q.id AS id, round(CASE WHEN k IS NULL THEN 0.0 WHEN k = 0 THEN 1.0 ELSE h / k END, 6) AS hallucination, round(CASE WHEN coalesce(k, 0) = 0 THEN 0.0 ELSE u / k END, 6) AS exposure,
  CASE WHEN refusal_expected THEN NULL WHEN len(l) = 0 THEN 0.0 ELSE len(list_filter(l, lambda x: len(list_filter(e, lambda y: contains({_FOLD.format("x")}, y))) > 0)) / len(l) END AS citation_accuracy, CAST(len(l) AS BIGINT) AS n_cited,
  regexp_matches(lower(body), 'no literature supporting|no supporting evidence|not answerable|cannot be answered') = refusal_expected AS refusal_ok FROM q LEFT JOIN s USING (id)""")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faithfulness of a made-up answer for every order; its smaller lines are claims."""
    o, c, m = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    answer = F.when(m == 0, "It is Not Answerable from this.").when(m == 1, F.concat(F.lit("Growth is likely.\n**Sources:**\n- s"), c, F.lit(".md#intro#ab\n2. other "), o)).when(m == 2, "Bone.\n# Sources\n* no supporting evidence.md").when(m == 3, "sources say: no literature supporting this\nSources:\n\n").otherwise("Plain")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answer.alias("answer"), F.array(F.concat(F.lit("s"), c, F.lit(".md")), F.lit("never here")).alias("expected"), (F.col("o_orderkey") % 3 == 0).alias("refusal_expected"))
    n = F.col("l_linenumber")
    claims = read(spark, sf_dir, "lineitem").filter("l_quantity < 25").select(F.col("l_orderkey").alias("id"), (n % 4 != 0).alias("kept"), (n % 3 == 1).cast("long").alias("n_verified"), (n % 5 == 2).cast("long").alias("n_external"), (n % 2 == 0).cast("long").alias("n_unresolved"))
    out = evaluate.faithfulness(rows, claims)
    return out.withColumn("hallucination", F.round("hallucination", 6)).withColumn("exposure", F.round("exposure", 6))


@query("""WITH e AS (SELECT l_partkey AS id, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS v FROM lineitem WHERE l_quantity / 50 >= 0.54 OR l_quantity = 1 GROUP BY l_partkey)
SELECT p_partkey AS id, coalesce(n, 0) AS n_evidence, coalesce(v, 0) AS n_valid, CASE WHEN coalesce(v, 0) = 0 THEN 'unsupported' WHEN p_size % 4 = 0 THEN 'refuted' WHEN p_size % 4 = 1 THEN 'verified' ELSE 'speculative' END AS status FROM part LEFT JOIN e ON id = p_partkey""")
def hypothesis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as hypotheses, their order lines as evidence, a critic's verdict by size."""
    part = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    line = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_quantity") != 1, F.col("l_quantity") / 50).alias("similarity"), (F.col("l_linenumber") % 3 == 0).alias("valid"))
    verdicts = part.select("id", F.when(F.col("p_size") % 4 == 0, "Contradicted").when(F.col("p_size") % 4 == 1, "supported").when(F.col("p_size") % 4 == 2, "inconclusive").alias("verdict"))
    return directions.verification(part, line, verdicts)


@query("""WITH a AS (SELECT p_partkey AS key, p_brand || p_size AS doi, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name || ' ' || p_type END AS title FROM part),
b AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), lambda x: length(x) > 2)) AS k FROM a),
g AS (SELECT doi, count(*) AS n FROM b GROUP BY doi HAVING count(*) > 1),
s AS (SELECT x.doi AS doi, max(CASE WHEN len(x.k) = 0 OR len(y.k) = 0 THEN 0.0 ELSE 0.5 * len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))) + 0.5 * len(list_intersect(x.k, y.k)) / least(len(x.k), len(y.k)) END) AS s FROM b x JOIN b y ON x.doi = y.doi AND x.key < y.key WHERE x.title <> '' AND y.title <> '' GROUP BY x.doi)
SELECT g.doi AS doi, n, CASE WHEN s IS NULL THEN 'no-titles' WHEN s >= 0.6 THEN 'same-paper' ELSE 'CONFLICT' END AS verdict FROM g LEFT JOIN s ON g.doi = s.doi""")
def duplicate_doi_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share brand and size as papers that share a DOI; every third has no title."""
    title = F.when(F.col("p_partkey") % 3 != 0, F.concat_ws(" ", "p_name", "p_type"))
    return quality.duplicate_verdicts(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat("p_brand", F.col("p_size").cast("string")).alias("doi"), title.alias("title")))


@query(r"""WITH a AS (SELECT o_orderkey AS session, 'Bone grows [2]. It heals fast [S1] in mice. End' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Sources:' || chr(10) || '1. Lee 2020 doi 10.1234/ab' || o_custkey || '.;' || chr(10) || '- PMID 12345' || (100 + o_custkey % 900) || chr(10) || '* a web page' ELSE '' END AS text, o_custkey FROM orders)
SELECT session, 'S' || i AS claim_id, CASE i WHEN 1 THEN 'Lee 2020 doi 10.1234/ab' || o_custkey || '.;' WHEN 2 THEN 'PMID 12345' || (100 + o_custkey % 900) ELSE 'a web page' END AS text, 'weak' AS confidence, 'citation' AS kind, CASE WHEN i = 1 THEN '10.1234/ab' || o_custkey END AS doi,
  CASE WHEN i = 2 THEN '12345' || (100 + o_custkey % 900) END AS pmid, CASE WHEN i = 3 THEN 'a web page' END AS url, CASE i WHEN 1 THEN 'cited from body near: It heals fast [S1] in mice' WHEN 2 THEN 'cited from body near: Bone grows [2]' END AS note FROM a, (VALUES (1), (2), (3)) AS v(i) WHERE session % 2 = 0""")
def source_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the source lines of a made-up answer for every order."""
    c = F.col("o_custkey").cast("string")
    tail = F.concat(F.lit("\nSources:\n1. Lee 2020 doi 10.1234/ab"), c, F.lit(".;\n- PMID 12345"), (100 + F.col("o_custkey") % 900).cast("string"), F.lit("\n* a web page"))
    text = F.concat(F.lit("Bone grows [2]. It heals fast [S1] in mice. End"), F.when(F.col("o_orderkey") % 2 == 0, tail).otherwise(""))
    return guard.claims_from_sources(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), text.alias("text")))


@query(r"""WITH a AS (SELECT doc_id, coalesce(lang, '') || ' see [12], [Smith 2020], [PMID: 123], [e id:' || (doc_id % 9) || '], [note], [E1:P' || (doc_id % 3) || '] and [[claim:C' || (doc_id % 4) || ']] or [[claim:A.1]]' AS t FROM documents)
SELECT doc_id, '[e id:' || (doc_id % 9) || '],[E1:P' || (doc_id % 3) || ']' AS malformed, 'A.1,C' || (doc_id % 4) AS refs FROM a""")
def citation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed citation tokens and claim anchors of a made-up text for every document."""
    i = F.col("doc_id")
    n = lambda m: (i % m).cast("string")
    text = F.concat(F.coalesce("lang", F.lit("")), F.lit(" see [12], [Smith 2020], [PMID: 123], [e id:"), n(9), F.lit("], [note], [E1:P"), n(3), F.lit("] and [[claim:C"), n(4), F.lit("]] or [[claim:A.1]]"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.malformed_tokens(text), ",").alias("malformed"), F.array_join(guard.claim_refs(text), ",").alias("refs"))


@query(r"""WITH a AS (SELECT c_custkey AS session, 'Bone grows (Smith et al., 2020) and (see Kim, 1066) heals (Lee & Wu, ' || (2000 + c_custkey % 3) || 'a) in ' || c_mktsegment || ' (O''Neil, 2021) .' AS text FROM customer),
k AS (SELECT c_custkey AS session, CASE c_custkey % 4 WHEN 0 THEN 'Lee_2001_Growth' WHEN 1 THEN 'Wu2_2002-x' WHEN 2 THEN 'notes 2020' ELSE 'Smith - 2020 - Bone' END AS stem FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT session, CASE WHEN regexp_matches(stem, '^([A-Za-z][\w''\-]*?)[ _\-]+((?:19|20)[0-9]{2})([ _\-]|$)') THEN lower(regexp_extract(stem, '^([A-Za-z][\w''\-]*?)[ _\-]+((?:19|20)[0-9]{2})([ _\-]|$)', 1)) || ' ' || regexp_extract(stem, '^([A-Za-z][\w''\-]*?)[ _\-]+((?:19|20)[0-9]{2})([ _\-]|$)', 2) END AS ok FROM k),
m AS (SELECT a.session AS session, text, ok, unnest(regexp_extract_all(text, '\((?:see\s+)?[A-Z][\w''\-]+(?:\s+et\s+al\.)?(?:\s*(?:,|&|and)\s*[A-Z][\w''\-]+)*,?\s*[0-9]{4}[a-z]?\)')) AS mark FROM a JOIN n USING (session)),
b AS (SELECT *, regexp_extract_all(mark, '\b(?:19|20)[0-9]{2}\b') AS y, list_filter(regexp_extract_all(lower(replace(replace(mark, 'et al', ' '), 'see', ' ')), '[a-z][\w''\-]*'), lambda w: length(w) > 2) AS w FROM m),
c AS (SELECT session, text, mark, len(y) > 0 AND NOT coalesce(list_contains(flatten(list_transform(w, lambda x: list_transform(y, lambda z: x || ' ' || z))), ok), false) AS bad FROM b),
d AS (SELECT session, any_value(text) AS text, list(mark) FILTER (WHERE bad) AS bad FROM c GROUP BY session),
e AS (SELECT session, list_reduce(list_prepend(text, coalesce(bad, [])), lambda t, x: replace(replace(t, x || ' ', ' '), x, '')) AS text, coalesce(len(bad), 0) AS n FROM d)
SELECT a.session AS session, CASE WHEN e.session IS NULL THEN a.text ELSE regexp_replace(regexp_replace(e.text, '[ 	]{2,}', ' ', 'g'), '\s+([,.;:])', '\1', 'g') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_removed FROM a LEFT JOIN e USING (session)""")
def answer_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of a made-up answer for every customer that its parents' file names don't allow go; a session without parents keeps its answer."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("Bone grows (Smith et al., 2020) and (see Kim, 1066) heals (Lee & Wu, "), (2000 + k % 3).cast("string"), F.lit("a) in "), "c_mktsegment", F.lit(" (O'Neil, 2021) ."))
    stem = F.when(k % 4 == 0, "Lee_2001_Growth").when(k % 4 == 1, "Wu2_2002-x").when(k % 4 == 2, "notes 2020").otherwise("Smith - 2020 - Bone")
    rows = read(spark, sf_dir, "customer")
    known = rows.filter("c_custkey % 5 <> 0").select(k.alias("session"), F.concat(F.lit("store/"), stem, F.lit(".md#a#1")).alias("parent_id"), F.lit("").alias("title"))
    return guard.strip_unknown_citations(rows.select(k.alias("session"), text.alias("text")), guard.citable(known))


# what order lines say of their part, with the part, a note and the year of shipping as evidence
_RECHECK = r"""c AS (SELECT l_orderkey AS session, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS pos, CAST(l_quantity AS INTEGER) AS q, p_size AS size, p_retailprice AS price, l_linenumber AS line, l_returnflag AS flag FROM lineitem JOIN part ON p_partkey = l_partkey),
h AS (SELECT *, NOT (q = size OR q = floor(price) OR q = line) AS mismatch FROM c),
r AS (SELECT session, pos, 'sold ' || q || ' of part ' || repeat('x', 130) AS text, mismatch, CASE WHEN mismatch OR flag = 'N' THEN 'unresolved' WHEN flag = 'A' THEN 'verified' ELSE 'external' END AS status FROM h)"""


def _rechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order)).withColumn("session", F.col("l_orderkey"))
    q, text = F.col("l_quantity").cast("int").cast("string"), lambda c: F.col(c).cast("string")
    claims = lines.select("session", "pos", F.concat(F.lit("sold "), q, F.lit(" of part "), F.repeat(F.lit("x"), 130)).alias("text"), F.lit("moderate").alias("confidence"))
    status = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "R", "external").otherwise("unresolved")
    title = F.concat(F.lit("Trade of "), F.year("l_shipdate").cast("string"))
    evidence = lines.select("session", "pos", F.lit(1).alias("n"), text("l_partkey").alias("parent_id"), F.concat(F.lit("line "), text("l_linenumber")).alias("note"), title.alias("title"), (status == "verified").alias("verified"), status.alias("status"))
    parents = read(spark, sf_dir, "part").select(text("p_partkey").alias("parent_id"), F.concat(F.lit("size "), text("p_size"), F.lit(", price "), F.format_number("p_retailprice", 2)).alias("content"))
    return guard.recheck_numbers(claims, evidence, parents)[0]


@query(f"WITH {_RECHECK} SELECT session, pos, mismatch, CASE WHEN mismatch THEN 'weak' ELSE 'moderate' END AS confidence, (status = 'verified')::BIGINT AS n_verified, (status = 'external')::BIGINT AS n_external, (status = 'unresolved')::BIGINT AS n_unresolved FROM r")
def recheck_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of order lines, weaker where their number stands in none of their evidence."""
    return _rechecked(spark, sf_dir).drop("text")


@query(f"""WITH {_RECHECK}, w AS (SELECT session, count(*) AS n, string_agg('- ' || left(text, 120), chr(10) ORDER BY pos) AS t FROM r WHERE status = 'unresolved' GROUP BY session)
SELECT o_orderkey AS session, coalesce(n, 0) AS n_unverified, 'Answer.' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'no list' ELSE CASE WHEN n > 0 THEN chr(10) || chr(10) || '{guard.UNVERIFIED} (' || n || '):' || chr(10) || t || chr(10) || chr(10) ELSE '' END || '{guard.SOURCES_MARK}' || chr(10) || '- a {guard.SOURCES_MARK}' END AS text
FROM orders LEFT JOIN w ON session = o_orderkey""")
def unverified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, one an order, that name the claims of its lines that nothing verifies."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Answer.\n"), F.when(key % 3 == 0, "no list").otherwise(f"{guard.SOURCES_MARK}\n- a {guard.SOURCES_MARK}"))
    return guard.surface_unverified(read(spark, sf_dir, "orders").select(key.alias("session"), text.alias("text")), _rechecked(spark, sf_dir))


@query(f"""WITH t AS (SELECT conv_id AS session, turn AS pos, min(text) AS text FROM conversations WHERE role = 'user' AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
b AS (SELECT conv_id AS session, regexp_replace(max(text), '[.!?\\n]', ' ', 'g') || ' as all of these sources tell us in detail' AS body FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id),
x AS (SELECT session, pos, pos % 3 <> 1 AS good, pos % 5 <> 0 AND text <> '' AS stored, {_claim_sql("body")} AS a, {_claim_sql("text")} AS k FROM t JOIN b USING (session)),
s AS (SELECT session, pos, good, CASE WHEN NOT good OR NOT stored THEN NULL WHEN len(a) < {guard.LEAST_TOKENS} OR len(k) = 0 THEN 1.0::DOUBLE
  ELSE coalesce(list_sum(list_transform(list_filter(a, lambda t: list_contains(k, t)), lambda t: CASE WHEN length(t) >= {guard.RARE_LENGTH} THEN 3 ELSE 1 END)), 0) / list_sum(list_transform(a, lambda t: CASE WHEN length(t) >= {guard.RARE_LENGTH} THEN 3 ELSE 1 END))::DOUBLE END AS score FROM x)
SELECT session, count(*) AS n_source_lines, count(*) FILTER (WHERE good) AS n_whitelisted, round(count(*) FILTER (WHERE good) / count(*), 3) AS whitelist_rate, count(*) FILTER (WHERE NOT good) AS n_dropped,
  count(*) FILTER (WHERE score < 0.05) AS n_annotated, coalesce(list(round(score, 3) ORDER BY pos) FILTER (WHERE score IS NOT NULL), []::DOUBLE[]) AS lexical_scores FROM s GROUP BY session""")
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assistant says in a conversation, with the user's turns as sources: every third line names none, every fifth turn isn't in the store."""
    talk = read(spark, sf_dir, "conversations").filter("text is not null")
    turns = talk.filter("role = 'user' and turn is not null").groupBy(F.col("conv_id").alias("session"), F.col("turn").alias("pos")).agg(F.min("text").alias("text"))
    says = talk.filter("role = 'assistant'").groupBy(F.col("conv_id").alias("session")).agg(F.concat(F.regexp_replace(F.max("text"), r"[.!?\n]", " "), F.lit(" as all of these sources tell us in detail")).alias("body"))
    s, pos = (F.col(c).cast("string") for c in ("session", "pos"))
    named = turns.withColumn("parent_id", F.concat(F.lit("conv_"), s, F.lit("_"), pos, F.lit(".md#s#"), pos))
    line = F.when(F.col("pos") % 3 == 1, F.concat(F.lit("nothing "), pos)).otherwise(F.col("parent_id"))
    listed = named.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    answers = says.join(listed, "session").select("session", F.concat("body", F.lit("\n\n## Sources:\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["line"])), "\n")).alias("text"))
    return guard.citation_scores(answers, named.select("session", "parent_id", F.lit("").alias("title")), named.filter("pos % 5 <> 0").select("parent_id", F.col("text").alias("content")))
