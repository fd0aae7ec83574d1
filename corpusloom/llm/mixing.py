"""Mixing sources to target weights by hash-threshold histograms.

Sources by code point, null last, weigh WEIGHTS in turn and share FACTOR times the words of the table; a source's target stops at LIMIT times its words,
and the excess is shared again by weight until none is above. A source whose target is over its words is taken whole first; the rest of the
target is a budget that a threshold on the documents' hashes meets: the words of each source and hash bucket are summed, the bucket where the running sum
passes the budget is split again, and only its documents are looked at, until one hash is left. Documents below it are taken. That hash's document
doesn't fit; where more than TOLERANCE of the target is still open, a nested threshold follows among later documents that fit what is left. So
a document is taken when its hash is below a threshold: nothing is sorted, and reruns agree.

Defined cases: null text has no words; a null source is a source of its own, after all others; hashes are of doc_id, source and text, so rows that are equal in these
three are taken alike; documents without words are taken 0 words; an empty table, or one without words, gives targets of 0. Columns of docs called
size, source_size, target or taken are replaced, others stay. A source's words miss its target by less than TOLERANCE, or than its smallest document still to be had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, numbered, scratch, staged, table, text_or_empty

WEIGHTS = (5, 2, 1)  # of the sources, repeating
FACTOR = 1.5  # words of the mix by words of the table
LIMIT = 2  # times that a source's words, and a document's, are taken at most
TOLERANCE = 0.001  # of a target: an open rest below it is near enough
BITS = 60  # of a hash
STEP = 12  # bits that one histogram looks at
ROW_BYTES = 200  # of a source with its thresholds
NEW = ("size", "source_size", "target", "taken")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size, the words of the text, and _h, a hash of BITS bits."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", text)]
    hashes = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, BITS // 4), 16, 10).cast("long")
    return docs.drop(*NEW).withColumns({"size": words(text_or_empty(text)), "_h": hashes})


def targets(sources: DataFrame, weights: tuple = WEIGHTS, factor: float = FACTOR, limit: float = LIMIT) -> DataFrame:
    """source, source_size, with target. What a unit of weight gets rises from round to round, as capped sources leave more for the rest."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    each = staged(numbered(sources, "_n", F.col("source").asc_nulls_last()).withColumn("_w", weight).drop("_n"), "weights")
    unit, capped = 0.0, -1
    while True:
        full = F.col("source_size") * float(limit) <= F.col("_w") * F.lit(unit)
        sums = each.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("_w"))), F.count(F.when(full, 1))).first()
        if not sums[2] or sums[3] == capped:
            break
        unit, capped = (factor * sums[0] - limit * (sums[1] or 0)) / sums[2], sums[3]
    return each.withColumn("target", F.least(F.col("source_size") * float(limit), F.col("_w") * F.lit(unit))).drop("_w")


def _where_passed(rows: DataFrame, known: DataFrame, small) -> DataFrame:
    """known (source, rest, taken) with the hash at which the running words of rows (source, size, _h) pass the rest, and the words before it; none where all fit."""
    key = ["source"]
    found, part, start, shift = None, rows, known.select("source", "rest", F.col("taken").alias("_from")), BITS
    while shift:
        shift -= STEP
        each = part.groupBy(*key, F.shiftright("_h", shift).alias("_b")).agg(F.sum("size").alias("_s"), F.min("_h").alias("_least"), F.max("_h").alias("_most"))
        running = F.sum("_s").over(Window.partitionBy(*key).orderBy("_b")) - F.col("_s")
        sums = _by_source(each.withColumn("_before", running), start, small).withColumn("_before", F.col("_before") + F.col("_from"))
        first = sums.filter((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_s") > F.col("rest")))
        at = staged(first.select(*key, "rest", "_b", "_before", "_least", "_most"), "passed")
        done = at.filter("_least = _most").select(*key, F.col("_least").alias("_cut"), "_before")
        found = done if found is None else found.unionByName(done)
        left = at.filter("_least < _most")
        if not shift or left.isEmpty():
            return found
        inside = _by_source(part, left.select("source", "_b"), small).filter(F.shiftright("_h", shift) == F.col("_b"))
        part = staged(inside.select("source", "size", "_h"), "boundary")
        start = left.select("source", "rest", F.col("_before").alias("_from"))
    return found


def _by_source(rows: DataFrame, sources: DataFrame, small) -> DataFrame:
    right = small(sources.withColumnRenamed("source", "_source"))
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def thresholds(sized: DataFrame, weights: tuple = WEIGHTS, factor: float = FACTOR, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target, _whole (times that all are taken), _cuts (from, to, longest: hashes and sizes taken once more) of rows (source, size, _h)."""
    sources = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, factor, limit), "targets")
    n_sources = sources.count()
    small = lambda df: broadcast_if_small(df, n_sources, ROW_BYTES)
    whole = F.when(F.col("source_size") > 0, F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(float(limit))))).otherwise(0).cast("long")
    sources = sources.withColumn("_whole", whole)
    budget = F.col("target") - F.col("_whole") * F.col("source_size")
    known = sources.select("source", "target", budget.alias("rest"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("_lo"), F.lit(2**62).alias("_longest")).filter("rest > 0")
    rows, cuts = sized.filter("size > 0").select("source", "size", "_h"), None
    while True:
        some = rows if cuts is None else _by_source(rows, known.select("source", "_lo", "_longest"), small).filter("_h >= _lo and size <= _longest").select(*rows.columns)
        passed = _where_passed(some, known, small).withColumnRenamed("source", "_source")
        met = known.join(small(passed), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        met = staged(met.withColumn("_hi", F.coalesce("_cut", F.lit(1 << BITS))), "cuts")
        now = met.select("source", F.struct("_lo", "_hi", "_longest").alias("_cut"))
        cuts = now if cuts is None else cuts.unionByName(now)
        open_ = met.filter("_cut is not null").withColumn("_longest", F.floor(F.col("rest") - F.col("_before")))
        known = open_.select("source", "target", "rest", F.col("_before").alias("taken"), (F.col("_cut") + 1).alias("_lo"), "_longest").filter((F.col("rest") - F.col("taken") > F.col("target") * TOLERANCE) & (F.col("_longest") > 0))
        if known.isEmpty():
            break
    every = cuts.groupBy("source").agg(F.collect_list("_cut").alias("_cuts")).withColumnRenamed("source", "_source")
    return sources.join(small(every), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def take(sized: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with size and _h, with source_size, target and taken, by the thresholds of their sources."""
    once_more = F.exists("_cuts", lambda c: (F.col("_h") >= c["_lo"]) & (F.col("_h") < c["_hi"]) & (F.col("size") <= c["_longest"]))
    rows = _by_source(sized, found, lambda df: broadcast_if_small(df, found.count(), ROW_BYTES))
    times = F.col("_whole") + F.when(F.coalesce(once_more, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("taken", F.col("size") * times).drop("_h", "_whole", "_cuts")


def mix(docs: DataFrame, text: str = "text", weights: tuple = WEIGHTS, factor: float = FACTOR, limit: float = LIMIT) -> DataFrame:
    """docs with size, source_size, target and taken; taken / size says how often a document is in the mix."""
    with scratch() as keep:
        found = keep(staged(thresholds(staged(hashed(docs, text).select("source", "size", "_h"), "sized"), weights, factor, limit), "thresholds"))
    return take(hashed(docs, text), found)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    with scratch() as keep:
        sized = keep(staged(hashed(docs).drop("text"), "sized"))
        found = keep(staged(thresholds(sized), "thresholds"))
    return take(sized, found).select("doc_id", "size", "source_size", "target", "taken")


# each document in the order of its hash is taken if it fits; where one doesn't, a rest under a thousandth of the target ends the walk
OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS k FROM w),
c AS (SELECT k, 2.0::DOUBLE * source_size / weight AS ratio, CAST((SELECT sum(source_size) FROM o) AS BIGINT) AS words, CAST(coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
  CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights FROM o),
u AS (SELECT (1.5::DOUBLE * words - 2 * capped) / weights AS unit FROM c WHERE (1.5::DOUBLE * words - 2 * capped) / weights <= ratio ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * unit) AS target FROM w, u),
s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(least(target / source_size, 2)) AS BIGINT) ELSE 0 END AS whole FROM t),
n AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY h) AS i FROM d WHERE size > 0),
walk AS (
  SELECT source, CAST(0 AS BIGINT) AS i, target, target - whole * source_size AS rest, CAST(0 AS BIGINT) AS taken, CAST(4611686018427387904 AS BIGINT) AS longest, false AS yes FROM s
  UNION ALL
  SELECT v.source, n.i, v.target, v.rest, CASE WHEN n.size <= v.longest AND v.taken + n.size <= v.rest THEN v.taken + n.size ELSE v.taken END,
    CASE WHEN n.size > v.longest OR v.taken + n.size <= v.rest THEN v.longest WHEN v.rest - v.taken > v.target * 0.001 THEN CAST(floor(v.rest - v.taken) AS BIGINT) ELSE 0 END,
    n.size <= v.longest AND v.taken + n.size <= v.rest
  FROM walk v JOIN n ON n.source IS NOT DISTINCT FROM v.source AND n.i = v.i + 1),
y AS (SELECT n.doc_id, n.source FROM walk v JOIN n ON n.source IS NOT DISTINCT FROM v.source AND n.i = v.i WHERE v.yes)
SELECT d.doc_id, d.size, s.source_size, s.target, CAST(d.size * (s.whole + CASE WHEN y.doc_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN y ON d.doc_id = y.doc_id AND d.source IS NOT DISTINCT FROM y.source
"""
