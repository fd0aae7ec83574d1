"""Line dedup by overlapping three-line windows.

Lines are what newlines separate; a line of over LONG_CHARS characters is wrapped at the ends of its sentences, so that a long passage
on one or two lines is made of several lines too. Every three consecutive lines of a document are one window, known by two 64-bit hashes. A window
that occurs more than once keeps its first occurrence (least doc_id, then position); the lines that any later occurrence covers are removed, so
overlapping later windows merge into one removed stretch. Of equal lines the earliest always stays.

Lines are compared without spaces at their ends (tabs and carriage returns count) and keep what separates them. Defined cases: null text is empty; a document of
fewer than three lines has no window and stays; windows of blank lines only don't count; rows that share a doc_id
count as separate documents in the order of their text hash; of equal rows one is the first, the others lose every line that a window
covers. Long documents are split whole. Counts are pre-aggregated before they are shuffled, and hot windows are joined as pairs of window and document,
one row each, with a written table of the repeated windows, so that the adaptive skew join can split them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, scratch, staged, table, text_or_empty
from .sketches import bound

WINDOW_LINES = 3
LONG_CHARS = 200  # a line of more characters is wrapped
ENDS = (". ", "! ", "? ")  # of sentences
MARK = "\u0001"


def lines_of(text: Column) -> Column:
    """The lines of a text with the newline or space that ends them: joined they are the text."""
    marked = F.replace(text, F.lit("\n"), F.lit("\n" + MARK))
    plain = F.split(marked, MARK, -1)

    def wrapped(line: Column) -> Column:
        for end in ENDS:
            line = F.replace(line, F.lit(end), F.lit(end + MARK))
        return F.split(line, MARK, -1)

    fast = F.flatten(F.transform(plain, lambda x: F.when(F.length(x) > LONG_CHARS, wrapped(x)).otherwise(F.array(x))))
    # a text that has the mark itself is cut by look-behind, which is slower
    slow = F.flatten(F.transform(F.split(text, r"(?<=\n)", -1), lambda x: F.when(F.length(x) > LONG_CHARS, F.split(x, r"(?<=[.!?] )", -1)).otherwise(F.array(x))))
    return F.when(text.contains(MARK), slow).otherwise(fast)


def _bare(line: Column) -> Column:
    return F.trim(F.when(line.endswith("\n"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line))


def hashed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _tie (the text's hash), _h (hashes of its lines)."""
    return docs.select("doc_id", F.xxhash64(text_or_empty(text)).alias("_tie"), F.transform(lines_of(text_or_empty(text)), lambda x: F.xxhash64(_bare(x))).alias("_h"))


def windows(hashed: DataFrame) -> DataFrame:
    """doc_id, _tie, pos (from 0), h1, h2: every window that isn't blank, of hashed lines."""
    blank = F.xxhash64(F.lit(""))
    long = hashed.filter(F.size("_h") >= WINDOW_LINES)
    each = long.select("doc_id", "_tie", F.posexplode(F.arrays_zip(F.slice("_h", 1, F.size("_h") - 2).alias("a"), F.slice("_h", 2, F.size("_h") - 2).alias("b"), F.slice("_h", 3, F.size("_h") - 2).alias("c"))).alias("pos", "w"))
    lines = [F.col("w.a"), F.col("w.b"), F.col("w.c")]
    return each.filter(~((lines[0] == blank) & (lines[1] == blank) & (lines[2] == blank))).select("doc_id", "_tie", "pos", F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(1), *reversed(lines)).alias("h2"))


def later_windows(hashed: DataFrame) -> DataFrame:
    """doc_id, _tie, pos of every window that an earlier one repeats.

    Windows of documents after the first that has them are later ones at once; only those of the first document are compared by place.
    """
    every, key = windows(hashed), ["h1", "h2"]
    counted = every.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    repeated = staged(counted.filter("n > 1").drop("n"), "repeated")
    # a null id comes before all others
    after = F.when(F.col("unnamed"), F.col("doc_id").isNotNull()).otherwise(F.col("doc_id") > F.col("least"))
    met = staged(every.join(repeated, key).select(*key, "doc_id", "_tie", "pos", after.alias("after")), "met")
    own = met.filter("not after").select(*key, "doc_id", "_tie", "pos")
    first = own.groupBy(*key).agg(F.min(F.struct("_tie", "pos")).alias("first"))
    again = own.join(first, key).filter(F.struct("_tie", "pos") != F.col("first"))
    return met.filter("after").select("doc_id", "_tie", "pos").unionByName(again.select("doc_id", "_tie", "pos"))


def _kept(lines: Column, starts: Column) -> Column:
    """The lines that no window starting at one of ``starts`` covers."""
    covered = F.flatten(F.transform(starts, lambda p: F.array(*[p + i for i in range(WINDOW_LINES)])))
    flags = F.array_distinct(covered)
    return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), flags), lambda i: F.element_at(lines, i + 1))


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text rewritten, and n_lines and n_removed (long); every row stays."""
    same = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("_tie") == F.col(b))
    with scratch() as keep:
        hashed = keep(staged(hashed_lines(docs, text), "hashed"))
        removed = keep(staged(later_windows(hashed).groupBy("doc_id", "_tie").agg(F.collect_set("pos").alias("_starts")).toDF("_id", "_key", "_starts"), "removed"))
        copies = keep(staged(hashed.groupBy("doc_id", "_tie").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_key")), "copies"))
    rows = docs.drop("n_lines", "n_removed").withColumn("_tie", F.xxhash64(text_or_empty(text)))
    joined = rows.join(removed, same("_id", "_key"), "left").drop("_id", "_key")
    n_copies = copies.count()
    if n_copies:
        # one row of each such document is the first; the others repeat all of its windows
        copies = broadcast_if_small(copies, n_copies, 32)
        every = windows(hashed.join(copies, same("_id", "_key"), "left_semi")).groupBy("doc_id", "_tie").agg(F.collect_set("pos").alias("_all")).toDF("_id", "_key", "_all")
        again = joined.join(copies, same("_id", "_key"), "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_tie").orderBy(F.lit(1))))
        again = again.join(every, same("_id", "_key"), "left").withColumn("_starts", F.when(F.col("_nth") > 1, F.col("_all")).otherwise(F.col("_starts"))).drop("_nth", "_all", "_id", "_key")
        joined = joined.join(copies, same("_id", "_key"), "left_anti").unionByName(again)

    def made(lines: Column, left: Column) -> Column:
        whole = F.col("_starts").isNull()
        # a newline or space before a removed end goes with it
        gone_end = (F.size(left) > 0) & (F.array_max("_starts") + WINDOW_LINES >= F.size(lines))
        rest = F.array_join(left, "")
        rewritten = F.when(whole, text_or_empty(text)).when(gone_end, F.regexp_replace(rest, r"[\n ]\z", "")).otherwise(rest)
        n = F.when(lines == F.array(F.lit("")), 0).otherwise(F.size(lines)).cast("long")
        return F.struct(rewritten.alias("text"), n.alias("n"), (F.size(lines) - F.size(left)).cast("long").alias("removed"))

    kept = lambda lines: F.when(F.col("_starts").isNull(), lines).otherwise(_kept(lines, F.col("_starts")))
    one = bound(lines_of(text_or_empty(text)), lambda lines: bound(kept(lines), lambda left: made(lines, left)))
    # exploded, so that a caller's filter on what was removed doesn't cut the text a second time
    out = joined.withColumn("_made", F.explode(F.array(one)))
    columns = [F.col("_made.text").alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, F.col("_made.n").alias("n_lines"), F.col("_made.removed").alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


# chr(1) marks the ends of lines, as this dialect has no look-behind
OP2_SQL = r"""
WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\n', E'\n\x01', 'g'), chr(1))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\n', E'\n\x01', 'g'), chr(1)), 1) AS i FROM documents),
q AS (SELECT doc_id, i, string_split(CASE WHEN length(line) > 200 THEN regexp_replace(line, '([.!?] )', E'\\1\x01', 'g') ELSE line END, chr(1)) AS s FROM p),
u AS (SELECT doc_id, i, unnest(s) AS raw, generate_subscripts(s, 1) AS j FROM q),
l AS (SELECT doc_id, raw, trim(regexp_replace(raw, '\n$', ''), ' ') AS line, row_number() OVER d - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i, j)),
w AS (SELECT * FROM (SELECT doc_id, pos, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
      WHERE c IS NOT NULL AND NOT (a = '' AND b = '' AND c = '')),
r AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (VALUES (0), (1), (2)) AS t(o)),
k AS (SELECT l.*, x.pos IS NOT NULL AS gone FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos),
g AS (SELECT doc_id, max(n) AS n, max(raw) AS raw, count(*) FILTER (WHERE gone) AS removed, bool_or(gone AND pos = n - 1) AS ended, coalesce(string_agg(raw, '' ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN n = 1 AND raw = '' THEN 0 ELSE n END AS BIGINT) AS n_lines, CAST(removed AS BIGINT) AS n_removed, CASE WHEN ended THEN regexp_replace(text, '[\n ]$', '') ELSE text END AS text
FROM g
"""
