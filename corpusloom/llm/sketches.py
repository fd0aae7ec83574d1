"""Document fingerprints: bottom-k sketches of word-shingle hashes, in built-in functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles (five words; a shorter text is
one shingle; no words, no shingles). The k smallest of two sketches' union are the sketch of the two parts together, so
sketches merge in any order. With fewer than k hashes a sketch is the whole set and every estimate is exact.

Defined cases: null text is empty; two sketches without hashes are alike (1.0), one such against another is 0.0; very long
texts are hashed whole; repeated rows stay repeated; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SHINGLE_WORDS, broadcast_if_small, staged, table, text_or_empty

SKETCH = 128  # hashes kept: a standard error of at most 0.045 for resemblance
BUCKET_ROWS = 256  # neighbouring rows that one task sorts together; many small buckets deal out evenly
SEGMENTS = 256  # quantiles of the ids that bucket bounds are made from


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: inside lambdas a plain column would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_hashes(text: Column) -> Column:
    """Hashes of the words, which white space separates."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``words`` words, repeats included; a shorter text that has words is one run."""
    runs = lambda h: (
        F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) <= words, F.array(F.aggregate(h, F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x))))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(words)])))
    )
    return bound(word_hashes(text), runs)


def sketch(text: Column, k: int = SKETCH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: list[str], column: str, k: int = SKETCH) -> DataFrame:
    """One sketch for each group of parts. Hashes are deduplicated before they meet, and each task sends at most k of a group."""
    each = df.select(*by, F.explode(column).alias("_h")).groupBy(*by, "_h").agg(F.lit(1).alias("_one")).drop("_one")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    return each.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes that both sketches have."""
    both = bound(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; the exact number below k."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has; 1.0 if a has none."""
    j = resemblance(a, b, k)
    shared = j * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1.0 + j)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The hashes as 16 hexadecimal digits each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _buckets(ids: DataFrame) -> Column:
    """A bucket number that rises with doc_id and holds about BUCKET_ROWS rows: quantile segments, each cut evenly."""
    found = ids.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / SEGMENTS for i in range(SEGMENTS + 1)], 10_000).alias("q")).first()
    lows = sorted(set(found["q"] or [0]))
    cuts = max(1, round(found["n"] / BUCKET_ROWS / max(1, len(lows))))
    segments = max(1, min(len(lows), round(found["n"] / BUCKET_ROWS)))
    lows = [lows[i * len(lows) // segments] for i in range(segments)]
    if segments < 2 and cuts < 2:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    at = F.array(*[F.lit(x).cast("long") for x in lows])
    to = F.array(*[F.lit(x).cast("long") for x in [*lows[1:], lows[-1] + 1]])
    seg = F.greatest(F.size(F.filter(at, lambda x: x <= F.col("doc_id"))), F.lit(1))
    within = bound(seg, lambda s: (s - 1).cast("long") * cuts + F.least(F.lit(cuts - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - F.element_at(at, s)) * F.lit(cuts) / F.greatest(F.lit(1), F.element_at(to, s) - F.element_at(at, s))))).cast("long"))
    return F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(within)


def with_next(docs: DataFrame, values: list[str], order: str, prepare=lambda rows: rows) -> DataFrame:
    """Add next_<value> of the next row by doc_id (rows of one id by ``order``), of the first row after the last.

    prepare adds columns to the rows before they are shuffled.

    Rows meet in buckets of neighbouring ids; every bucket also gets the first row of the bucket that follows, so that one
    shuffle of the rows is enough and no task orders all of them.
    """
    docs = docs.withColumn("_bucket", _buckets(docs))
    firsts = staged(docs.groupBy("_bucket").agg(F.min("doc_id").alias("doc_id")), "firsts")
    n = firsts.count()
    # one row for each BUCKET_ROWS documents: ids only
    follow = firsts.select("doc_id", F.col("_bucket").alias("_of"), F.lag("_bucket").over(Window.orderBy("_bucket")).alias("_bucket"))
    last = firsts.agg(F.max("_bucket").alias("m"))
    top = last.first()["m"]
    follow = follow.select("_of", "doc_id", F.coalesce("_bucket", F.lit(top).cast("long")).alias("_to"))
    extra = docs.join(broadcast_if_small(follow.select(F.col("_of").alias("_bucket"), F.col("doc_id").alias("_first"), "_to"), n, 48), "_bucket")
    extra = extra.filter(F.col("doc_id").eqNullSafe(F.col("_first"))).drop("_first").withColumn("_bucket", F.col("_to")).drop("_to").withColumn("_extra", F.lit(1))
    w = Window.partitionBy("_bucket").orderBy("_extra", F.col("doc_id").asc_nulls_first(), order)
    rows = prepare(docs.withColumn("_extra", F.lit(0)).unionByName(extra))
    for v in values:
        rows = rows.withColumn(f"next_{v}", F.lead(v).over(w))
    return rows.filter("_extra = 0").drop("_extra", "_bucket")


def fingerprints(docs: DataFrame, text: str = "text", k: int = SKETCH) -> DataFrame:
    """doc_id, text, sketch, n_shingles (estimate) for every row."""
    return docs.select("doc_id", text_or_empty(text).alias("text")).withColumn("sketch", sketch(F.col("text"), k)).withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    rows = with_next(docs, ["text", "sketch"], "text", lambda r: r.withColumn("sketch", sketch(F.col("text"))))
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_within"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )
