"""Retrieval and faithfulness scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an answer that refuses says.
REFUSALS = ("no literature supporting", "no supporting evidence", "not answerable", "cannot be answered")


def first_gold(hits: DataFrame, gold: Column) -> DataFrame:
    """query_id, hit, first_rank, reciprocal of ranked hits (query_id, rank)."""
    at = F.min(F.when(gold, F.col("rank")))
    out = hits.groupBy("query_id").agg(at.cast("long").alias("first_rank"))
    return out.select("query_id", F.col("first_rank").isNotNull().alias("hit"), "first_rank", F.coalesce(F.round(1 / F.col("first_rank"), 6), F.lit(0.0)).alias("reciprocal"))


def by_tier(scores: DataFrame, tier: str = "tier") -> DataFrame:
    """Recall and mean reciprocal rank of each tier and of all."""
    out = scores.rollup(tier).agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("recall"), F.avg("reciprocal").alias("mrr"), F.grouping(tier).alias("_all"))
    return out.withColumn(tier, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(tier))).drop("_all")


def refuses(body: Column) -> Column:
    return F.lower(body).rlike("|".join(REFUSALS))


def faithfulness(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """id, hallucination, exposure, citation_accuracy, n_cited, refusal_ok of answers (id, answer, expected, refusal_expected).

    claims: id, kept, n_verified, n_external, n_unresolved (see guard.validate_claims, not strict). Hallucination is the share of kept claims
    without verified or external evidence: 0 without claims, 1 if none was kept. Citation accuracy is the share of source lines whose folded form
    holds a folded expected source: 0 without lines, null where a refusal is expected. A refusal is looked for in the answer without its sources.
    """
    from corpusloom.functions.text import source_stem
    from corpusloom.operators.guard import split_sources

    none = (F.col("n_verified") == 0) & (F.col("n_external") == 0)
    shares = claims.groupBy("id").agg(F.count_if("kept").alias("_k"), F.count_if(F.col("kept") & none).alias("_h"), F.count_if(F.col("kept") & none & (F.col("n_unresolved") > 0)).alias("_u"))
    body, lines = split_sources(F.coalesce("answer", F.lit("")))
    rows = answers.select("id", body.alias("_b"), lines.alias("_l"), F.filter(F.transform(F.coalesce("expected", F.array().cast("array<string>")), source_stem), lambda x: x != "").alias("_e"), "refusal_expected").join(shares, "id", "left")
    good = F.size(F.filter("_l", lambda x: F.exists("_e", lambda e: source_stem(x).contains(e))))
    accuracy = F.when(F.col("refusal_expected"), F.lit(None)).when(F.size("_l") == 0, 0.0).otherwise(good / F.size("_l"))
    return rows.select(
        "id",
        F.when(F.col("_k").isNull(), 0.0).when(F.col("_k") == 0, 1.0).otherwise(F.col("_h") / F.col("_k")).alias("hallucination"),
        F.when(F.coalesce("_k", F.lit(0)) == 0, 0.0).otherwise(F.col("_u") / F.col("_k")).alias("exposure"),
        accuracy.alias("citation_accuracy"),
        F.size("_l").cast("long").alias("n_cited"),
        (refuses(F.col("_b")) == F.col("refusal_expected")).alias("refusal_ok"),
    )
