"""Research directions, hypotheses and their verification; the answering loop. Models plug in, everything else is joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators.retrieve import WEAK_SIMILARITY, top_k


def stable_id(*parts: Column) -> Column:
    """Ten hexadecimal digits of a digest of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def anchor_scores(candidates: DataFrame, seeds: DataFrame, metrics: DataFrame, key: str = "direction_id") -> DataFrame:
    """key, anchor: how near a candidate is to the papers that a question lands on. 1 if one of its anchors is a seed, else 0.5 and half the largest share of seeds
    that a community of its anchors holds, else 0.

    candidates: key, anchors (array, perhaps null or empty). seeds: source. metrics: node, community_id. Shares count the seeds whose community is known;
    repeated seeds count once. One row for each key.
    """
    placed = metrics.filter("community_id is not null").select("node", "community_id").dropDuplicates(["node"])
    own = seeds.select(F.col("source").alias("node")).filter("node is not null").distinct().withColumn("seed", F.lit(1.0))
    held = own.join(placed, "node").groupBy("community_id").agg(F.count("*").alias("n"))
    weights = held.join(F.broadcast(held.agg(F.sum("n").alias("total")))).select("community_id", (0.5 + 0.5 * F.col("n") / F.col("total")).alias("near"))
    each = candidates.select(key, F.explode_outer("anchors").alias("node")).distinct()
    met = each.join(own, "node", "left").join(placed, "node", "left").join(weights, "community_id", "left")
    return met.groupBy(key).agg(F.max(F.coalesce("seed", "near", F.lit(0.0))).alias("anchor"))


def diverge(channels: list[tuple[str, DataFrame]], focus: str = "", k: int = 20, seeds: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """direction_id, channel, text, score, rank: ideas of all channels (text, score) once each, those near the focus first.

    With seeds and metrics (see anchor_scores) the channels' anchors count before the focus, and anchor is returned; channels without anchors score 0.
    """
    rows, anchored = None, seeds is not None
    for i, (name, df) in enumerate(channels):
        part = df.select(F.lit(name).alias("channel"), F.lit(i).alias("_o"), "text", "score", *(["anchors"] if anchored and "anchors" in df.columns else []))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    want = F.array_distinct(words(F.lit(focus)))
    near = F.when(F.size(want) > 0, F.size(F.array_intersect(want, words(F.col("text")))) / F.size(want)).otherwise(0.0)
    anchored = anchored and "anchors" in rows.columns
    fields = ["_o", "channel", "text", "score", *(["anchors"] if anchored else [])]
    once = rows.withColumn("direction_id", stable_id(F.col("text"))).groupBy("direction_id").agg(F.min(F.struct(*fields)).alias("r")).select("direction_id", "r.*")
    order = [F.col("_n").desc(), F.col("_o"), F.col("score").desc(), F.col("direction_id")]
    if anchored:
        once = once.join(anchor_scores(once, seeds, metrics), "direction_id").drop("anchors")
        order = [F.round("anchor", 9).desc(), *order]
    elif seeds is not None:
        once = once.withColumn("anchor", F.lit(0.0))
    return top_k(once.withColumn("_n", near).withColumn("_all", F.lit(0)), k, ["_all"], order).drop("_all", "_n", "_o")


def verification(hypotheses: DataFrame, evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, n_evidence, n_valid, status of hypotheses (id).

    evidence: id, similarity, valid (a pointer that the ledger holds). It counts if its similarity is unknown or at least WEAK_SIMILARITY. verdicts: id,
    verdict of a critic. In this order: unsupported without evidence or without a valid pointer, refuted if the critic says contradicted, verified if it
    says supported, else speculative.
    """
    good = evidence.filter(F.col("similarity").isNull() | (F.col("similarity") >= WEAK_SIMILARITY))
    n = good.groupBy("id").agg(F.count("*").alias("n_evidence"), F.count_if("valid").alias("n_valid"))
    out = hypotheses.select("id").join(n, "id", "left").fillna(0, ["n_evidence", "n_valid"]).join(verdicts.select("id", F.lower("verdict").alias("_v")), "id", "left")
    status = F.when(F.col("n_valid") == 0, "unsupported").when(F.col("_v") == "contradicted", "refuted").when(F.col("_v") == "supported", "verified").otherwise("speculative")
    return out.select("id", "n_evidence", "n_valid", status.alias("status"))


def research(rounds: int, propose: Callable[[int], DataFrame], verify: Callable[[DataFrame], DataFrame], seen: DataFrame) -> DataFrame:
    """Rounds of proposing (id, ...) and verifying; an id already seen isn't taken again. Returns all verdicts with their round."""
    found = None
    for i in range(rounds):
        new = propose(i).dropDuplicates(["id"]).join(seen, "id", "left_anti")
        verdicts = verify(new).withColumn("round", F.lit(i))
        seen = seen.unionByName(new.select("id"))
        found = verdicts if found is None else found.unionByName(verdicts)
    return found


def answer(library, question: str, model: Callable[[str, list[str]], str], k: int = 6) -> dict:
    """One question: search with broadening, refuse without a model call where nothing was found, else ask the model and check its sources.

    model(question, passages) gives an answer; the passages are at most k rows.
    """
    from corpusloom.operators.guard import resolve_lines, split_sources

    spark = library.spark
    hits = library.search_or_broaden(spark.createDataFrame([(0, question)], "query_id long, query string"), k).orderBy("rank").limit(k).collect()
    if not hits:
        return {"answer": "no literature supporting an answer was found", "sources": [], "dropped": []}
    text = model(question, [h["text"] for h in hits])
    body, lines = split_sources(F.lit(text))
    row = spark.range(1).select(body.alias("body"), lines.alias("lines")).first()
    named = spark.createDataFrame([(0, i, x) for i, x in enumerate(row["lines"])], "session int, pos int, line string")
    known = spark.createDataFrame(sorted({(0, h["parent_id"], h["source"]) for h in hits}), "session int, parent_id string, title string")
    checked = resolve_lines(named, known).collect()
    source = {h["parent_id"]: h["source"] for h in hits}
    return {"answer": row["body"], "sources": sorted({source[r["parent_id"]] for r in checked if r["parent_id"]}), "dropped": sorted(r["line"] for r in checked if not r["parent_id"])}
