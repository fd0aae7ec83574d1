"""Phrase search: BM25 over units of one word, of adjacent words (hyphenated terms) and of runs of ideographs, by the positions of words.

A query falls into groups that are searched apart: its Latin words and hyphenated terms, and each run of ideographs. A group's hits have all its units, or, where no document has,
any. A hyphenated term is a unit that occurs where its words stand side by side. A run must stand as it is; it is weighed by its windows
of two ideographs, and where no document has it, those windows are what may match alone. A query's hits are those of its groups one after another, each document where
it comes first. A unit weighs by its own documents and occurrences, like a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.metadata import fts_terms
from corpusloom.functions.text import CJK_RUN, run_bigrams, words
from corpusloom.operators.retrieve import _scored, small, top_k
from corpusloom.sources.staging import staged

MOST_LITERALS = 4096  # terms that a filter names one by one


def phrase_tokens(text: Column) -> Column:
    """A text's words and then the windows of its ideographs; an empty token stands where neighbours don't touch in the text."""
    gap = F.array(F.lit(""))
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CJK_RUN), F.lit(0))
    return F.concat(words(F.coalesce(text, F.lit(""))), F.flatten(F.transform(runs, lambda r: F.concat(gap, run_bigrams(r)))))


def phrase_units(queries: DataFrame, text: str = "query") -> DataFrame:
    """query_id, grp (0: Latin, then a run each), unit (adjacent tokens), scores, required."""
    terms, runs = fts_terms(F.col(text))
    latin = F.filter(F.transform(terms, words), lambda u: F.size(u) > 0)
    unit = lambda grp, u, scores, required: F.struct(grp.alias("grp"), u.alias("unit"), F.lit(scores).alias("scores"), F.lit(required).alias("required"))
    plain = F.transform(latin, lambda u: unit(F.lit(0), u, True, True))
    whole = F.transform(runs, lambda r, i: unit(i + 1, run_bigrams(r), False, True))
    parts = F.flatten(F.transform(runs, lambda r, i: F.transform(run_bigrams(r), lambda b: unit(i + 1, F.array(b), True, False))))
    each = queries.select("query_id", F.explode(F.concat(plain, whole, parts)).alias("u")).select("query_id", "u.*")
    return each.groupBy("query_id", "grp", "unit").agg(F.max("scores").alias("scores"), F.max("required").alias("required"))


def grams_of(unit: Column) -> Column:
    """A unit as what a scan looks for: its word, or its pairs of neighbours, which are far rarer than its words."""
    pairs = F.transform(F.slice(unit, F.lit(2), F.size(unit)), lambda w, i: F.concat_ws(" ", F.get(unit, i), w))
    return F.when(F.size(unit) == 1, unit).otherwise(pairs)


def postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", tokens=phrase_tokens, positions: bool = True) -> tuple[DataFrame, DataFrame]:
    """key, term, tf, dl, and positions, of wanted terms (words, or pairs of neighbours with a space between), and one row of n, avgdl. Texts are cut once, and what no
    query has goes before anything is grouped."""
    n = terms.count()
    named = [r["term"] for r in terms.collect()] if n <= MOST_LITERALS else None
    placed = F.transform("t", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    beside = F.transform(F.slice("t", F.lit(2), F.size("t")), lambda t, i: F.struct(F.concat_ws(" ", F.get("t", i), t).alias("term"), i.alias("pos")))
    if named is not None and not positions:
        hits = F.filter("t", lambda t: t.isin(*named))
    elif named is not None:
        one, two = [t for t in named if " " not in t], [t for t in named if " " in t]
        among = lambda some: lambda h: h["term"].isin(*some)
        found = [F.filter(x, among(some)) for x, some in ((placed, one), (beside, two)) if some]
        hits = F.concat(*found) if found else F.filter(placed, lambda _: F.lit(False))
    else:
        hits = F.filter(F.concat(placed, beside), lambda h: h["term"] != "")
    # a large file of texts can be one row group: texts are dealt anew, so that no task cuts many
    cut = docs.select(key, text).repartition(key).select(key, tokens(F.col(text)).alias("t")).select(key, F.size(F.filter("t", lambda t: t != "")).alias("dl"), hits.alias("hits"))
    cut = staged(cut, "cut") if named is not None else cut
    totals = cut.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    each = cut.select(key, "dl", F.explode("hits").alias("h"))
    each = each.withColumnRenamed("h", "term") if named is not None and not positions else each.select(key, "dl", "h.*")
    each = each if named is not None else each.join(small(terms, n), "term", "left_semi")
    where = [F.collect_list("pos").alias("positions")] if positions else []
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), *where), totals


def unit_frequencies(found: DataFrame, units: DataFrame, key: str, parts_of=lambda unit: unit) -> DataFrame:
    """unit, key, tf, dl of units (unit) in postings of their parts: of a unit of several parts the places where they follow each other."""
    wanted = units.select("unit", parts_of(F.col("unit")).alias("parts")).distinct()
    one = wanted.filter(F.size("parts") == 1).select("unit", F.col("parts")[0].alias("term"))
    single = found.join(small(one, one.count()), "term").select("unit", key, "tf", "dl")
    parts = wanted.filter(F.size("parts") > 1).select("unit", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "term"))
    # a unit has a row for each of its parts here: what meets is bounded by the query and by one document
    met = found.join(small(parts, parts.count()), "term").groupBy("unit", "n", key).agg(F.first("dl").alias("dl"), F.collect_list(F.struct("at", "positions")).alias("ps"))
    starts = lambda p: F.transform(p["positions"], lambda x: x - p["at"])
    both = F.aggregate(F.slice("ps", 2, F.size("ps")), starts(F.col("ps")[0]), lambda a, p: F.array_intersect(a, starts(p)))
    many = met.filter(F.size("ps") == F.col("n")).select("unit", key, F.size(both).cast("long").alias("tf"), "dl").filter("tf > 0")
    return single.unionByName(many)


def score_units(found: DataFrame, totals: DataFrame, units: DataFrame, key: str, parts_of=lambda unit: unit) -> DataFrame:
    """query_id, grp, key, score, whole: whether a document has all that its group requires."""
    tf = staged(unit_frequencies(found, units, key, parts_of).withColumnRenamed("unit", "term"), "units")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    group = F.struct("query_id", "grp").alias("query_id")
    asked = units.select(group, F.col("unit").alias("term"), "scores", "required")
    scored = _scored(tf, df, totals, asked.filter("scores").select("query_id", "term"), key, False)
    needs = asked.filter("required").groupBy("query_id").agg(F.count("*").alias("needs"))
    has = tf.join(asked.filter("required").select("query_id", "term"), "term").groupBy("query_id", key).agg(F.count("*").alias("has"))
    out = scored.join(has, ["query_id", key], "left").join(needs, "query_id", "left").withColumn("whole", F.coalesce(F.col("has") == F.col("needs"), F.lit(False)))
    return out.select("query_id.query_id", "query_id.grp", key, "score", "whole")


def ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    """query_id, key, score, rank: of each group the k best that have all, or if none has, any; group after group, each document once."""
    scored = staged(scored, "scored")
    some = scored.groupBy("query_id", "grp").agg(F.max("whole").alias("_some"))
    kept = scored.join(small(some, some.count()), ["query_id", "grp"]).filter("whole or not _some").select("query_id", "grp", key, "score")
    best = top_k(kept, k, ["query_id", "grp"], [F.col("score").desc(), F.col(key)])
    once = best.groupBy("query_id", key).agg(F.min(F.struct("grp", "rank", "score")).alias("b"))
    return once.select("query_id", key, "b.score", F.row_number().over(Window.partitionBy("query_id").orderBy("b.grp", "b.rank")).alias("rank"))


def bm25_phrases(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, key, score, rank of queries (query_id, query) over docs, which are read once."""
    units = staged(phrase_units(queries), "asked")
    terms = units.select(F.explode(grams_of(F.col("unit"))).alias("term")).distinct()
    found, totals = postings(docs, terms, key, text)
    return ranked(score_units(staged(found, "postings"), totals, units, key, grams_of), k, key)
