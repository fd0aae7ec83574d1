"""What a model's answer holds: rows, hypotheses, verdicts and picks, whole or broken, fenced or amid prose. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A row of a detailed answer, the verdicts, what a hypothesis is scored by and its scores' range, and the most evidence it names.
DETAILED_ROW = r'(?s)"([0-9]+)"\s*:\s*\{\s*"article_type"\s*:\s*"([a-z]+)"\s*,?\s*"topics"\s*:\s*\[(.*?)\]'
VERDICTS = ("supported", "contradicted", "inconclusive")
SCORES = ("interesting", "feasible", "testable")
LEAST_SCORE, MOST_SCORE, MOST_EVIDENCE = 1, 10, 6


def bare(answer: Column) -> Column:
    """Without the fence around it."""
    raw = F.trim(F.coalesce(answer, F.lit("")))
    return F.when(raw.startswith("```"), F.regexp_replace(F.regexp_replace(raw, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")).otherwise(raw)


def outermost(text: Column) -> Column:
    """From the first brace to the last; null without."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def json_object(answer: Column, amid: bool = True) -> Column:
    """The answer as a JSON object: all of it, or its outermost braces; null if neither parses to one. What a broken object still has, rows_of and others find."""
    raw = bare(answer)
    tries = [raw, outermost(raw)] if amid else [raw]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & F.ltrim(t).startswith("{"), F.try_parse_json(t)) for t in tries])


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _text(obj: Column, path: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(obj, path, "string"), F.lit("")))


def _last_of_each(pairs: Column) -> Column:
    """Entries without those whose key comes again."""
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))


def detailed_rows(answer: Column) -> Column:
    """map of paper number to struct(article_type, topics), row by row, so that a broken answer gives the rows it still has whole."""
    number, kind, topics = (F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(DETAILED_ROW), F.lit(i)) for i in (1, 2, 3))
    pairs = F.arrays_zip(number.alias("k"), kind.alias("a"), topics.alias("t"))
    named = lambda t: F.transform(F.filter(F.split(t, ","), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^[\"']+", ""), "[\"']+$", ""))
    entry = lambda p: F.struct(p["k"].cast("int").alias("k"), F.struct(p["a"].alias("article_type"), named(p["t"]).alias("topics")).alias("v"))
    return F.map_from_entries(F.transform(_last_of_each(pairs), entry))


def hypothesis(answer: Column) -> Column:
    """struct(claim, rationale, expected_evidence, falsifier, one score each of SCORES); null if nothing parses or no claim is made. Scores are rounded and held between
    LEAST_SCORE and MOST_SCORE, null where they are no numbers."""
    return _once(json_object(answer), _hypothesis)


def _hypothesis(obj: Column) -> Column:
    many = F.coalesce(F.try_variant_get(obj, "$.expected_evidence", "array<string>"), F.array(F.try_variant_get(obj, "$.expected_evidence", "string")))
    evidence = F.slice(F.filter(F.transform(many, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, MOST_EVIDENCE)

    def score(name: str) -> Column:
        x = F.try_variant_get(obj, f"$.scores.{name}", "double")
        x = F.coalesce(x, F.try_variant_get(obj, f"$.scores.{name}", "string").try_cast("double"))
        return F.when(F.abs(x) < 1e9, F.least(F.greatest(F.rint(x), F.lit(float(LEAST_SCORE))), F.lit(float(MOST_SCORE))).cast("int"))

    claim = _text(obj, "$.claim")
    made = F.struct(claim.alias("claim"), _text(obj, "$.rationale").alias("rationale"), evidence.alias("expected_evidence"), _text(obj, "$.falsifier").alias("falsifier"), *[score(s).alias(s) for s in SCORES])
    return F.when(obj.isNotNull() & (claim != ""), made)


def verdict(answer: Column) -> Column:
    """struct(verdict, reason); null unless the verdict is one of VERDICTS."""

    def said(obj: Column) -> Column:
        word = F.lower(_text(obj, "$.verdict"))
        return F.when(obj.isNotNull() & word.isin(*VERDICTS), F.struct(word.alias("verdict"), _text(obj, "$.reason").alias("reason")))

    return _once(json_object(answer), said)
