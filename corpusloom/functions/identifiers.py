"""Identifiers of papers as column expressions. A missing identifier is null, and comparisons with it are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_width


def _found(value: Column) -> Column:
    return F.when(value != "", value)


def _unversioned(doi: Column) -> Column:
    return F.regexp_replace(doi, r"(?<=[0-9])\.?v[0-9]+$", "")


def normalize_doi(raw: Column) -> Column:
    """Canonical DOI in any text: lower case, no wrapping, no final punctuation, no version after a digit."""
    body = F.lower(F.regexp_extract(fold_width(raw), r"(?i)(10\.[0-9]{4,9}/\S+)", 1))
    return _found(_unversioned(F.regexp_replace(body, r"[)\]>,.;:!?'\"\s]+$", "")))


def leading_doi(raw: Column) -> Column:
    """The DOI that a field starts with, up to a space or closing bracket, so that the rest of a link behind it goes."""
    return _found(F.regexp_extract(F.lower(F.trim(raw)), r"^(10\.[0-9]{4,9}/[^\s)\]]+)", 1))


def lenient_doi(raw: Column) -> Column:
    """DOI of a field that should hold one: prefix and final punctuation cut, nothing searched."""
    s = F.regexp_replace(F.lower(F.trim(raw)), r"^https?://(dx\.)?doi\.org/", "")
    return _found(_unversioned(F.regexp_replace(F.regexp_replace(s, r"^doi:\s*", ""), r"[/.,;)]+$", "")))


def extract_doi(raw: Column) -> Column:
    """The longest plausible DOI of a mangled text."""
    runs = F.regexp_extract_all(fold_width(F.coalesce(raw, F.lit(""))), F.lit(r"10\.[0-9]{4,5}/[^\s\"'`*\]]+"), F.lit(0))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[?&].*$", ""), r"<[a-zA-Z/][^>]*>.*$", ""), r"[.,;)>]+$", ""), r"/-?/DC[0-9]+$", "")
    tail = lambda c: F.regexp_replace(c, r"^[^/]*/", "")
    good = F.filter(F.transform(runs, tidy), lambda c: (F.length(tail(c)) >= 5) & ~F.lower(tail(c)).isin("journal", "journal."))
    longest = F.array_max(F.transform(good, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("c"))))
    return longest["c"]


def normalize_arxiv(raw: Column) -> Column:
    new = F.regexp_extract(raw, r"([0-9]{4}\.[0-9]{4,5})", 1)
    return F.coalesce(_found(new), _found(F.lower(F.regexp_extract(raw, r"(?i)([a-z\-]+/[0-9]{7})", 1))))


def normalize_pmid(raw: Column) -> Column:
    return _found(F.regexp_extract(F.trim(raw), r"(?i)^\s*(?:pmid[:\s]*)?([0-9]{1,9})\s*$", 1))


def normalize_pmcid(raw: Column) -> Column:
    digits = _found(F.regexp_extract(raw, r"(?i)\bPMC\s?([0-9]{5,9})\b", 1))
    return F.concat(F.lit("PMC"), digits)


def detect_identifier(raw: Column) -> Column:
    """struct(kind, id): DOI before arXiv before PMCID before PMID."""
    doi, arxiv, pmcid, pmid = normalize_doi(raw), normalize_arxiv(raw), normalize_pmcid(raw), normalize_pmid(raw)
    kind = F.when(doi.isNotNull(), "doi").when(arxiv.isNotNull(), "arxiv").when(pmcid.isNotNull(), "pmcid").when(pmid.isNotNull(), "pmid").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.coalesce(doi, arxiv, pmcid, pmid).alias("id"))


def doi_agree(a: Column, b: Column, least: int = 8, normalized: bool = False) -> Column:
    """Whether two DOIs are the same or one is the other cut short; null if either is missing. normalized: they are so already."""
    x, y = (a, b) if normalized else (normalize_doi(a), normalize_doi(b))
    bare = lambda d: F.regexp_replace(d, r"(?<=[0-9])[._-]?v[0-9]+$", "")
    short = F.when(F.length(bare(x)) <= F.length(bare(y)), bare(x)).otherwise(bare(y))
    long = F.when(F.length(bare(x)) <= F.length(bare(y)), bare(y)).otherwise(bare(x))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).otherwise((x == y) | (long.startswith(short) & (F.length(short) >= least)))


def is_doi_like(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^10\.[0-9]{4,}/"), F.lit(False))


def scan_identifiers(text: Column, head: int = 6000) -> Column:
    """struct(doi, pmid, pmcid, year) of labelled identifiers near the start, where front matter stands."""
    t = F.substring(text, 1, head)
    return F.struct(
        normalize_doi(_found(F.regexp_extract(t, r"(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)(10\.\S+)", 1))).alias("doi"),
        _found(F.regexp_extract(t, r"PMID:\s*([0-9]+)", 1)).alias("pmid"),
        _found(F.regexp_extract(t, r"PMCID:\s*(PMC[0-9]+)", 1)).alias("pmcid"),
        _found(F.regexp_extract(t, r"\b(19[0-9]{2}|20[0-9]{2})\b", 1)).alias("year"),
    )
