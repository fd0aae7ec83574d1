"""Metadata quality: identity, voting, repair, retraction, drift and health, as column pipelines over registry snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import titles as tt
from corpusloom.functions.identifiers import normalize_doi
from corpusloom.operators.retrieve import top_k

FIELDS = ("title", "authors", "year", "journal", "doi", "pmid", "pmcid")
FAMILIES = ("crossref", "pubmed", "openalex", "library")


def field_merge(local: DataFrame, registry: DataFrame, key: str, junk: dict[str, Column]) -> DataFrame:
    """local's fields, replaced by the registry's where they are junk and filled where they are missing. registry has r_<field>."""
    out = local.join(registry, key, "left")
    for field, bad in junk.items():
        out = out.withColumn(field, F.when(F.coalesce(bad, F.lit(True)), F.coalesce(f"r_{field}", field)).otherwise(F.col(field)))
    return out.select(*local.columns)


def overlay(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with changed fields overlaid, and one row with how often each field changed. new: key and n_<field>."""
    both = old.join(new, key, "left")
    differs = {f: F.col(f"n_{f}").isNotNull() & ~F.col(f"n_{f}").eqNullSafe(F.col(f)) for f in fields}
    counts = both.agg(*[F.count_if(c).alias(f) for f, c in differs.items()])
    return both.select(*[F.coalesce(f"n_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns]), counts


def vote(rows: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """key, value, votes, confidence: each source family votes once for a value; ties go to the family named first."""
    order = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family"))
    once = rows.filter("value is not null").groupBy("key", "family", "value").agg(F.count("*").alias("_n"))
    counted = once.groupBy("key", "value").agg(F.count("*").alias("votes"), F.min(F.when(order > 0, order).otherwise(len(families) + 1)).alias("first"))
    best = top_k(counted, 1, ["key"], [F.col("votes").desc(), F.col("first"), F.col("value")])
    return best.select("key", "value", "votes", F.when(F.col("votes") >= 3, "high").when(F.col("votes") == 2, "medium").otherwise("low").alias("confidence"))


def identity_flags(claimed: Column, found: Column, claimed_year: Column, found_year: Column, claimed_name: Column, found_name: Column) -> Column:
    """What speaks against a registry hit: a far title, a year more than two off, another surname unless the titles agree."""
    j = tt.jaccard(tt.title_tokens(claimed), tt.title_tokens(found))
    part = F.lower(claimed).contains(F.lower(found)) | F.lower(found).contains(F.lower(claimed))
    name = (tt.squash(claimed_name) != tt.squash(found_name)) & (j < 0.5) & ~F.coalesce(part, F.lit(False))
    return F.filter(F.array(F.when(j < 0.30, "title"), F.when(F.abs(claimed_year - found_year) > 2, "year"), F.when(name, "surname")), lambda x: x.isNotNull())


def swap_kind(title_similarity: Column, conflict: Column, support: Column, tokens: Column) -> Column:
    """meta_swap, content_swap or ok, of a name's similarity to the metadata and the text's support for the name."""
    supported = F.when(tokens >= 4, support >= 0.35).when(tokens == 3, support >= 0.67).otherwise(F.lit(False))
    return F.when((title_similarity < 0.30) & conflict, F.when(supported, "meta_swap").otherwise("content_swap")).otherwise("ok")


def content_support(name: Column, text: Column, head: int = 6000) -> Column:
    """Share of a file name's title words, plurals folded, that the start of the text has."""
    fold = lambda xs: F.array_distinct(F.transform(xs, lambda t: F.regexp_replace(t, "s$", "")))
    a, b = fold(tt.title_tokens(name)), fold(tt.title_tokens(F.substring(text, 1, head)))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def apply_fixes(meta: DataFrame, fixes: DataFrame, key: str = "source") -> DataFrame:
    """Fixes of at least medium confidence. An identity fix overwrites all fields, blanks too; others only fill in what they have.

    fixes: key, f_<field>, identity, confidence, origin. meta_provenance notes where a field came from.
    """
    both = meta.join(fixes.filter("confidence in ('medium', 'high')"), key, "left")
    use = lambda f: F.when(F.col("identity"), F.col(f"f_{f}")).otherwise(F.coalesce(F.when(F.col(f"f_{f}") != "", F.col(f"f_{f}")), F.col(f)))
    fields = [f for f in FIELDS if f in meta.columns]
    note = F.when(F.col("origin").isNotNull(), F.concat_ws("; ", *([F.col("meta_provenance")] if "meta_provenance" in meta.columns else []), F.concat(F.lit("fixed by "), F.col("origin"))))
    return both.select(key, *[F.when(F.col("origin").isNull(), F.col(f)).otherwise(use(f)).alias(f) for f in fields], note.alias("meta_provenance"))


def layers(candidates: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "source") -> DataFrame:
    """Each candidate from the first source that has it: every layer sees only what is left. sources: name, (key, value)."""
    left, out = candidates, None
    for name, found in sources:
        part = left.join(found, key).withColumn("layer", F.lit(name))
        left = left.join(found.select(key), key, "left_anti")
        out = part if out is None else out.unionByName(part)
    return out


def needs_repair(title: Column, year: Column, journal: Column, doi: Column) -> Column:
    """Names of the fields that a repair should look at."""
    return F.filter(F.array(F.when(tt.is_junk_title(title), "title"), F.when(tt.is_junk_year(year), "year"), F.when(tt.is_junk_journal(journal), "journal"), F.when(normalize_doi(doi).isNull(), "doi")), lambda x: x.isNotNull())


def year_ok(hit: Column, file_year: Column, text_year: Column) -> Column:
    """Whether a hit's year agrees with an anchor within a year; without any anchor it doesn't."""
    near = lambda a: F.abs(hit - a) <= 1
    return F.when(file_year.isNotNull(), near(file_year)).when(text_year.isNotNull(), near(text_year)).otherwise(F.lit(False))


def verify_status(rows: DataFrame, snapshot: DataFrame, doi: str = "doi") -> DataFrame:
    """rows with status hit, verified_absent or unknown. snapshot: doi, found (false: looked up and absent)."""
    return rows.join(snapshot.select(doi, "found"), doi, "left").withColumn("status", F.when(F.col("found"), "hit").when(~F.col("found"), "verified_absent").otherwise("unknown")).drop("found")


def retracted(papers: DataFrame, notices: DataFrame, doi: str = "doi") -> DataFrame:
    """papers with retracted: whether either column of a notice names their DOI. notices: retraction_doi, original_doi."""
    bad = notices.select(normalize_doi(F.col("retraction_doi")).alias("_d")).union(notices.select(normalize_doi(F.col("original_doi")))).filter("_d is not null").distinct().withColumn("retracted", F.lit(True))
    return papers.join(bad, normalize_doi(F.col(doi)) == F.col("_d"), "left").drop("_d").withColumn("retracted", F.coalesce("retracted", F.lit(False)))


SAME_PAPER = 0.6


def duplicate_verdicts(papers: DataFrame) -> DataFrame:
    """doi, n, verdict of DOIs that several papers carry. papers: key, doi, title.

    same-paper if the blended similarity of some two titles reaches SAME_PAPER, no-titles if fewer than two papers have a title, else CONFLICT. Equal token
    sets are one set that occurs twice. Of two other sets so alike the smaller shares that part of its tokens, so one of its rarest tokens within the DOI,
    as many as may be missing and one more, is in the larger: only such pairs are compared.
    """
    keyed = papers.filter("doi is not null").withColumn("_t", F.array_sort(tt.title_tokens(F.col("title")))).withColumn("_has", F.coalesce(F.col("title") != "", F.lit(False)))
    groups = keyed.groupBy("doi").agg(F.count("*").alias("n"), F.count_if("_has").alias("titled")).filter("n > 1")
    sets = keyed.filter(F.col("_has") & (F.size("_t") > 0)).join(groups.select("doi"), "doi", "left_semi").groupBy("doi", "_t").agg(F.count("*").alias("_m"))
    sets = sets.withColumn("_id", F.xxhash64("_t"))
    each = sets.select("doi", "_id", F.size("_t").alias("_s"), F.explode("_t").alias("tok"))
    rare = each.join(each.groupBy("doi", "tok").agg(F.count("*").alias("df")), ["doi", "tok"])
    place = F.row_number().over(Window.partitionBy("doi", "_id").orderBy("df", "tok"))
    first = rare.withColumn("_r", place).filter(F.col("_r") <= F.col("_s") - F.ceil(SAME_PAPER * F.col("_s") - 1e-9) + 1)
    pairs = first.select("doi", "tok", F.col("_id").alias("a"), F.col("_s").alias("sa")).join(each.select("doi", "tok", F.col("_id").alias("b"), F.col("_s").alias("sb")), ["doi", "tok"])
    pairs = pairs.filter((F.col("a") != F.col("b")) & (F.col("sa") <= F.col("sb"))).select("doi", "a", "b").distinct()
    of = lambda c: sets.select("doi", F.col("_id").alias(c), F.col("_t").alias(f"t{c}"))
    alike = pairs.join(of("a"), ["doi", "a"]).join(of("b"), ["doi", "b"]).filter(tt.blended_similarity(F.col("ta"), F.col("tb")) >= SAME_PAPER).select("doi")
    same = alike.union(sets.filter("_m > 1").select("doi")).distinct().withColumn("_same", F.lit(True))
    return groups.join(same, "doi", "left").select("doi", "n", F.when(F.col("titled") < 2, "no-titles").when(F.col("_same"), "same-paper").otherwise("CONFLICT").alias("verdict"))


def audit(papers: DataFrame, hits: DataFrame) -> DataFrame:
    """source, status, flags, kind, support, repair, confidence, agreeing: the audit of claimed metadata as one chain.

    papers: source, file_title, file_year, text, title, authors, year, journal, doi. hits: source, family, title, authors, year, doi (registry records; each family's votes once).
    A junk title gives way to the file's. The record that most families agree on by DOI is compared with the claim; without a record the paper is
    unverified. A paper whose file name and claim differ is a swap of metadata where its text supports the file name, else of content. status is fail with a swap or
    a flag, else pass.
    """
    claimed = papers.withColumn("_t", F.when(tt.is_junk_title(F.col("title")), F.col("file_title")).otherwise(F.col("title")))
    named = hits.select("source", "family", normalize_doi(F.col("doi")).alias("value"), F.col("title").alias("_title"), F.col("authors").alias("_authors"), F.col("year").alias("_year"))
    voted = vote(named.select(F.col("source").alias("key"), "family", "value")).select(F.col("key").alias("source"), "value", "votes", "confidence")
    record = named.join(voted, ["source", "value"]).groupBy("source", "votes", "confidence").agg(F.min(F.struct("family", "_title", "_authors", "_year")).alias("r")).select("source", "votes", "confidence", "r.*")
    both = claimed.join(record, "source", "left")
    flags = F.when(F.col("votes").isNotNull(), identity_flags(F.col("_t"), F.col("_title"), F.col("year").try_cast("int"), F.col("_year").try_cast("int"), tt.author_lastname(F.col("authors")), tt.author_lastname(F.col("_authors")))).otherwise(F.array().cast("array<string>"))
    alike = tt.jaccard(tt.title_tokens(F.col("file_title")), tt.title_tokens(F.col("title")))
    conflict = F.coalesce(F.abs(F.col("year").try_cast("int") - F.col("file_year").try_cast("int")) > 1, F.lit(False))
    support = F.coalesce(content_support(F.col("file_title"), F.col("text")), F.lit(0.0))
    kind = swap_kind(alike, conflict, support, F.size(tt.title_tokens(F.col("file_title"))))
    out = both.select("source", flags.alias("flags"), kind.alias("kind"), F.round(support, 6).alias("support"), needs_repair(F.col("title"), F.col("year"), F.col("journal"), F.col("doi")).alias("repair"), F.coalesce("confidence", F.lit("none")).alias("confidence"), F.coalesce("votes", F.lit(0)).alias("agreeing"))
    status = F.when((F.col("kind") != "ok") | (F.size("flags") > 0), "fail").when(F.col("agreeing") == 0, "unverified").otherwise("pass")
    return out.select("source", status.alias("status"), "flags", "kind", "support", "repair", "confidence", "agreeing")


def check_duplicates(rows: DataFrame, column: str, name: str) -> DataFrame:
    c = rows.agg(F.count(column).alias("a"), F.count_distinct(column).alias("b"))
    return c.select(F.lit(name).alias("name"), F.when(F.col("a") == F.col("b"), "OK").otherwise("WARN").alias("status"), F.concat((F.col("a") - F.col("b")).cast("string"), F.lit(" repeated")).alias("message"))


def check_share(rows: DataFrame, bad: Column, name: str, warn: float = 0.0, fail: float = 1.0) -> DataFrame:
    """OK up to a share ``warn`` of bad rows, WARN up to ``fail``, FAIL beyond; an empty table is a WARN."""
    c = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("b"))
    share = F.col("b") / F.col("n")
    status = F.when(F.col("n") == 0, "WARN").when(share <= warn, "OK").when(share <= fail, "WARN").otherwise("FAIL")
    return c.select(F.lit(name).alias("name"), status.alias("status"), F.concat_ws(" of ", F.col("b").cast("string"), F.col("n").cast("string")).alias("message"))


def check_graph(edges: DataFrame, nodes: DataFrame, name: str = "reference graph") -> DataFrame:
    """FAIL without edges, WARN if ends of edges are no papers."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    lost = ends.join(nodes.select("node").distinct().withColumn("_k", F.lit(True)), "node", "left")
    c = lost.agg((F.count("*") / 2).cast("long").alias("e"), F.count_if(F.col("_k").isNull()).alias("x"))
    return c.select(F.lit(name).alias("name"), F.when(F.col("e") == 0, "FAIL").when(F.col("x") > 0, "WARN").otherwise("OK").alias("status"), F.concat(F.col("e").cast("string"), F.lit(" edges, "), F.col("x").cast("string"), F.lit(" unknown ends")).alias("message"))


def drift(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """key, only_in: keys that one of two indexes lacks."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    return both.filter("_l is null or _r is null").select(key, F.when(F.col("_r").isNull(), names[0]).otherwise(names[1]).alias("only_in"))


def parity(counts: DataFrame, a: str, b: str) -> Column:
    """OK if two counts differ by at most 50 or 2 percent, else WARN."""
    return F.when(F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(50), 0.02 * F.greatest(F.col(a), F.col(b))), "OK").otherwise("WARN")


def doctor(checks: list[DataFrame]) -> DataFrame:
    """One row a check (name, status, message); each check is a one-row frame of its own."""
    return reduce(DataFrame.unionByName, [c.select("name", "status", "message") for c in checks])


def remove_papers(table: DataFrame, patterns: list[str], key: str = "source", exact: bool = False) -> DataFrame:
    """The table without sources that equal or contain (any case) a pattern. Count the difference for a dry run."""
    gone = F.col(key).isin(*patterns) if exact else reduce(lambda a, b: a | b, [F.lower(key).contains(p.lower()) for p in patterns])
    return table.filter(~F.coalesce(gone, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """old without the sources of new, and new: running it twice changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_store(request: DataFrame, primary: DataFrame, disabled: DataFrame, key: str = "parent_id") -> DataFrame:
    """Request rows (key, pos) with content from the active store, else from the disabled one with a note."""
    out = request.join(primary.select(key, F.col("content").alias("_a")), key, "left").join(disabled.select(key, F.col("content").alias("_b")), key, "left")
    return out.select(key, "pos", F.coalesce("_a", "_b").alias("content"), F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), "paper_in_disabled_store").alias("note"))
