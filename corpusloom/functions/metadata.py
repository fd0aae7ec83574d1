"""Metadata of papers read from texts, file names and model answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import normalize_doi
from .text import CJK_RUN
from .titles import title_tokens

#: The labels of a front-matter block in their order, what starts a line that is no title, where a text tells its year, section heads.
FRONT = ("Title", "Authors", "Year", "Journal", "doi", "PMID", "PMCID")
FRONT_BLOCK = r"(?md)\A\s*^(?:Title|Authors|Year|Journal|doi|PMID|PMCID|BibKey):.*(?:\n(?:(?:Title|Authors|Year|Journal|doi|PMID|PMCID|BibKey):.*|\s*))*\n*"
NO_TITLE = ("Title:", "Authors:", "Year:", "Journal:", "doi:", "PMID:", "PMCID:", "BibKey:", "#")
YEAR_NEAR = r"(?is)(?:©|Copyright|published|received|preprint|Cite this as).{0,40}?(19[0-9]{2}|20[0-3][0-9])"
PREPRINT_YEAR = r"10\.1101/(19[0-9]{2}|20[0-3][0-9])"
ABSTRACT = r"(?is)##\s*\*?\*?(?:Abstract|Summary|Background|Introduction|Research\s+briefing)[:\s]*\n*(.*?)(?=\n##\s|\z)"
SECTION_HEAD = (
    r"(?i)^([0-9]+[.)]?\s+)?(material and methods?|methods?|results?|introduction|abstract|discussion|conclusions?|references?|experimental( procedures| section)?|background|related work|"
    r"acknowledg(e)?ments?|supplementary (materials?|data|information)|abstracts?|author contributions?|declaration of interests?|funding|supporting information|appendix|glossary|abbreviations?)\s*$"
)
FAKE_DOI = (r"\(SICI\)", r"^BibKey:", r"https?://", r"^doi:\s*10\.\S+[<>]")
MOST_AUTHORS, META_CHARS = 5, 2000


def some(c: Column) -> Column:
    """Null where empty."""
    return F.when(c != "", c)


def front_matter(text: Column) -> Column:
    """struct(title, authors, year, journal) of labelled lines anywhere in a text."""
    pick = lambda rule: some(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rule, 1)))
    return F.struct(pick(r"(?md)^Title:\s*(.+)$").alias("title"), pick(r"(?md)^Authors?:\s*(.+)$").alias("authors"), pick(r"(?md)^Year:\s*([0-9]{4})").alias("year"), pick(r"(?md)^Journal:\s*(.+)$").alias("journal"))


def from_filename(name: Column) -> Column:
    """struct(year, journal, title) of 'Lastname_Year_Journal_Title'; a single part after the year is the title."""
    rule = r"^(?:[\w\-.]+?)[_\s]+((?:19|20)[0-9]{2})[_\s]+(.*)$"
    parts = F.filter(F.transform(F.split(F.regexp_extract(name, rule, 2), "_"), lambda x: F.trim(x)), lambda x: x != "")
    many = F.size(parts) >= 2
    return F.struct(some(F.regexp_extract(name, rule, 1)).alias("year"), F.when(many, F.element_at(parts, 1)).alias("journal"), F.when(many, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ")).when(F.size(parts) == 1, F.element_at(parts, 1)).alias("title"))


def format_front_matter(fields: dict[str, Column]) -> Column:
    """The block of non-empty fields, one a line and an empty line after them; a doi has no space before it. fields by label."""
    line = lambda f: F.when(F.trim(F.coalesce(fields[f], F.lit(""))) != "", F.concat(F.lit(f + ":" + ("" if f == "doi" else " ")), F.trim(fields[f])))
    block = F.concat_ws("\n", *[line(f) for f in FRONT if f in fields])
    return F.when(block != "", F.concat(block, F.lit("\n\n"))).otherwise("")


def strip_front_matter(text: Column) -> Column:
    """Without the leading block."""
    return F.regexp_replace(F.regexp_replace(text, FRONT_BLOCK, ""), r"\A\n+", "")


def upsert_front_matter(text: Column, fields: dict[str, Column]) -> Column:
    """The text with its leading block replaced; unchanged without fields."""
    block = format_front_matter(fields)
    return F.when(block == "", text).otherwise(F.concat(block, strip_front_matter(text)))


def extract_meta(text: Column, name: Column) -> Column:
    """struct(title, year, journal, doi, pmid, pmcid) of a text: the first line as the title if it is plausible, else the file's stem; the first year; a
    journal in front of a year; labelled identifiers."""
    pick = lambda rule: F.regexp_extract(text, rule, 1)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    labelled = first.startswith(NO_TITLE[0])
    for label in NO_TITLE[1:]:
        labelled = labelled | first.startswith(label)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^./]*$", ""), r"^[+^\s]+", ""), r"\.pdf$", "")
    title = F.when((F.length(first) > 20) & (F.length(first) < 300) & ~labelled, first).when((F.length(stem) > 10) & (F.length(stem) <= 200), stem).otherwise("")
    return F.struct(
        title.alias("title"), pick(r"\b(19[0-9]{2}|20[0-9]{2})\b").alias("year"), F.trim(pick(r"(?md)^([A-Z][A-Za-z\s&.]+)\s*\.?\s*[0-9]{4}")).alias("journal"),
        pick(r"(?:doi:|DOI:|https?://doi\.org/)(10\.\S+)").alias("doi"), pick(r"PMID:\s*([0-9]+)").alias("pmid"), pick(r"PMCID:\s*(PMC[0-9]+)").alias("pmcid"),
    )


def year_from_content(sections: Column) -> Column:
    """The publication year that the first of a paper's sections (an array of texts) tells near a copyright or date word, else in a preprint's DOI; null if none."""
    year = lambda c: F.coalesce(some(F.regexp_extract(c, YEAR_NEAR, 1)), some(F.regexp_extract(c, PREPRINT_YEAR, 1)))
    return F.get(F.filter(F.transform(sections, lambda c: year(F.substring(c, 1, 2000))), lambda y: y.isNotNull()), F.lit(0))


def abstract_of(sections: Column, least: int = 100) -> Column:
    """The first section under an abstract-like heading of more than ``least`` characters; empty if none."""
    found = F.filter(F.transform(sections, lambda c: F.trim(F.regexp_replace(F.regexp_extract(c, ABSTRACT, 1), r"\A\s+|\s+\z", ""))), lambda x: F.length(x) > least)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def title_from_content(sections: Column) -> Column:
    """A plausible title in the first three sections: the first heading, else the first bold line, that has three words and is no section's head; empty if none."""
    lines = F.flatten(F.transform(F.slice(sections, 1, 3), lambda c: F.transform(F.split(c, "\n"), lambda x: F.trim(x))))
    plausible = lambda s: (F.size(title_tokens(F.regexp_replace(s, r"\*+", ""))) >= 3) & ~F.trim(F.regexp_replace(s, r"\*+", "")).rlike(SECTION_HEAD)
    pick = lambda rule: F.get(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, rule, 1))), lambda s: (s != "") & plausible(s)), F.lit(0))
    return F.coalesce(pick(r"^#{1,6}\s*\*{0,2}(.+?)\*{0,2}\s*$"), pick(r"^\*\*(.+)\*\*$"), F.lit(""))


def pmid_from_filename(name: Column) -> Column:
    return some(F.regexp_extract(name, r"^([0-9]{6,9})(?:_md)?\.json$", 1))


def doi_from_filename(name: Column) -> Column:
    """The DOI that a file name escapes: _2F is a slash and _ a point; without _2F the second _ is the slash."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.json$", ""), "_md$", "")
    marked = F.replace(F.replace(stem, F.lit("_2F"), F.lit("/")), F.lit("_"), F.lit("."))
    plain = F.concat(F.lit("10."), F.regexp_extract(stem, r"^10_([^_]*)_", 1), F.lit("/"), F.replace(F.regexp_extract(stem, r"^10_[^_]*_(.*)$", 1), F.lit("_"), F.lit(".")))
    return F.when(~stem.rlike("^10_"), F.lit(None)).when(stem.contains("2F"), marked).when(stem.rlike("^10_[^_]*_"), plain)


def is_fake_doi(doi: Column) -> Column:
    return F.coalesce(doi.rlike("|".join(f"(?:{x})" for x in FAKE_DOI)), F.lit(False))


def author_tokens(authors: Column) -> Column:
    """Names of the first MOST_AUTHORS entries between ; and , as one string."""
    entries = F.slice(F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != ""), 1, MOST_AUTHORS)
    return F.array_join(F.filter(F.flatten(F.transform(entries, lambda e: F.split(e, r"[,\s]+"))), lambda t: t != ""), " ")


def metadata_text(title: Column, authors: Column, journal: Column, year: Column) -> Column:
    """What the metadata channel searches: title, author names, journal and year in META_CHARS characters."""
    parts = [some(title), some(author_tokens(authors)), some(journal), some(year.cast("string"))]
    return F.substring(F.concat_ws(" ", *parts), 1, META_CHARS)


def queries_of(answer: Column) -> Column:
    """The queries in a model's answer: a JSON list, or an object's 'queries', bare, fenced, or the outermost object amid prose; empty if nothing parses."""
    raw = F.trim(F.coalesce(answer, F.lit("")))
    raw = F.when(raw.startswith("```"), F.regexp_replace(F.regexp_replace(raw, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")).otherwise(raw)
    clean = lambda xs: F.filter(F.transform(xs, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    tries = [F.from_json(F.get_json_object(raw, "$.queries"), "array<string>"), F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.from_json(F.get_json_object(inner, "$.queries"), "array<string>")]
    return F.coalesce(*[F.when(F.size(clean(t)) > 0, clean(t)) for t in tries], F.array().cast("array<string>"))


def classes_of(answer: Column) -> Column:
    """map of paper number to 'type: topic, topic' in a model's answer, row by row, so that a broken answer gives the rows it still has."""
    number, value = (F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r'"([0-9]+)"\s*:\s*"([^"{}]+?)"'), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(number.alias("k"), value.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].cast("int").alias("k"), p["v"].alias("v"))))


#: What a paper can be.
TYPES = ("review", "experimental", "methods")


def class_entry(value: Column) -> Column:
    """struct(article_type, topics) of 'type: topic, topic': at most five topics in lower case; null if the type is unknown or no topic is named."""
    kind = F.lower(F.trim(F.substring_index(value, ":", 1)))
    topics = F.slice(F.filter(F.transform(F.split(F.regexp_extract(value, r"(?s)^[^:]*:(.*)$", 1), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""), 1, 5)
    return F.when(value.contains(":") & kind.isin(*TYPES) & (F.size(topics) > 0), F.struct(kind.alias("article_type"), topics.alias("topics")))


def scoped_query(topic: Column, hints: list[Column]) -> Column:
    """The topic and those hints, in order, that bring a word not seen before; generic and all say nothing."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    out, seen = topic, words(topic)
    for h in hints:
        new = F.coalesce((h != "") & ~h.isin("generic", "all") & (F.size(F.array_except(words(h), seen)) > 0), F.lit(False))
        out, seen = F.when(new, F.concat_ws(" ", out, h)).otherwise(out), F.when(new, F.array_union(seen, words(h))).otherwise(seen)
    return out


def focus_tokens(text: Column) -> Column:
    """Distinct words of three characters or more, hyphens inside."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]{2,}"), F.lit(0)))


def focus_overlap(question: Column, text: Column) -> Column:
    """Share of a question's focus tokens that a text has; 0 without any."""
    q = focus_tokens(question)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, focus_tokens(text))) / F.size(q))


def clean_sentence(text: Column, least: int = 40) -> Column:
    """The first sentence of prose: without list marks, of ``least`` characters or more, ending as a sentence, mostly letters, not all capitals; empty if none."""
    bare = lambda s: F.regexp_replace(F.trim(s), r"^\s*(?:[#>\-*•]+\s*|[0-9]+[.)\]]\s*)+", "")
    letters = lambda s: F.length(F.regexp_replace(s, r"[^\p{L}]", "")) / F.length(s)
    good = lambda s: (F.length(s) >= least) & s.rlike(r"[.!?][\"')\]]?$") & (letters(s) >= 0.55) & (F.upper(s) != s)
    # what is too short before its marks go is too short after; behind the first good one nothing is looked at
    clean = lambda s: F.element_at(F.transform(F.array(bare(s)), lambda b: F.when(good(b), b).otherwise("")), 1)
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    return F.aggregate(parts, F.lit(""), lambda found, s: F.when((found != "") | (F.length(s) < least), found).otherwise(clean(s)))


def fts_terms(query: Column) -> tuple[Column, Column]:
    """(terms, runs): a query's words without search syntax, hyphenated ones in quotes, and its runs of CJK ideographs."""
    latin = F.regexp_replace(F.regexp_replace(F.coalesce(query, F.lit("")), CJK_RUN, " "), r'["^{}()\[\]*:]', " ")
    terms = F.transform(F.filter(F.split(latin, r"\s+"), lambda t: t != ""), lambda t: F.when(t.contains("-"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return terms, F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(CJK_RUN), F.lit(0))


PROSE = r"(?<![^.!?\n])[^.!?\n]{40,}+[.!?]"  # from the start of a run only, so that a run without an end is read once
#: The four ways to cut a text into sentences: at ends, at ends before a capital or digit, at full stops, and prose of forty characters.
SENTENCE_CUTS = {"ends": r"(?<=[.!?])\s+", "starts": r"(?<=[.!?])\s+(?=[A-Z0-9])", "stops": r"\. "}


def sentences_by(text: Column, way: str) -> Column:
    """Sentences of a text by one of SENTENCE_CUTS, or 'prose'."""
    if way == "prose":
        return F.regexp_extract_all(text, F.lit(PROSE), F.lit(0))
    return F.split(text, SENTENCE_CUTS[way])


def same_doi(a: Column, b: Column) -> Column:
    return normalize_doi(a) == normalize_doi(b)
