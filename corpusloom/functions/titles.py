"""Titles, names and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents, squash

#: What can never be a title.
JUNK_TITLES = (
    r"^https?://", r"^www\.", r"^pubs\.acs\.org", r"^10\.[0-9]",
    r"^(research|review|original|rapid|full\s+length)?\s*(article|paper|communication)\s*$",
    r"^case\s+report\s*$", r"^editorial\s*$",
    r"^received:.*accepted", r"^editorial board", r"^contents",
    r"^open access", r"^online access available",
    r"^sciencedirect", r"^elsevier", r"^this article has been retracted",
    r"^retraction", r"^table\s+[0-9]", r"^fig(ure)?\.?\s*[0-9]",
    r"^answers?\s+to", r"^accepted (author )?manuscript",
    r"^author['’]?s accepted manuscript",
)
VOLUME_PAGE = r"[0-9]+\s*\(\s*[0-9]+\s*\)\s*[:\-]?\s*[0-9]+"


def title_tokens(title: Column) -> Column:
    """Distinct accent-free alphanumeric tokens of more than two characters."""
    t = F.regexp_extract_all(F.lower(fold_accents(F.coalesce(title, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(t, lambda x: F.length(x) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1.0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column, by=F.greatest) -> Column:
    """Shared share of the larger set (by=F.greatest) or the smaller one (by=F.least); 0.0 if either is empty."""
    low = F.least(F.size(a), F.size(b))
    return F.when(low == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / by(F.size(a), F.size(b)))


def blended_similarity(a: Column, b: Column) -> Column:
    """Half Jaccard, half containment in the smaller title."""
    return 0.5 * jaccard(a, b) + 0.5 * overlap(a, b, F.least)


def prefix_similarity(claimed: Column, result: Column, accept: float = 0.8) -> Column:
    """Recall of the claimed title's first 60 characters if it is at least ``accept`` at a precision of 0.5, else Jaccard."""
    a, b = title_tokens(F.substring(claimed, 1, 60)), title_tokens(F.substring(result, 1, 60))
    both = F.size(F.array_intersect(a, b))
    recall, precision = both / F.size(a), both / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when((recall >= accept) & (precision >= 0.5), recall).otherwise(jaccard(a, b))


def is_junk_title(title: Column, search: bool = False) -> Column:
    """Whether a title carries no bibliographic signal; search=True also rejects markup and capitals."""
    t = F.coalesce(title, F.lit(""))
    low = F.lower(F.trim(F.regexp_replace(t, r"[*_`#]", "")))
    junk = (F.trim(t) == "") | low.rlike("|".join(JUNK_TITLES)) | (F.size(title_tokens(low)) < 3) | t.rlike(VOLUME_PAGE)
    if search:
        words = F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2)
        upper = F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
        junk = junk | t.rlike(r"[*`\[\]#]") | ((F.size(words) > 2) & (upper >= F.size(words) - 1))
    return junk


def looks_like_filename(title: Column) -> Column:
    return F.coalesce(title.rlike(r"(?i)\.(pdf|md|txt|docx?)$") | (title.contains("_") & ~title.contains(" ")), F.lit(False))


def is_junk_journal(journal: Column) -> Column:
    """Missing, with a line break, too short or long, or starting in lower case."""
    return F.coalesce(journal.contains("\n") | (F.length(journal) < 4) | (F.length(journal) > 80) | journal.rlike("^[a-z]"), F.lit(True))


def is_junk_year(year: Column) -> Column:
    y = F.expr("try_cast(NULL AS INT)") if year is None else year.try_cast("int")
    return F.coalesce((y < 1900) | (y > 2035), F.lit(True))


def strip_author_year(title: Column) -> Column:
    """Without a leading 'Name et al. - 2020 - ', 'Name - 2020 - ' or '2020 - '; empty for an address."""
    t = F.coalesce(title, F.lit(""))
    group = lambda rule, g: F.trim(F.regexp_extract(t, rule, g))
    et_al = r"^(.+?)\s+et\s+al\.?\s*-\s*(?:[0-9]{4}\s*-\s*)?(.+)$"
    name = r"^[A-Za-z][A-Za-z0-9_-]+\s*-\s*(?:[0-9]{4}\s*-\s*)?(.+)$"
    year = r"^[0-9]{4}\s*-\s*(.+)$"
    return F.when(t.startswith("http"), "").when(t.rlike(et_al), group(et_al, 2)).when(t.rlike(name), group(name, 1)).when(t.rlike(year), group(year, 1)).otherwise(F.trim(t))


def filename_key(name: Column) -> Column:
    """struct(lastname, year, title) of 'Name_et_al__-_2020_Title', 'Name_2020_Title' or 'Name_2020'; null otherwise."""
    forms = (r"^([\w-]+?)_et_al__-_-?([0-9]{4})_(.+)$", r"^([\w-]+?)_([0-9]{4})_(.+)$", r"^([\w-]+?)_([0-9]{4})()$")
    out = F.lit(None).cast("struct<lastname: string, year: string, title: string>")
    for form in reversed(forms):
        last = F.regexp_replace(F.lower(F.regexp_extract(name, form, 1)), r"_and_.*$", "")
        out = F.when(name.rlike(form), F.struct(last.alias("lastname"), F.regexp_extract(name, form, 2).alias("year"), F.substring(squash(F.regexp_extract(name, form, 3)), 1, 25).alias("title"))).otherwise(out)
    return out


def author_lastname(authors: Column) -> Column:
    """Last name of the first author of 'Last, First; ...', 'Last F, ...' or 'First Last and ...'."""
    first = F.trim(F.element_at(F.split(F.coalesce(authors, F.lit("")), r";| and "), 1))
    comma = F.trim(F.element_at(F.split(first, ","), 1))
    words = F.split(comma, r"\s+")
    initials = F.element_at(words, -1).rlike(r"^[A-Z]{1,3}\.?$") & (F.size(words) > 1)
    return F.when(first == "", F.lit(None)).when(first.contains(",") & ~comma.contains(" "), comma).when(initials, F.element_at(words, 1)).otherwise(F.element_at(words, -1))


def authors_quality(authors: Column) -> Column:
    """missing, initials_only, partial or ok."""
    names = F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    full = F.size(F.filter(names, lambda x: x.rlike(r"\p{L}{2,}.*[,\s]+\p{L}{2,}")))
    return F.when(F.size(names) == 0, "missing").when(full == 0, "initials_only").when(full < F.size(names), "partial").otherwise("ok")


def citation_string(authors: Column, year: Column) -> Column:
    """(Surname, 2020), (Surname et al., 2020), n.d. where the year is missing."""
    n = F.size(F.filter(F.split(F.coalesce(authors, F.lit("")), r";| and "), lambda x: F.trim(x) != ""))
    name = F.coalesce(author_lastname(authors), F.lit("Anonymous"))
    return F.concat(F.lit("("), name, F.when(n > 2, " et al.").otherwise(""), F.lit(", "), F.coalesce(F.when(year != "", year), F.lit("n.d.")), F.lit(")"))


def bibtex_key(authors: Column, year: Column, title: Column) -> Column:
    """lastname_year_firstword in lower case."""
    first = F.regexp_extract(F.lower(fold_accents(F.coalesce(title, F.lit("")))), r"([a-z0-9]{4,})", 1)
    return F.concat_ws("_", F.coalesce(F.when(squash(author_lastname(authors)) != "", squash(author_lastname(authors))), F.lit("anon")), F.coalesce(F.when(year != "", year), F.lit("nd")), F.when(first != "", first))
