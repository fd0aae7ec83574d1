"""Surnames in registry records and in citations: a finite-state fold over the words of a name, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash

#: Words that lead a surname.
PARTICLES = ("de", "van", "von", "der", "den", "del", "della", "di", "da", "la", "le", "du", "ter", "ten", "op", "'t")
#: Initials; what stands for further authors, between two authors, and after the names of a citation.
INITIALS = r"^[A-Z]{1,3}\.?$"
OTHERS, JOINED, REST = r"\bet\s+\.?\s*al\.?", r"\s+and\s+|\s*&\s+", r",.*$"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _parts(text: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(text, by), lambda x: F.trim(x)), lambda x: x != "")


def _is_particle(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^\.+|\.+$", "")).isin(*PARTICLES)


def _read(words: Column, keep_last: bool) -> Column:
    """struct(led, head) after a fold over words: particles are gathered until the first other word, which is the head; what follows is not read.

    With keep_last the last word is the head even if it is a particle.
    """
    start = F.struct(F.lit("").alias("led"), F.lit(None).cast("string").alias("head"))
    indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), (F.lit(keep_last) & (i == F.size(words) - 1)).alias("last")))

    def step(state: Column, x: Column) -> Column:
        leads = _is_particle(x["w"]) & ~x["last"]
        return (
            F.when(state["head"].isNotNull(), state)
            .when(leads, F.struct(F.concat(state["led"], x["w"]).alias("led"), F.lit(None).cast("string").alias("head")))
            .otherwise(F.struct(state["led"].alias("led"), x["w"].alias("head")))
        )

    return F.aggregate(indexed, start, step)


def segment_surnames(segment: Column) -> Column:
    """Surnames that one author's segment stands for: 'Surname, Given', 'Surname XY', 'De Rooij F', 'Surname'.

    A surname with particles stands in full and by its head; particles before initials go with these; particles alone count by the first.
    """
    words = _parts(F.substring_index(_squeezed(segment), ",", 1), " ")
    read = _read(words, False)
    full, head = squash(F.concat(read["led"], read["head"])), squash(read["head"])
    forms = F.when(read["head"].isNull(), F.array(squash(words[0]))).when((read["led"] == "") | read["head"].rlike(INITIALS), F.array(full)).otherwise(F.array(full, head))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.filter(forms, lambda s: F.length(s) > 1))


def registry_authors(authors: Column) -> Column:
    """struct(first, surnames, ok) of a registry's authors: segments between semicolons, or every other part between commas (names alternate with given names), or one name."""
    a = _squeezed(authors)
    segments = F.when(a.contains(";"), _parts(a, ";")).when(a.contains(","), F.filter(_parts(a, ","), lambda _, i: i % 2 == 0)).otherwise(_parts(a, ";"))
    found = F.flatten(F.transform(segments, segment_surnames))
    return F.struct(F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first"), F.array_distinct(found).alias("surnames"), (F.size(found) > 0).alias("ok"))


def target_authors(cited: Column) -> Column:
    """struct(primary, secondary) of a citation's authors: 'Daniel and Reynolds', 'van der Meer et al.', 'Smith & Jones, 2004'; empty where there is none.

    A part that leaves less than two letters doesn't count, and the next takes its place.
    """
    a = F.regexp_replace(_squeezed(cited), OTHERS, "")
    a = F.regexp_replace(F.regexp_replace(a, JOINED, " § "), REST, "")
    parts = F.slice(_parts(a, " § "), 1, 2)

    def surname(part: Column) -> Column:
        read = _read(_parts(part, " "), True)
        return squash(F.concat(read["led"], read["head"]))

    names = F.filter(F.transform(parts, surname), lambda s: F.length(s) > 1)
    at = lambda i: F.coalesce(F.get(names, F.lit(i)), F.lit(""))
    return F.struct(at(0).alias("primary"), at(1).alias("secondary"))


def filename_surname(name: Column) -> Column:
    """The surname that a file's name begins with: 'Name et al. - ...' or 'Name_2020_...'; empty if none."""
    base = F.regexp_replace(name, r"\.md$", "")
    forms = [r"^\s*([A-Za-zÀ-ÿ'\-]+)(?:\s+et\s+al\.)?\s*-", r"^\s*([A-Za-zÀ-ÿ'\-]+)_[0-9]{4}_"]
    found = [F.when(base.rlike(f), squash(F.regexp_extract(base, f, 1))) for f in forms]
    return F.coalesce(F.when(F.length(F.coalesce(*found)) > 1, F.coalesce(*found)), F.lit(""))
