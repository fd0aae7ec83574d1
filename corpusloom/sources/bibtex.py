"""BibTeX files: braces nest, so entries are cut by a small scanner in an Arrow function; the rest is expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
FIELD = re.compile(r"(\w+)\s*=\s*", re.ASCII)


def value_at(text: str, at: int) -> tuple[str, int]:
    """The braced, quoted or bare value at a place, and where it ends."""
    if at < len(text) and text[at] == "{":
        depth = 0
        for i in range(at, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                return text[at + 1 : i], i + 1
        return text[at + 1 :], len(text)
    if at < len(text) and text[at] == '"':
        end = text.find('"', at + 1)
        return (text[at + 1 : end], end + 1) if end >= 0 else (text[at + 1 :], len(text))
    m = re.compile(r"[^,}\n]*").match(text, at)
    return m[0].strip(), m.end()


def entries(text: str) -> list[dict]:
    """kind, key and the fields of every entry; year falls back to the date, names lose their braces."""
    found, starts = [], list(ENTRY.finditer(text))
    for m, following in zip(starts, [*starts[1:], None]):
        body, fields, at = text[m.end() : following.start() if following else len(text)], {}, 0
        while f := FIELD.search(body, at):
            value, at = value_at(body, f.end())
            fields.setdefault(f[1].lower(), re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")).strip())
        year = fields.get("year") or (re.search(r"\d{4}", fields.get("date", "")) or re.search(r"(?:19|20)\d{2}", m[2]) or [""])[0]
        found.append({"kind": m[1].lower(), "key": m[2], "title": fields.get("title"), "author": fields.get("author"), "year": year or None, "doi": fields.get("doi"), "journal": fields.get("journal") or fields.get("journaltitle"), "abstract": fields.get("abstract")})
    return found


FIELDS = "kind string, key string, title string, author string, year string, doi string, journal string, abstract string"


def parse(files: DataFrame, text: str = "text") -> DataFrame:
    """One row for each entry of each file's text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([entries(t or "") for t in texts])

    kind = f"array<struct<{FIELDS.replace(' string', ': string')}>>"
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.explode(F.pandas_udf(run, kind)(F.col(text))).alias("e")).select(*rest, "e.*")
