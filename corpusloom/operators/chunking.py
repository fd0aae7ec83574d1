"""Documents to parents (sections, captions) and overlapping children."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Section headers, captions, sizes.
SECTIONS = {
    "abstract": r"(?i)^#*\s*(ABSTRACT|SUMMARY)\s*$",
    "introduction": r"(?i)^#*\s*(INTRODUCTION|BACKGROUND)\s*$",
    "methods": r"(?i)^#*\s*(METHODS?|MATERIALS?|EXPERIMENTAL)[\s\-]*(and[\s\-]*(methods|materials|procedures|design)|(procedures|design|methods))?\s*$",
    "results": r"(?i)^#*\s*(RESULTS?|FINDINGS?)\s*$",
    "discussion": r"(?i)^#*\s*DISCUSSION\s*$",
    "conclusion": r"(?i)^#*\s*CONCLUSIONS?\s*$",
}
CAPTION = r"(?i)^(?:\*{0,2})(?:(?:Figure|Fig\.?|Table|Supplementary\s+(?:Figure|Table|S)\w*|Scheme)\s*([0-9]+[\w\.\-]*)|((?:S|SF|ST)[0-9]+))\s*[:.]\s*(.+)"
CHILD_SIZE, OVERLAP_WORDS, OVERLAP_CHARS, LEAST_PARENT, LONGEST_CAPTION = 500, 20, 100, 200, 1500
LONG_PARAGRAPH = 1.5  # times a child's size, from which a paragraph is cut into sentences


def lines_of(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def sections(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, section, content: the last non-empty stretch under each kind of header; text before the first header is left out."""
    name = F.coalesce(*[F.when(F.col("line").rlike(rule), F.lit(s)) for s, rule in SECTIONS.items()])
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines_of(docs, key, text).withColumn("header", name)
    marked = marked.withColumn("section", F.last("header", True).over(w)).withColumn("stretch", F.count("header").over(w))
    body = marked.filter("section is not null and header is null").groupBy(key, "section", "stretch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return body.groupBy(key, "section").agg(F.max_by(F.trim("content"), "stretch").alias("content"))


def captions(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, ord, section, label, content of caption paragraphs."""
    each = docs.select(key, F.posexplode(F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")).alias("ord", "content"))
    first = F.trim(F.element_at(F.split("content", "\n"), 1))
    label = F.coalesce(F.when(F.regexp_extract(first, CAPTION, 1) != "", F.regexp_extract(first, CAPTION, 1)), F.regexp_extract(first, CAPTION, 2))
    kind = F.when(F.lower(first).startswith("table") | F.lower(first).startswith("supplementary table"), "table_caption").otherwise("figure_caption")
    return each.filter(first.rlike(CAPTION)).select(key, "ord", kind.alias("section"), label.alias("label"), F.substring("content", 1, LONGEST_CAPTION).alias("content"))


def parent_id(source: Column, section: Column, text: Column, label: Column | None = None) -> Column:
    """source#section#16 hex digits of a digest of the parent's first 200 characters."""
    parts = [source, section, *([label] if label is not None else []), F.substring(text, 1, 200)]
    return F.concat_ws("#", source, section, F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16))


def parents(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """Sections of enough text, captions of any, and the whole text where no section was found."""
    found = sections(docs, key, text).filter(F.length("content") >= LEAST_PARENT)
    part = found.select(key, "section", F.lit("section").alias("chunk_type"), F.lit(None).cast("string").alias("label"), "content", parent_id(F.col(key), F.col("section"), F.col("content")).alias("parent_id"))
    marks = captions(docs, key, text).select(key, "section", F.col("section").alias("chunk_type"), "label", "content", parent_id(F.col(key), F.col("section"), F.col("content"), F.col("label")).alias("parent_id"))
    whole = docs.join(sections(docs, key, text).select(key).distinct(), key, "left_anti").filter(F.length(F.trim(text)) > 0)
    rest = whole.select(key, F.lit("full_text").alias("section"), F.lit("section").alias("chunk_type"), F.lit(None).cast("string").alias("label"), F.col(text).alias("content"), F.concat_ws("#", F.col(key), F.lit("full"), F.substring(F.md5(F.concat_ws(":", F.col(key), F.lit("full"))), 1, 16)).alias("parent_id"))
    out = part.unionByName(marks).unionByName(rest)
    return out.withColumn("word_count", F.size(F.filter(F.split("content", r"\s+"), lambda x: x != "")).cast("long")).withColumn("char_count", F.length("content").cast("long"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def pack(text: str, paragraph: str = "\n\n", size: int = CHILD_SIZE) -> list[str]:
    """Greedy children: pieces join up to ``size`` characters, and each child opens with the end of the one before."""
    out: list[str] = []
    held = ""

    def close(piece: str, glue: str, by_sentence: bool) -> str:
        out.append(held.strip())
        words = held.split()
        if len(words) > OVERLAP_WORDS:
            tail = " ".join(words[-OVERLAP_WORDS:])
        else:
            tail = held[-OVERLAP_CHARS:] if by_sentence else ""
        return tail + (glue if tail or by_sentence else "") + piece

    for part in filter(None, (p.strip() for p in text.split(paragraph))):
        long = len(part) > size * LONG_PARAGRAPH
        for piece in _SENTENCE.split(part) if long else [part]:
            glue = " " if long else paragraph
            if held and len(held) + len(piece) > size:
                held = close(piece, glue, long)
            else:
                held = held + glue + piece if held else piece
    if held.strip():
        out.append(held.strip())
    return out


def children(parents: DataFrame, key: str = "parent_id", text: str = "content", paragraph: str = "\n\n") -> DataFrame:
    """key, idx, text: the packing carries its own output along, so it is one Arrow function over whole parents."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pack(t or "", paragraph) for t in texts])

    return parents.select(key, F.posexplode(F.pandas_udf(run, "array<string>")(F.col(text))).alias("idx", "text"))


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def changed(docs: DataFrame, log: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """Documents that the ingest log (key, hash) doesn't have with this text, without very short ones."""
    fresh = docs.withColumn("hash", content_hash(F.col(text))).filter(F.length(text) >= 500)
    return fresh.join(log.select(key, "hash"), [key, "hash"], "left_anti")
