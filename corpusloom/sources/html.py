"""Pages as Markdown: headings and paragraphs by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(html: Column) -> Column:
    """The page without head, scripts, styles, menus, asides, footers, forms and comments."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->", " ")
    for name in ("script", "style", "head", "nav", "aside", "footer", "form"):
        t = F.regexp_replace(t, rf"(?is)<{name}\b.*?</{name}\s*>", " ")
    return t


def decode(text: Column) -> Column:
    """The common character references."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(decode(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def headings(html: Column) -> Column:
    """Texts of h1 to h3, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), plain)


def paragraphs(html: Column) -> Column:
    """Texts of the paragraphs, in order; empty ones dropped."""
    starts = F.slice(F.split(visible(html), r"(?i)<p(?:\s[^>]*)?>"), 2, 1_000_000)
    ends = F.transform(starts, lambda p: plain(F.regexp_replace(p, r"(?is)</p>.*$", "")))
    return F.filter(ends, lambda p: p != "")


def markdown(html: Column) -> Column:
    """# headings, a blank line, paragraphs."""
    return F.array_join(F.concat(F.transform(headings(visible(html)), lambda h: F.concat(F.lit("# "), h)), paragraphs(html)), "\n\n")
