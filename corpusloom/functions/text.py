"""Text as column expressions: cleaning, tokens, folding, citation-shaped substrings. All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import bare, nfkc

#: Words that carry no claim.
STOPWORDS = tuple(
    """
a an the and or but if then than that this these those of in on at to for from
by with without within into onto under over between among during before after
is are was were be been being it its it's as we our us they their them he she
his her not no nor so such can could may might must shall should will would
do does did done have has had having also more most much many few both each
other another some any all one two three first second third however therefore
thus moreover furthermore additionally respectively ie eg etc vs versus
using used use uses based data study studies results result show shows shown
suggest suggests suggested indicate indicates indicated found finds observed
observes demonstrate demonstrates demonstrated report reports reported
paper article figure table section method methods
""".split()
)
#: Headers after which a document's references start, and headers that only count late in a text.
STRONG_HEADER = r"(?i)^#*\s*\*{0,2}\s*(REFERENCES?|BIBLIOGRAPHY|LITERATURE CITED)\s*\*{0,2}\s*$"
WEAK_HEADER = r"(?i)^#*\s*(ACKNOWLEDGMENTS?|SUPPLEMENTARY|SUPPLEMENTAL MATERIALS?|APPENDIX|DATA AVAILABILITY|CONFLICT OF INTEREST|AUTHOR CONTRIBUTIONS?)\s*$"
ARCHIVE_BANNER = "As a library, NLM provides access"
#: What a figure or table reference at the end of a claim looks like, and a token that looks like citation machinery.
TRAILING_REFERENCE = r"(?i)(\s*\((?:see\s+)?(?:fig(?:ure)?|figs?|table|tbl|panel|suppl[a-z]*|appendix|appx|eq(?:uation)?|ref)\.?\s*[^)]*\)\s*)+$"
MALFORMED_TOKEN = r"(?i)(?:(?:^|[^\w])(?:e(?:[\W_]*i[\W_*d]*)?|evidence(?:[\W_]*i[\W_*d]*))[\W_]*[0-9])|(?:^|[^\w])E[0-9]{1,2}(?::|\b)"
KNOWN_BRACKET = r"(?i)^(\[[0-9]+(?:[,;\-\s]+[0-9]+)*\]|\[PMID:\s*[0-9]+\])$"
WORD = r"[\p{L}\p{N}]+"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def fold_width(text: Column) -> Column:
    """Full-width ASCII forms as ASCII."""
    return F.translate(text, _WIDE, _NARROW)


def fold_accents(text: Column) -> Column:
    """Letters without accents, compatibility characters spelled out."""
    return bare(text)


def squash(text: Column) -> Column:
    """Accent-free lower-case letters and digits only; empty for null."""
    return F.regexp_replace(F.lower(fold_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def strict_normal(text: Column) -> Column:
    """Widths, dashes, spaces and quotes folded, white space collapsed."""
    t = nfkc(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, "[‐-―−﹘﹣－]", "-")
    t = F.regexp_replace(t, "[  -​  　]", " ")
    t = F.regexp_replace(t, "[‘’‚‛′]", "'")
    t = F.regexp_replace(t, "[“”„‟″]", '"')
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def claim_normal(text: Column) -> Column:
    """strict_normal in lower case without bracketed and author-year citation marks."""
    t = F.regexp_replace(F.lower(strict_normal(text)), r"\[[0-9]+(?:[,\-\s]+[0-9]+)*\]", " ")
    return F.trim(F.regexp_replace(t, r"\((?:[a-z][a-z'\-]+(?:\s+et\s+al\.)?)(?:,?\s*[0-9]{4})?\)", " "))


def claim_tokens(text: Column) -> Column:
    """Words and numbers of a claim, in order, without stopwords and single characters."""
    # isin with many literals is a hash set
    return F.filter(F.regexp_extract_all(claim_normal(text), F.lit(r"[a-z][a-z\-]*[0-9]*[a-z0-9]|[0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def clean_lines(text: Column) -> Column:
    """The text without image markers, rights lines and the archive banner."""
    keep = lambda x: ~(F.lower(x).contains("==> image") | F.lower(x).contains("==> picture") | (F.trim(x).startswith("©") & x.contains("rights reserved")) | x.contains(ARCHIVE_BANNER))
    return F.array_join(F.filter(F.split(text, "\n", -1), keep), "\n")


def before_references(text: Column) -> Column:
    """The text up to its first strong header, else up to the first weak header in its last two fifths."""
    lines = F.split(text, "\n", -1)
    at = lambda rule: F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(rule(x, i), i)), lambda i: i.isNotNull()))
    strong = at(lambda x, i: x.rlike(STRONG_HEADER))
    weak = at(lambda x, i: x.rlike(WEAK_HEADER) & (i >= F.floor(F.size(lines) * 0.6)))
    return F.array_join(F.slice(lines, F.lit(1), F.coalesce(strong, weak, F.size(lines)).cast("int")), "\n")


#: Fixed value: a run of ideographs or kana.
CJK_RUN = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+"


def run_bigrams(run: Column) -> Column:
    """Two-character windows of a run, the character itself for a run of one."""
    return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: run.substr(i, F.lit(2))))


def cjk_bigrams(text: Column) -> Column:
    """The windows of two of each run of ideographs; other text is dropped."""
    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CJK_RUN), F.lit(0)), run_bigrams))


def strip_trailing_references(text: Column) -> Column:
    """Without figure, table and similar references in brackets at the end."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), TRAILING_REFERENCE, ""))


def malformed_tokens(text: Column) -> Column:
    """Bracketed tokens that look like citations but have none of their shapes."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[[^\]\n]{1,40}\]"), F.lit(0))
    inner = lambda t: F.trim(t.substr(F.lit(2), F.length(t) - 2))
    known = lambda t: t.rlike(KNOWN_BRACKET) | (t.rlike(r"^\[[^\]]*[0-9]{4}[a-z]?\]$") & t.rlike("[A-Za-z]"))
    return F.filter(found, lambda x: (inner(strict_normal(x)) != "") & ~known(strict_normal(x)) & inner(strict_normal(x)).rlike(MALFORMED_TOKEN))


def search_terms(query: Column) -> Column:
    """Query words without the full-text syntax characters."""
    return F.array_distinct(words(F.regexp_replace(query, r'["^{}()\[\]*:]', " ")))


def source_stem(source: Column) -> Column:
    """File stem of a source name: letters, digits, _ and - stay, at most 100 characters."""
    return F.substring(F.regexp_replace(source, r"[^\p{L}\p{N}_\-]", "_"), 1, 100)


def sentences(text: Column) -> Column:
    """Sentences that end in . ! or ? before white space."""
    return F.split(text, r"(?<=[.!?])\s+")


#: Pages that one request may name.
MOST_PAGES = 50


def read_pages(spec: Column, most: int = MOST_PAGES) -> Column:
    """struct(pages, error) of '1-3,7': a sorted array of distinct pages, or why there is none: invalid, too_many or nonpositive.

    Parts are judged in order and before anything is spelled out, so that a huge range costs nothing.
    """
    ok = F.coalesce(spec.rlike(r"^\s*[0-9]+\s*(-\s*[0-9]+\s*)?(,\s*[0-9]+\s*(-\s*[0-9]+\s*)?)*$"), F.lit(False))
    parts = F.split(F.regexp_replace(F.when(ok, spec).otherwise("0"), r"\s+", ""), ",")
    lo = lambda p: F.regexp_extract(p, "^([0-9]+)", 1).cast("decimal(38,0)")
    hi = lambda p: F.regexp_extract(p, "([0-9]+)$", 1).cast("decimal(38,0)")
    fault = lambda p: F.when(F.coalesce(lo(p) > hi(p), F.lit(True)), "invalid").when(hi(p) - lo(p) + 1 > most, "too_many")
    small = F.filter(parts, lambda p: fault(p).isNull())
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(small, lambda p: F.transform(F.sequence(F.lit(0).cast("long"), (hi(p) - lo(p)).cast("long")), lambda i: (lo(p) + i).cast("decimal(38,0)"))))))
    error = F.when(~ok, "invalid").otherwise(F.coalesce(F.get(F.filter(F.transform(parts, fault), lambda x: x.isNotNull()), F.lit(0)), F.when(F.size(pages) > most, "too_many"), F.when(F.array_min(pages) < 1, "nonpositive")))
    return F.struct(F.when(error.isNull(), pages.cast("array<bigint>")).alias("pages"), error.alias("error"))


def expand_pages(spec: Column, most: int = MOST_PAGES) -> Column:
    """The pages of read_pages; null for a spec with an error."""
    return read_pages(spec, most)["pages"]


def format_pages(pages: Column) -> Column:
    """A sorted array of pages as '1-3,7'."""
    runs = F.filter(F.transform(pages, lambda p: F.struct(p.alias("p"), (~F.array_contains(pages, p - 1)).alias("first"))), lambda s: s["first"])
    end = lambda p: F.array_min(F.filter(pages, lambda q: (q >= p) & ~F.array_contains(pages, q + 1)))
    return F.array_join(F.transform(runs, lambda s: F.when(end(s["p"]) == s["p"], s["p"].cast("string")).otherwise(F.concat_ws("-", s["p"].cast("string"), end(s["p"]).cast("string")))), ",")


def slug(topic: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(topic)), r"\s+", "-")


def topic_tokens(topic: Column) -> Column:
    """Sorted tokens; a hyphen is a space."""
    return F.array_sort(F.split(F.regexp_replace(F.lower(F.trim(topic)), r"[-\s]+", " "), " "))


def replace_terms(text: Column, glossary: list[tuple[str, str]]) -> Column:
    """Literal substitutions, any case, in the given order."""
    for old, new in glossary:
        text = F.regexp_replace(text, "(?i)\\Q" + old + "\\E", new.replace("\\", "\\\\").replace("$", "\\$"))
    return text
