"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The filter is a table of 64-bit blocks. A URL's hash names one block and PROBES bits in it, so that testing
a URL costs one lookup. Blocks are built by bit_or, which merges partial filters in any order, and are packed by ROW into rows of
eight bytes a block, so that the filter of some 20 million URLs is broadcast whole. URLs whose bits
are all set are possible hits and meet the exact list in a hash join; the others never reach that join.

Defined cases: a null or malformed URL (no ``://``) has an empty host and path, an empty canonical form, no rule and the
verdict allow. Repeated rows stay repeated. An empty list allows what no rule blocks. Extra columns of the input are
not read; the result has its own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, table

#: (host, path, verdict). Fixed values of the rule list; a rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Second-level names whose pages the sample list holds.
LISTED_NAMES = ("casino-win", "free-bets", "adult-x", "spam-farm")

LISTED_BYTES = 128  # of a listed URL in a hash table
URLS_PER_BLOCK = 5  # about 12.8 bits per listed URL
PROBES = 5
ROW = 512  # blocks in a packed row


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased, other letters kept."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query, fragment, a leading www. or m., a final .html and final slashes don't tell pages apart."""
    short = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.concat(short, F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", ""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bits(url: Column) -> Column:
    """PROBES bits of one 64-bit block, from a second hash."""
    h = F.xxhash64(F.lit("bits"), url)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.expr("1L") * F.call_function("shiftleft", F.expr("1L"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom_blocks(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter: (block, bits), at most ``blocks`` rows."""
    return listed.groupBy(F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block")).agg(F.bit_or(_bits(F.col(column))).alias("bits"))


def packed(bloom: DataFrame, blocks: int) -> DataFrame:
    """(row, bits): the blocks' bits, ROW in a row; a block that no URL has is 0."""
    every = bloom.sparkSession.range(blocks).select(F.col("id").alias("block")).join(bloom, "block", "left")
    filled = every.select(F.floor(F.col("block") / ROW).alias("row"), F.struct("block", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("b"))
    return filled.groupBy("row").agg(F.sort_array(F.collect_list("b")).alias("b")).select("row", F.transform("b", lambda x: x["bits"]).alias("bits"))


def filter_urls(urls: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Judge every row of urls. listed: one string column of listed URLs, of any form and with repeats.

    Returns key, host, path, rule, verdict, canonical, listed (boolean: the exact list has it). A rule decides
    where one fits; else a listed URL is blocked and any other allowed.
    """
    raw = F.col(listed.columns[0])
    known = listed.select(canonical(host_of(raw), path_of(raw)).alias("canonical")).filter("canonical != ''").distinct()
    n = known.count()
    blocks = max(1, -(-n // URLS_PER_BLOCK))
    bloom = broadcast_if_small(packed(bloom_blocks(known, "canonical", blocks), blocks), blocks, 8)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    page = urls.select(F.col(key), host.alias("host"), path.alias("path"))
    page = page.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    page = page.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), _bits(F.col("canonical")).alias("mask"))
    page = page.withColumn("row", F.floor(F.col("block") / ROW)).join(bloom, "row", "left")
    bits = F.element_at("bits", (F.col("block") % ROW + 1).cast("int"))
    tested = page.withColumn("possible", F.coalesce(bits.bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))).drop("row", "block", "bits", "mask")
    exact = known.withColumn("listed", F.lit(True))
    if n * LISTED_BYTES <= BROADCAST_BYTES:
        # one join; what the filter rules out has no key
        keyed = tested.withColumn("_key", F.when(F.col("possible"), F.col("canonical")))
        both = keyed.join(F.broadcast(exact.withColumnRenamed("canonical", "_key")), "_key", "left").drop("_key")
    else:
        # only possible hits are shuffled; the rows without a key would all meet in one task
        both = tested.filter("possible").join(exact, "canonical", "left").unionByName(tested.filter("not possible").withColumn("listed", F.lit(None).cast("boolean")))
    both = both.withColumn("listed", F.coalesce("listed", F.lit(False)))
    return both.select(key, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")


def listed_pages(pages: DataFrame) -> DataFrame:
    """The sample list for the query: the URLs of all pages under one of LISTED_NAMES, in another form than the pages have, and for every
    tenth page a URL of its site that no page has."""
    names = "|".join(LISTED_NAMES)
    form = F.concat(F.lit("ftp://WWW."), canonical(host_of(F.col("url")), path_of(F.col("url"))), F.lit(".html?from=list#top"))
    flagged = pages.filter(host_of(F.col("url")).rlike(rf"(^|\.)({names})\.")).select(form.alias("url"))
    absent = F.concat(F.lit("https://"), canonical(host_of(F.col("url")), path_of(F.col("url"))), F.lit("/not-a-page-"), F.col("page_id").cast("string"))
    return flagged.unionByName(pages.filter("page_id % 10 = 0 and url is not null").select(absent.alias("url")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_pages(pages))


_HOST = "translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_SAYS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
OP9_SQL = f"""
WITH a AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
b AS (SELECT *, concat(regexp_replace(host, '^(www|m)\\.', ''), regexp_replace(regexp_replace(path, '\\.html?$', ''), '/+$', '')) AS canonical,
      CASE {_FITS} END AS rule FROM a),
l AS (SELECT DISTINCT canonical FROM b WHERE regexp_matches(host, '(^|\\.)({"|".join(LISTED_NAMES)})\\.') AND canonical <> '' UNION SELECT concat(canonical, '/not-a-page-', page_id) FROM b WHERE page_id % 10 = 0)
SELECT page_id, host, path, rule,
  coalesce(CASE rule {_SAYS} END, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  b.canonical AS canonical, l.canonical IS NOT NULL AS listed
FROM b LEFT JOIN l ON b.canonical = l.canonical
"""
