"""Secret scan with corpus-wide ownership frequency.

Texts are scanned once. The base kinds (assign, access, hex) are fixed patterns. A fourth kind, token, takes long mixed strings of high
entropy that no base span covers; on its own it would flag any identifier, so corpus statistics decide. Every
candidate's hash is counted by distinct repositories and owners over the whole corpus: values that several owners share
or that many repositories copy are examples, values of one owner in few repositories look live. A token span is reported only when
it looks live; base spans are always reported, and n_live and n_example tell how they are judged.

Defined cases: null text is empty; rows without an owner share one owner, the one with the empty name, and rows without a repository one repository, so
that missing names never make a value look widely copied; repeated rows stay repeated and count as one repository; an empty table gives no rows. Clashing extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, staged, table, text_or_empty
from .spans import clear_of

#: The base kinds in their listed order.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Least entropy of a token, in bits for each character.
LEAST_ENTROPY = 3.4
#: A live-looking value has at most so many owners and repositories.
LIVE_OWNERS = 1
LIVE_REPOSITORIES = 3


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds; kind as its place in KINDS."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long strings with digits and letters and high entropy, clear of the spans already taken."""
    found = []
    for m in TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= LEAST_ENTROPY:
            found.append((m.start(), 3, m.end(), v))
    return clear_of(taken, found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, base string, found array<struct<kind: int, start: int, stop: int, value: binary>>"


def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            spans = base_spans(t)
            kinds = [k for _, k, _, _ in spans]
            base = joined(spans)
            every = sorted(spans + token_spans(t, spans))
            found = [{"kind": k, "start": a, "stop": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest()} for a, k, b, v in every]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), base, found))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])


def ownership(candidates: DataFrame) -> DataFrame:
    """value, n_repositories, n_owners, live of candidates (value, repository, owner)."""
    each = candidates.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    owners = each.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    # a repository of several owners counts once for each owner: it can't make a value look live
    stats = owners.groupBy("value").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))
    return stats.withColumn("live", (F.col("n_owners") <= LIVE_OWNERS) & (F.col("n_repositories") <= LIVE_REPOSITORIES))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row for each row of docs: key, counts, base_sha256, spans, n_live, n_example, judged (spans with live or example) and found, the spans with
    their statistics."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.pandas_udf(scan, SCANNED)(text_or_empty(text)).alias("s"))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("_row"), key, "_repository", "_owner", "s.*"), "secrets")
    spans = rows.filter(F.size("found") > 0).select("_row", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"), F.explode("found").alias("f")).select("_row", "owner", "repository", "f.*")
    judged = spans.join(ownership(spans), "value").filter((F.col("kind") < 3) | F.col("live"))
    place = F.struct("start", "kind", "stop", "live", "n_repositories", "n_owners")
    by_row = judged.groupBy("_row").agg(F.sort_array(F.collect_list(place)).alias("found"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))
    text_of = F.array_join(F.transform("found", shown), ",")
    judged_of = F.array_join(F.transform("found", lambda x: F.concat_ws(":", shown(x), F.when(x["live"], "live").otherwise("example"))), ",")
    out = rows.drop("found").join(by_row, "_row", "left")
    return out.select(
        key, "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(text_of, F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter("found", lambda x: x["live"])), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter("found", lambda x: ~x["live"])), F.lit(0)).cast("long").alias("n_example"),
        F.coalesce(judged_of, F.lit("")).alias("judged"),
        "found",
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("found")
