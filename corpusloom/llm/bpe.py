"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes start as a linked list of parts. Every adjacent pair that is a known token waits in the bucket of
its rank; a bitmap of two levels, each bit of the upper one standing for 256 ranks, finds the least rank in use by
find-first-set. A bucket is a heap of list positions, so equal ranks merge from left to right. A merge leaves the neighbours'
old pairs behind: they are recognised as stale when popped, because the pair at that position no longer has that rank.
Every part costs a fixed number of queue steps, so pre-tokens of megabytes stay near-linear. Pre-tokens repeat, so a
worker keeps the ids of those it has met lately, in two tables of bounded size.

Defined cases: a null text is an empty one and has no ids (empty strings are hashed); repeated rows stay repeated; lone
surrogates cannot occur in a Spark string. Extra columns are not read. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_or_empty

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens in each of a worker's two tables, and the characters of the longest that is kept.
CACHE_ENTRIES = 400_000
CACHE_LONGEST = 64


class Pretokens(dict):
    """Ids of the pre-tokens met lately, joined by commas. Two generations: a full one replaces the older one."""

    def __init__(self, merge):
        self.merge, self.older = merge, {}

    def __missing__(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.merge(piece.encode())))
            if len(piece) > CACHE_LONGEST:
                return ids
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Ids of a text by a table of ranks, and the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {str(v): k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        # the rank queue: buckets of positions; a bit of ``words`` for each bucket in use, a bit of the top for each word in use.
        # Ranks count down from ``self.last`` there, so that the least rank is the first bit set from the top of a number
        self.last = max(ranks.values())
        self.order = {k: self.last - v for k, v in ranks.items()}
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((self.last >> 8) + 1)
        self.bits = tuple(1 << i for i in range(max(256, len(self.words))))
        self.known = Pretokens(self.merge)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue is empty before and after."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get, bit = self.order.get, self.bits
        buckets, words, top = self.buckets, self.words, 0
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # where the part before it starts
        waiting = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # the pair that starts here
        waiting.append(-1)
        for i, r in enumerate(waiting):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
        while top:
            w = top.bit_length() - 1  # find-first-set in the top, then in its word
            word = words[w]
            b = word.bit_length() - 1
            r = (w << 8) | b
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                words[w] = word = word ^ bit[b]
                if not word:
                    top ^= bit[w]
            if waiting[i] != r:
                continue  # stale
            mid = end[i]
            end[i] = stop = end[mid]
            waiting[mid] = -1
            if stop < n:
                before[stop] = i
                waiting[i] = r = get(piece[i : end[stop]], -1)
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        words[r >> 8] |= bit[r & 255]
                        top |= bit[r >> 8]
            else:
                waiting[i] = -1
            j = before[i]
            if j >= 0:
                r = get(piece[j:stop], -1)
                if r != waiting[j]:
                    waiting[j] = r
                    if r >= 0:
                        if r in buckets:
                            heappush(buckets[r], j)
                        else:
                            buckets[r] = [j]
                            words[r >> 8] |= bit[r & 255]
                            top |= bit[r >> 8]
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for a worker and table."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec.load(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256, and with ids=True the ids themselves (array<int>) and the decoded text.

    path: a rank file that every worker can read, such as one of an installed package.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if ids else "")

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                joined = own.encode(t)
                raw = own.decode(joined)
                row = (joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
                rows.append((*row, joined, raw.decode()) if ids else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    out = docs.withColumn("_bpe", run(text_or_empty(text)))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    out = out.select(*[c for c in docs.columns if c not in (*names, "ids", "decoded")], *[f"_bpe.{c}" for c in names], *([F.col("_bpe.ids"), F.col("_bpe.decoded")] if ids else []))
    if ids:
        out = out.withColumn("ids", F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>")))
    return out


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_RANKS), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, *public_ranks()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
