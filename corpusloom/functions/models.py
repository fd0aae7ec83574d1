"""The one seam for models. A model maps a text to a value; the defaults are deterministic and need no service.

A real endpoint is any function of a list of texts to a list of values (None where it failed), run on Arrow batches; a null
result leaves the plan's fallback in force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

DIMENSIONS = 64


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Default embedding: unit-length counts of hashed tokens."""
    slots = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return unit(counts)


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def lexical_relevance(query: Column, text: Column, most: int = 1000) -> Column:
    """Default reranker: the share of the query's distinct words in the text's first characters."""
    q = F.array_distinct(words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.substring(text, 1, most)))) / F.size(q))


def best_sentence(query: Column, text: Column) -> Column:
    """Default distiller: the sentence that shares most words with the query, the first of equals."""
    q = F.array_distinct(words(query))
    scored = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s, i: F.struct(F.size(F.array_intersect(q, words(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(scored)["s"]


def endpoint(call: Callable[[list[str]], list], kind: str) -> Callable[[Column], Column]:
    """A model behind a service as a column function; failures of a whole batch give nulls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                yield pd.Series(call(list(texts)), dtype=object)
            except Exception:  # the seam fails soft by contract: the plan then falls back
                yield pd.Series([None] * len(texts), dtype=object)

    return lambda column: F.pandas_udf(run, kind)(column)
