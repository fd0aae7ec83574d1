"""Exact nearest neighbours by a metric index: pivots, distances to them, and blocks that the triangle inequality skips.

Every vector belongs to the cell of its nearest pivot and, in it, to one of SHELLS shells by its distance to that pivot. A shell knows the least and greatest distance
of its vectors to every pivot: a query whose distance to a pivot is d is at least as far from all of a shell as d lies outside of that range. The table of shells has at
most PIVOTS * SHELLS rows, however many vectors there are. A query first looks at the shells that could be nearest, as many as hold k vectors, and the k-th distance it finds there is a bound:
all shells that can't be nearer are never looked at. Cells of many vectors are cut into blocks of BLOCK by the key's hash, so no cell is one task's alone. A query goes once to each
block of a cell where it wants a shell, with the shells it wants as bits of a number, and takes no more than k rows with it.

Pivots are chosen from a bounded sample (SAMPLE rows by the least hashes of their keys), each the farthest from those before it; they decide how much is skipped,
never what is found. Distances are measured as retrieve.knn_batch measures them, so results are the same, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.retrieve import top_k
from corpusloom.sources.staging import staged

PIVOTS, SHELLS, SAMPLE, BLOCK = 32, 32, 4096, 4096  # shells are bits of a long
SLACK = 1e-6  # of a distance: what rounding may add


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, one row of b at a time."""
    return np.stack([np.sqrt(((a - x) ** 2).sum(1)) for x in b], axis=1)


def pivots_of(vectors: DataFrame, key: str, vector: str, n: int = PIVOTS) -> np.ndarray:
    """At most n pivots, far from each other, of a bounded sample."""
    rows = vectors.select(F.xxhash64(key).alias("h"), key, vector).orderBy("h", key).limit(SAMPLE).collect()
    some = np.unique(np.array([r[vector] for r in rows], float), axis=0) if rows else np.zeros((0, 1))
    picked = list(range(min(1, len(some))))
    if picked:
        far = _distances(some, some[:1])[:, 0]
        while len(picked) < min(n, len(some)) and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, _distances(some, some[picked[-1:]])[:, 0])
    return some[picked]


def _nearest_wanted(k: int, key: str):
    """Of rows of queries (q, qv, want: bits of shells, most: the greatest squared distance that counts) and a block of vectors (i, iv, shell) the k nearest of each query in
    its shells: query_id, key, distance."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for q, qv, want, most, i, iv, shell in zip(*[rows[c] for c in ("q", "qv", "want", "most", "i", "iv", "shell")]):
                a, b, i, q, shell, found = np.stack(qv).astype(float), np.stack(iv).astype(float), np.asarray(i), np.asarray(q), np.asarray(shell), []
                for lo in range(0, len(a), 256):
                    some, limit = a[lo : lo + 256], np.asarray(most[lo : lo + 256], float)
                    wanted = (np.asarray(want[lo : lo + 256])[:, None] >> np.arange(SHELLS) & 1).astype(bool)
                    cols = np.flatnonzero(wanted.any(0)[shell])
                    if not len(cols):
                        continue
                    c, own = b[cols], (some * some).sum(1)
                    squares = (c * c).sum(1)
                    # as in retrieve.nearest_rows one product finds who may be near, and these are measured exactly
                    rough = squares - 2.0 * (some @ c.T)
                    rough[~wanted[:, shell[cols]]] = np.inf
                    slack = 1e-6 * (1.0 + squares.max() + own.max())
                    bound = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(some), np.inf)
                    for n, x, r, t in zip(q[lo : lo + 256], some, rough, np.minimum(bound, limit - own)):
                        near = np.flatnonzero((r <= t + slack) & (r < np.inf))
                        d = np.round(((c[near] - x) ** 2).sum(1), 9)
                        top = np.lexsort((i[cols[near]], d))[:k]
                        found.append((np.full(len(top), n), i[cols[near[top]]], d[top]))
                if found:
                    yield pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), key: np.concatenate([f[1] for f in found]), "distance": np.concatenate([f[2] for f in found])})

    return nearest


class MetricIndex:
    """An index over vectors (key, vector). ``cells`` has the rows with their shell, ``shells`` the bounds of each."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        self.key, self.pivots = key, pivots_of(vectors, key, vector)
        pivots = self.pivots

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    d = _distances(np.stack(rows["v"]).astype(float), pivots)
                    near = d.argmin(1)
                    yield pd.DataFrame({"id": rows["id"], "v": rows["v"], "cell": near, "r": d[np.arange(len(d)), near], "d": list(d)})

        kind, self.kind = vectors.schema[key].dataType.simpleString(), vectors.schema[vector].dataType.simpleString()
        placed = staged(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(place, f"id {kind}, v {self.kind}, cell int, r double, d array<double>"), "placed")
        cuts = placed.groupBy("cell").agg(F.percentile_approx("r", [i / SHELLS for i in range(1, SHELLS)]).alias("cuts"))
        inside = placed.join(F.broadcast(cuts), "cell").withColumn("shell", F.size(F.filter("cuts", lambda c: c < F.col("r"))))  # cuts: at most PIVOTS rows
        self.cells = staged(inside.select("id", "v", "cell", "shell", "d"), "cells")
        bounds = self.cells.groupBy("cell", "shell").agg(F.count("*").alias("n"), *[f(F.col("d")[i]).alias(f"{name}{i}") for i in range(len(pivots)) for name, f in (("lo", F.min), ("hi", F.max))])
        self.shells = bounds.orderBy("cell", "shell").toPandas()  # at most PIVOTS * SHELLS rows

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        names = range(len(self.pivots))
        return self.shells[[f"lo{i}" for i in names]].to_numpy(float), self.shells[[f"hi{i}" for i in names]].to_numpy(float)

    def _wanted(self, queries: DataFrame, k: int, bound: DataFrame | None) -> DataFrame:
        """query_id, q, most, cell, want (bits): the shells with k vectors that could be nearest to each query (query_id, q), or, with a bound (query_id, most), all the others that can be near enough."""
        if not len(self.pivots):
            return queries.limit(0).select("query_id", "q", F.lit(0.0).alias("most"), F.lit(0).alias("cell"), F.lit(0).cast("long").alias("want"))
        (lo, hi), pivots, at, held = self._bounds(), self.pivots, self.shells[["cell", "shell"]].to_numpy(), self.shells["n"].to_numpy()
        first = bound is None
        rows = queries.withColumn("most", F.lit(float("inf"))) if first else queries.join(bound, "query_id")
        bits = (np.eye(len(pivots), dtype=np.int64)[at[:, 0]] << at[:, 1:]).T  # by cell, of each shell

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                for start in range(0, len(part), 256):
                    some = part.iloc[start : start + 256]
                    if not len(some):
                        continue
                    d = _distances(np.stack(some["q"]).astype(float), pivots)
                    least = np.stack([np.maximum(np.maximum(x - hi, lo - x), 0).max(1) for x in d])
                    near = np.zeros_like(least, dtype=bool)
                    for n, bounds in enumerate(least):
                        order = np.lexsort((d[n, at[:, 0]], bounds))  # of equal bounds the nearest cell
                        near[n, order[: np.searchsorted(held[order].cumsum(), k) + 1]] = True
                    if not first:
                        near = (least <= some["most"].to_numpy(float)[:, None] * (1 + SLACK) + SLACK) & ~near  # those were looked at
                    wants = near.astype(np.int64) @ bits.T  # a row of a query, however many shells it wants
                    yield some[["query_id", "q", "most"]].assign(wants=list(wants))

        kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("query_id", "q"))
        wanted = rows.select("query_id", "q", "most").mapInPandas(choose, f"{kinds}, most double, wants array<bigint>")
        return wanted.select("query_id", "q", "most", F.posexplode("wants").alias("cell", "want")).filter("want <> 0")

    def _look(self, wanted: DataFrame, k: int) -> DataFrame:
        """query_id, key, distance: the k nearest of each query in the shells it wants, block by block."""
        m = self.cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("m"))  # at most PIVOTS rows
        parts = self.cells.join(F.broadcast(m), "cell")
        blocks = parts.groupBy("cell", F.pmod(F.xxhash64("id"), F.col("m")).alias("part")).agg(*[F.collect_list(x).alias(y) for x, y in (("id", "i"), ("v", "iv"), ("shell", "shell"))])
        asked = wanted.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(self.query_parts)).alias("l"))
        asked = asked.agg(*[F.collect_list(x).alias(y) for x, y in (("query_id", "q"), ("q", "qv"), ("want", "want"), (F.col("most") * F.col("most"), "most"))])
        asked = asked.join(F.broadcast(m), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        pairs = asked.join(blocks, ["cell", "part"])
        kinds = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, {self.key} {self.cells.schema['id'].dataType.simpleString()}, distance double"
        return pairs.select("q", "qv", "want", "most", "i", "iv", "shell").mapInPandas(_nearest_wanted(k, self.key), kinds)

    def search(self, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
        """query_id, key, distance (squared), rank of queries (query_id, vector): the rows of retrieve.knn_batch."""
        asked = staged(queries.select("query_id", F.col(vector).alias("q")), "asked")
        self.query_parts = max(1, -(-asked.count() // BLOCK))
        self.first, order = self._wanted(asked, k, None), [F.col("distance"), F.col(self.key)]
        found = staged(top_k(self._look(self.first, k), k, ["query_id"], order), "nearest")
        # fewer than k found: anything may be near enough; distances are rounded
        most = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance") + 1e-9)).otherwise(float("inf")).alias("most"))
        self.rest = staged(self._wanted(asked, k, most), "wanted")
        rows = found.drop("rank").unionByName(self._look(self.rest, k))
        return top_k(rows, k, ["query_id"], order)

    def skipped(self, queries: int) -> float:
        """The share of vectors that the last search's queries did not look at."""
        sizes = self.cells.groupBy("cell", "shell").agg(F.count("*").alias("n"))
        wants = self.first.select("cell", "want").unionByName(self.rest.select("cell", "want"))
        looked = wants.select("cell", F.explode(F.expr(f"filter(sequence(0, {SHELLS - 1}), i -> getbit(want, i) = 1)")).alias("shell")).join(F.broadcast(sizes), ["cell", "shell"]).agg(F.sum("n")).first()[0] or 0
        return 1 - looked / max(1, queries * self.cells.count())
