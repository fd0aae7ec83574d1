"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (lower case, white space between words; fewer words make one shingle). Equal sets
are copies and go on as one node. Nodes get MinHash values. BANDS groups of ROWS values are buckets; a pair of similarity 0.8 shares
none with a chance below 1e-6. Candidates are compared by COMPARED MinHash values, STEP at a time, and dropped as soon as the
posterior probability (uniform prior) that they reach the threshold falls below TOLERANCE. What stays is verified exactly
on the shingle sets.

Buckets aren't expanded into pairs. First they are cut into neighbourhoods that no link crosses: in each bucket all nodes are compared with
a pivot. With 1 - Jaccard as the distance d and links at d <= r, a node linked to one within r of the pivot is within 2 r of it.
So nodes that may be within 2 r join the pivot's neighbourhood, nodes that are surely within r are settled, and the others
try the bucket's next pivot; after ROUNDS pivots what is left joins one neighbourhood. Each neighbourhood is dealt out in blocks of at most
BLOCK_NODES nodes and about BLOCK_BYTES, and a task compares two blocks at a time in numpy: a neighbourhood of m nodes sends each node to m / BLOCK_NODES
tasks. It returns the number of links of every node and links that connect the same nodes,
never the pairs themselves. Classes are the connected components.

Defined cases: null text is empty; a document without words is a class of its own without links; rows that repeat id and text are the same
document; one id with several texts is several documents with that id; null ids are kept; texts are read whole; an empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, bounded_batches, broadcast_if_small, scratch, staged, table, text_or_empty, unstage

HASHES, BANDS, ROWS = 180, 36, 5
COMPARED, STEP = 128, 16
TOLERANCE = 1e-6
ROUNDS = 3
BLOCK_NODES, BLOCK_BYTES = 1024, 1 << 23  # of a block that a task holds
TILE = 256  # nodes of a block that are compared at once

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * _K
    return a ^ (a >> np.uint64(32))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.lower().split()
    n = len(words)
    if n < SHINGLE_WORDS:
        words = [" ".join(words)] if n else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if n >= SHINGLE_WORDS:
        a = h[: n - SHINGLE_WORDS + 1]
        for j in range(1, SHINGLE_WORDS):
            a = _mix(a) + h[j : n - SHINGLE_WORDS + 1 + j]
        h = a
    return np.unique(_mix(h))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * _A + _B).min(0), out=out)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    v = values[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    a = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        a = _mix(a) + v[:, j]
    return _mix(a).view(np.int64)


@lru_cache(None)
def _posterior(matches: int, compared: int, p: float) -> float:
    """P(a value agrees with probability >= p | matches of compared), uniform prior."""
    n = compared + 1
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(matches + 1))


def _agreement(similarity: float) -> float:
    """Chance that the low bytes of two MinHash values agree."""
    return similarity + (1 - similarity) / 256


@lru_cache(None)
def least_matches(threshold: float) -> tuple[int, ...]:
    """For each number of compared values STEP, 2 STEP, ...: with fewer matches a pair is dropped."""
    p = _agreement(threshold)
    return tuple(next(m for m in range(n + 1) if _posterior(m, n, p) >= TOLERANCE) for n in range(STEP, COMPARED + 1, STEP))


@lru_cache(None)
def sure_matches(threshold: float) -> int:
    """With so many matches of COMPARED a pair falls short of the threshold with probability TOLERANCE at most."""
    return next((m for m in range(COMPARED + 1) if 1 - _posterior(m, COMPARED, _agreement(threshold)) <= TOLERANCE), COMPARED + 1)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows of a and b (bytes of MinHash values) stay, and how many of the compared values matched."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least_matches(threshold)):
        part = slice(i * STEP, (i + 1) * STEP)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= m]
        if not len(alive):
            break
    stays = np.zeros(len(a), bool)
    stays[alive] = True
    return stays, matches


PRINT = "n int, key binary, sig binary, bands array<long>"


def _prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            s = shingle_set(t)
            if len(s):
                v = minhashes(s)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), (v[:COMPARED] & np.uint32(255)).astype(np.uint8).tobytes(), bands(v).tolist()))
            else:
                rows.append((0, None, None, None))
        yield pd.DataFrame(rows, columns=["n", "key", "sig", "bands"])


def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)


def _beside_pivot(threshold: float):
    wide = 2 * threshold - 1  # twice the distance

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for xs, ys in batches:
            a, b = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), COMPARED) for v in (xs, ys))
            near, matches = survivors(a, b, wide)
            yield pd.DataFrame({"near": near, "settled": near & (matches >= sure_matches(threshold))})

    return run


def neighbourhoods(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Edges (x, y): every two linked nodes that share a bucket are connected by them."""
    found, alive = [], members
    sig = nodes.select("node", "sig")
    for round_ in range(ROUNDS + 1):
        # the node with most company in its buckets leads, so that many buckets have the same pivot and few pairs differ
        sizes = alive.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("company", "node")).alias("lead")).filter("n > 1")
        # staged, so that the join reads plain shuffles and a hot bucket can be split
        leads = staged(sizes.select("bucket", F.col("lead.node").alias("pivot")), "leads")
        rows = alive.join(leads, "bucket").filter("node != pivot")
        if round_ == ROUNDS:
            found.append(rows.select(F.col("pivot").alias("x"), F.col("node").alias("y")))
            break
        rows = staged(rows, "beside")
        pairs = rows.select("pivot", "node").distinct()
        both = pairs.join(sig.toDF("pivot", "_p"), "pivot").join(sig.toDF("node", "_n"), "node")
        judged = staged(both.select("pivot", "node", F.pandas_udf(_beside_pivot(threshold), "near boolean, settled boolean")("_p", "_n").alias("j")).select("pivot", "node", "j.*"), "judged")
        found.append(judged.filter("near").select(F.col("pivot").alias("x"), F.col("node").alias("y")))
        alive = staged(rows.join(judged.filter("not settled"), ["pivot", "node"]).select("bucket", "node", "company"), "alive")
        unstage(rows)
        if alive.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # a node and its pivots as a path: most nodes share their pivots, so few edges are left
    paths = out.groupBy("y").agg(F.sort_array(F.collect_set("x")).alias("p")).withColumn("p", F.concat(F.array("y"), "p"))
    steps = F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("x"), F.slice("p", F.lit(2), F.size("p") - 1).alias("y"))
    return staged(paths.select(F.explode(steps).alias("e")).select("e.x", "e.y").distinct(), "near")


def _intersections(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j]."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    owner = np.concatenate([np.full(len(s), k) for k, s in enumerate([*a, *b])])
    _, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(a), len(b)), np.float32)
    step = 4096
    for lo in range(0, int(code[-1]) + 1, step):
        s, e = np.searchsorted(code, (lo, lo + step))
        has = np.zeros((len(a) + len(b), step), np.float32)
        has[owner[s:e], code[s:e] - lo] = 1
        total += has[: len(a)] @ has[len(a) :].T
    return total[i, j].astype(np.int64)


def compare_blocks(a: list[dict], b: list[dict] | None, threshold: float) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Links that connect what the linked pairs of two blocks (of one block if b is None) connect, and each node's linked documents."""
    own, b = b is None, a if b is None else b
    sig = [np.frombuffer(b"".join(x["sig"] for x in v), np.uint8).reshape(len(v), COMPARED) for v in (a, b)]
    sets = [[np.frombuffer(x["hashes"], np.uint64) for x in v] for v in (a, b)]
    n, counts, links, parent = (len(a), len(b)), {}, [], {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    size = [np.array([len(s) for s in v]) for v in sets]
    for lo in range(0, n[0], 32):  # 32 rows of pairs at once, with TILE others
        for first in range(0, n[1], TILE):
            last = min(n[1], first + TILE)
            if own and last <= lo + 1:
                continue
            i, j = np.divmod(np.arange((min(n[0], lo + 32) - lo) * (last - first)), last - first)
            i, j = i + lo, j + first
            if own:
                i, j = i[i < j], j[i < j]
            stays, _ = survivors(sig[0][i], sig[1][j], threshold)
            i, j = i[stays], j[stays]
            if not len(i):
                continue
            both = _intersections(sets[0][lo : lo + 32], sets[1][first:last], i - lo, j - first)
            linked = both >= threshold * (size[0][i] + size[1][j] - both) - 1e-9
            for x, y in zip(i[linked].tolist(), j[linked].tolist()):
                p, q = a[x], b[y]
                counts[p["node"]] = counts.get(p["node"], 0) + q["copies"]
                counts[q["node"]] = counts.get(q["node"], 0) + p["copies"]
                r, s = root(p["node"]), root(q["node"])
                if r != s:
                    parent[r] = s
                    links.append((p["node"], q["node"]))
    return links, counts


FOUND = "links array<struct<x: long, y: long>>, counts array<struct<node: long, n: long>>"


def _compared(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for a, b in zip(rows["a"], rows["b"]):
                links, counts = compare_blocks(list(a), None if b is None else list(b), threshold)
                out.append(([{"x": x, "y": y} for x, y in links], [{"node": k, "n": v} for k, v in counts.items()]))
            yield pd.DataFrame(out, columns=["links", "counts"])

    return run


def links(hoods: DataFrame, sets: DataFrame, threshold: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(x, y) links that connect each class, and (node, linked) counts. hoods: node, root. sets: node, copies, sig, hashes."""
    rows = sets.join(hoods, "node")
    size = hoods.join(sets.select("node", F.length("hashes").alias("b")), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    blocks = size.select("root", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("b") / BLOCK_BYTES)).alias("blocks"))
    # only large neighbourhoods need more than one block; there are at most a node for each BLOCK_NODES or BLOCK_BYTES of them
    large = staged(blocks.filter("blocks > 1"), "large")
    dealt = rows.join(broadcast_if_small(large, large.count(), 24), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")))
    packed = staged(dealt.groupBy("root", "block", "blocks").agg(F.collect_list(F.struct("node", "copies", "sig", "hashes")).alias("a")), "blocks")
    own = packed.select("a", F.lit(None).cast(packed.schema["a"].dataType).alias("b"))
    many = packed.filter("blocks > 1")
    left = many.filter("block < blocks - 1").select("root", "a", F.col("block").alias("lo"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("hi"))
    right = many.filter("block > 0").select("root", F.col("a").alias("b"), F.col("block").alias("hi"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("lo"))
    cross = left.join(right, ["root", "lo", "hi"]).select("a", "b")
    found = staged(own.unionByName(cross).mapInPandas(_compared(threshold), FOUND), "compared")
    edges = staged(found.select(F.explode("links").alias("l")).select("l.x", "l.y").distinct(), "links")
    return edges, found.select(F.explode("counts").alias("c")).groupBy(F.col("c.node").alias("node")).agg(F.sum("c.n").alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (x, y): nodes have the same root if and only if they are connected.

    Every node points to its least neighbour, pointers are followed to their ends, and each tree becomes one node of a smaller
    graph, until no edge is left.
    """
    edges = staged(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
    whole = None
    while whole is None or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        points = staged(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "points")
        while True:
            after = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = staged(points.join(after, "root").select("node", F.col("root").alias("old"), F.col("next").alias("root")), "points")
            unstage(points)
            points, moved = jumped.select("node", "root"), not jumped.filter("old <> root").isEmpty()
            points._staged_path = jumped._staged_path
            if not moved:
                break
        at = lambda end: points.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        left = edges.join(at("a"), "a").join(at("b"), "b").filter("ra <> rb")
        smaller = staged(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        unstage(edges)
        edges = smaller
        if whole is None:
            whole = points
        else:
            onward = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            whole = staged(whole.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    return whole


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = NEAR) -> DataFrame:
    """One row for each document (row of key and text): key, class_id, class_size, n_links, first, _tie.

    class_id is the least key of the class; n_links counts its copies and the documents that verified links lead to
    directly; first is true for one document of each class; _tie is the hash of the text.
    """
    bounded_batches(docs.sparkSession)
    body = text_or_empty(text)
    with scratch() as keep:
        rows = docs.select(F.col(key).alias("id"), body.alias("text"))
        prints = keep(staged(rows.select("id", F.xxhash64("text").alias("tie"), F.pandas_udf(_prints, PRINT)("text").alias("p")).select("id", "tie", "p.*"), "prints"))
        rank = F.struct(F.col("id").isNotNull(), "id", "tie")
        own = prints.filter("n > 0").groupBy("key").agg(F.min(rank).alias("least"), F.count_distinct(F.struct("id", "tie")).alias("copies"))
        # a node is a 64-bit hash of its 128-bit key; keys that share a hash get further hashes
        own = own.withColumn("_h", F.xxhash64(F.lit(3), "key")).withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy("key")))
        node = F.when(F.col("_n") == 1, F.col("_h")).otherwise(F.xxhash64("_n", "key"))
        own = staged(own.select(node.alias("node"), "key", F.col("least.id").alias("id"), F.col("least.tie").alias("tie"), "copies"), "own")
        # equal keys are equal sets, so any row of a key stands for the node
        nodes = staged(prints.join(own.select("node", "key", F.col("id").alias("i"), F.col("tie").alias("t")), "key").filter(F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t"))).select("node", "id", "tie", "sig", "bands").dropDuplicates(["node"]), "nodes")
        banded = nodes.select("node", F.explode("bands").alias("bucket"))
        shared = staged(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        members = staged(banded.join(shared, "bucket"), "members")
        members = staged(members.join(members.groupBy("node").agg(F.sum("n").alias("company")), "node").select("bucket", "node", "company"), "company")
        hoods = components(neighbourhoods(nodes, members, threshold))
        needed = staged(nodes.join(hoods.select("node"), "node", "left_semi").select("node", "id", "tie"), "needed")
        wanted = broadcast_if_small(needed.select("node", F.col("id").alias("i"), F.col("tie").alias("t")), needed.count(), 48)
        texts = rows.withColumn("tie", F.xxhash64("text")).join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t"))).select("node", "text")
        sets = texts.select("node", F.pandas_udf(_sets, "binary")("text").alias("hashes")).dropDuplicates(["node"])
        sets = staged(sets.join(nodes.select("node", "sig"), "node").join(own.select("node", "copies"), "node"), "sets")
        edges, degree = links(hoods, sets, threshold)
        roots = components(edges)
        known = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(degree, "node", "left")
        known = staged(known.select("key", "root", "id", "tie", "copies", F.coalesce("linked", F.lit(0)).alias("linked")), "known")
        classes = known.groupBy("root").agg(F.min(rank).alias("least"), F.sum("copies").alias("class_size"))
        known = keep(staged(known.join(classes, "root").select("key", "least", "class_size", (F.col("copies") - 1 + F.col("linked")).alias("n_links")), "classes"))
    out = prints.select("id", "tie", "key").join(known, "key", "left")
    alone = F.col("least").isNull()
    return out.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (alone | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("tie") == F.col("least.tie")))).alias("first"),
        F.col("tie").alias("_tie"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = NEAR) -> DataFrame:
    """The documents without those that are not the first of their class."""
    gone = similarity_classes(docs, key, text, threshold).filter("not first").select(F.col(key).alias("_k"), F.col("_tie").alias("_t")).distinct()
    return docs.join(gone, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text_or_empty(text)) == F.col("_t")), "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).drop("first", "_tie")


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
k AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS key FROM s),
u AS MATERIALIZED (SELECT min(doc_id) AS node, count(*) AS copies, key, min(n) AS n FROM k WHERE n > 0 GROUP BY key),
x AS MATERIALIZED (SELECT node, n, unnest(s) AS g FROM u JOIN s ON node = doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT a.node AS a, b.node AS b, count(*) AS c, min(a.n) AS na, min(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node) WHERE c >= 0.8 * (na + nb - c)),
d AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT node, node AS other FROM u UNION SELECT r.node, d.b FROM r JOIN d ON r.other = d.a),
c AS (SELECT node, min(other) AS root FROM r GROUP BY node),
l AS (SELECT d.a AS node, sum(copies) AS linked FROM d JOIN u ON d.b = u.node GROUP BY d.a),
z AS (SELECT root, sum(copies) AS size FROM c JOIN u USING (node) GROUP BY root)
SELECT k.doc_id AS doc_id, coalesce(root, k.doc_id) AS class_id, CAST(coalesce(size, 1) AS BIGINT) AS class_size, CAST(coalesce(copies - 1 + coalesce(linked, 0), 0) AS BIGINT) AS n_links
FROM k LEFT JOIN u ON k.key = u.key AND k.n > 0 LEFT JOIN c ON u.node = c.node LEFT JOIN z USING (root) LEFT JOIN l ON u.node = l.node
"""
