"""Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns. It is known by a hash of its turns that adds up: every turn has four 32-bit lanes that depend on its depth, role and
text, and the running sums of the lanes, hashed to 128 bits, name the prefix. So a prefix is a running sum, and running sums work over ranges of rows: turns are
dealt out in ranges of (conversation, order), each range is summed apart, and only conversations that reach over the end of a range, at most
one for each range, need what the ranges before have. No conversation, however long, is one task's alone, and no text is sent anywhere.

Among the children of a node the one with most members is heavy (least conv_id first). Heavy edges make paths, and a walk from the root crosses at most log2(members)
light edges, as each at least halves the members. Per path, one row: its own sum, its parent path and its level (light edges above it). In one round for each level, deepest
first, the totals of light paths are added to their parents' paths. Then each node gets the totals of the light paths attached to it, and one suffix
sum along each path, dealt out in ranges too, gives every subtree. Paths and conversations that hold much of the table are split by ranges; counts of common
nodes are summed before they are shuffled.

The ids that end at a node are hashed in order: in pieces of up to CHUNK ids, joined in parallel; a node's pieces pass through one task as a stream.

Defined cases: turns are ordered by turn (null first), then by md5 of role and text, so equal rows stay and ties have one order; a null role or text is empty; rows
without conv_id belong to no conversation and are left out; an empty table gives no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, ranged, scratch, staged, table

BASE = 20  # conversation c starts like c - c % BASE
HEADS = 4  # with the first crc32(c) % HEADS turns of it
LANES = ["_l0", "_l1", "_l2", "_l3"]
CHUNK = 4096  # ids joined at once


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


# running sums over ranges -----------------------------------------------------------------------------------------


def running(parts: DataFrame, key: list[str], order: list, **sums: Column) -> DataFrame:
    """Rows of a ranged table with running sums (or, for names that start with most_, maxima) of columns along each key, this row included."""
    whole = {n: (F.max if n.startswith("most_") else F.sum) for n in sums}
    ends = parts.groupBy("_p").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b"))
    over = ends.select(F.explode(F.array("a", "b")).alias("k")).select("k.*").distinct()  # at most two keys for each range
    sent = parts.join(F.broadcast(over), key, "left_semi").groupBy("_p", *key).agg(*[whole[n](c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sent.select("_p", *key, *[whole[n](n).over(earlier).alias(f"_before_{n}") for n in sums])
    here = Window.partitionBy("_p", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.select(*parts.columns, *[whole[n](c).over(here).alias(n) for n, c in sums.items()]).join(F.broadcast(before), ["_p", *key], "left")
    both = {n: F.greatest(n, f"_before_{n}") if n.startswith("most_") else F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums}
    return out.withColumns(both).drop(*[f"_before_{n}" for n in sums])


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))


# rebuilt conversations --------------------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, length of every conversation, and conv_id, depth, turn's hashes _a and _b, words of its turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tie = F.md5(F.concat(role, F.lit("\x01"), text))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", tie.alias("_tie"), F.xxhash64(role, text).alias("_a"), F.xxhash64(F.lit(1), text, role).alias("_b"), words(text).alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("_tie")]
    parts = ranged(rows, "turns", "conv_id", *order)
    turns = staged(running(parts, ["conv_id"], order, pos=F.lit(1).cast("long")).select("conv_id", "pos", "_a", "_b", "words"), "places")
    ids = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    ids = ids.withColumn("_h", F.crc32(F.col("conv_id").cast("string")) % HEADS).withColumn("_base", F.col("conv_id") - F.col("conv_id") % BASE)
    sizes = ids.filter(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("_base"), F.col("own").alias("_there"))
    ids = staged(ids.join(sizes, "_base", "left").withColumn("_m", F.least("_h", F.coalesce("_there", F.lit(0)))), "ids")
    first = turns.filter((F.col("pos") < HEADS) & (F.col("conv_id") % BASE == 0)).withColumnRenamed("conv_id", "_base")
    heads = ids.filter("_m > 0").select("conv_id", "_base", "_m").join(first, "_base").filter("pos <= _m").select("conv_id", F.col("pos").alias("depth"), "_a", "_b", "words")
    rest = turns.join(ids.select("conv_id", "_h", "_m"), "conv_id").filter("pos > _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_m")).alias("depth"), "_a", "_b", "words")
    return ids.select("conv_id", (F.col("_m") + F.greatest(F.col("own") - F.col("_h"), F.lit(0))).alias("length")), rest.unionByName(heads)


def prefixes(turns: DataFrame) -> DataFrame:
    """A ranged table of turns with node and parent: 128-bit names of the prefixes that end with this turn and the one before; the parent at depth 1 is the root, (0, 0)."""
    parts = ranged(turns, "rebuilt", "conv_id", "depth")
    lanes = [F.xxhash64("depth", "_a"), F.xxhash64(F.lit(2), "depth", "_b")]
    halves = [f(x) for x in lanes for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = running(parts, ["conv_id"], ["depth"], **dict(zip(LANES, halves)))

    def name(depth: Column, lanes: list[Column]) -> Column:
        return F.struct(F.xxhash64(depth, *lanes).alias("x"), F.xxhash64(F.lit(3), *lanes, depth).alias("y"))

    before = [F.col(n) - h for n, h in zip(LANES, halves)]
    parent = F.when(F.col("depth") == 1, _root()).otherwise(name(F.col("depth") - 1, before))
    return staged(sums.select("_p", "conv_id", "depth", "words", name(F.col("depth"), [F.col(n) for n in LANES]).alias("node"), parent.alias("parent")), "prefixes")


# the trie ---------------------------------------------------------------------------------------------------------


def nodes_of(turns: DataFrame) -> DataFrame:
    """node, parent, depth, words, conv_id (smallest member), n_convs of every node but the root."""
    return turns.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))


def paths_of(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, path (the name of its heavy path's first node; the root's path is null) and level (light edges above) of every node.

    A light node is one that its parent has a child before, by members, then conv_id. Which light edges lie above a node is
    a running sum along any conversation that has it.
    """
    heavy = nodes.groupBy("parent").agg(F.max(F.struct("n_convs", (-F.col("conv_id")).alias("c"), "node"))["node"].alias("node"))
    light = staged(nodes.join(heavy, "node", "left_anti").select("node", F.lit(True).alias("_light")), "light")
    marked = staged(turns.select("_p", "conv_id", "depth", "node").join(light, "node", "left"), "marked")
    mine = F.when(F.col("_light"), F.struct("depth", "node"))
    above = running(marked, ["conv_id"], ["depth"], level=F.when(F.col("_light"), 1).otherwise(0).cast("long"), most_light=mine)
    return above.groupBy("node").agg(F.first(F.col("most_light.node"), ignorenulls=True).alias("path"), F.max("level").alias("level"))


def subtree_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """nodes (node, parent, depth, path, level) with the sums of columns over their subtrees."""
    owner = nodes.select(F.col("node").alias("parent"), F.col("path").alias("_to"))
    heads = nodes.filter("node = path").select("path", "parent", "level")
    own = nodes.groupBy("path").agg(*[F.sum(c).alias(c) for c in columns], F.max("level").alias("_level"))
    # one row for each light path: its level, the node and the path it hangs from
    paths = staged(own.filter("path is not null").drop("_level").join(heads, "path").join(owner, "parent", "left"), "paths")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    totals, below = None, None
    for level in range(deepest, 0, -1):
        now = paths.filter(F.col("level") == level)
        if below is not None:
            now = now.unionByName(below.select(F.col("_to").alias("path"), *columns), allowMissingColumns=True).groupBy("path").agg(
                *[F.sum(c).alias(c) for c in columns], *[F.max(c).alias(c) for c in ("parent", "level", "_to")]
            )
        below = staged(now, "totals")
        totals = below if totals is None else totals.unionByName(below)
    if totals is not None:
        hung = totals.groupBy("parent").agg(*[F.sum(c).alias(f"_{c}") for c in columns]).withColumnRenamed("parent", "node")
        nodes = nodes.join(hung, "node", "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).drop(*[f"_{c}" for c in columns])
    line = F.coalesce("path", _root())
    parts = ranged(nodes.withColumns({"_line": line, "_up": -F.col("depth")}), "lines", "_line", "_up")
    summed = running(parts, ["_line"], ["_up"], **{f"sum_{c}": F.col(c) for c in columns})
    return summed.withColumns({c: F.col(f"sum_{c}") for c in columns}).drop("_p", "_line", "_up", *[f"sum_{c}" for c in columns])


# the digests of what ends at a node -------------------------------------------------------------------------------


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, state = None, None
    for batch in batches:
        done = []
        for x, y, ids in zip(batch["x"], batch["y"], batch["ids"]):
            if (x, y) == last:
                state.update(b"," + ids.encode())
                continue
            if last is not None:
                done.append((*last, state.hexdigest()))
            last, state = (x, y), hashlib.sha256(ids.encode())
        if done:
            yield pd.DataFrame(done, columns=["x", "y", "sha"])
    if last is not None:
        yield pd.DataFrame([(*last, state.hexdigest())], columns=["x", "y", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): ids ascending, joined by commas."""
    parts = ranged(ends, "ends", "node", "conv_id")
    place = F.row_number().over(Window.partitionBy("_p", "node").orderBy("conv_id"))
    chunks = parts.withColumn("_c", F.floor((place - 1) / CHUNK)).groupBy("node", "_p", "_c").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    chunks = staged(chunks, "chunks")
    counted = chunks.groupBy("node").agg(F.count("*").alias("_n"), F.max("ids").alias("ids"))
    alone = counted.filter("_n = 1").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    rest = chunks.join(counted.filter("_n > 1").select("node"), "node", "left_semi").select("node.x", "node.y", "_p", "_c", "ids")
    streamed = rest.repartition("x", "y").sortWithinPartitions("x", "y", "_p", "_c").select("x", "y", "ids").mapInPandas(_stream, "x long, y long, sha string")
    return alone.unionByName(streamed.select(F.struct("x", "y").alias("node"), F.col("sha").alias("ends_sha256")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bounded_batches(conversations.sparkSession)
    with scratch() as keep:
        lengths, turns = rebuilt(conversations)
        lengths, turns = staged(lengths, "lengths"), prefixes(turns)
        none = F.lit(None).cast("struct<x:bigint,y:bigint>")
        plain = staged(nodes_of(turns), "nodes")
        children = plain.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
        everyone = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
        tops = everyone.select(_root().alias("node"), none.alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs", none.alias("path"), F.lit(0).cast("long").alias("level"))
        nodes = plain.join(paths_of(turns, plain), "node").unionByName(tops).join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        nodes = nodes.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
        summed = staged(subtree_sums(staged(nodes, "marked-nodes"), ["n_leaves", "saved_tokens"]), "summed")
        at_end = turns.join(lengths, "conv_id").filter("depth = length").select("node", "conv_id").unionByName(lengths.filter("length = 0").select(_root().alias("node"), "conv_id"))
        digests = staged(end_digests(at_end), "digests")
        above = summed.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = summed.join(digests, "node", "left").join(above, "parent", "left")
        out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
        return keep(staged(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(1) || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS own, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h FROM t GROUP BY conv_id),
m AS (SELECT i.*, least(i.h, coalesce(b.own, 0)) AS m FROM i LEFT JOIN i b ON b.conv_id = i.base),
r AS (SELECT m.conv_id, t.pos AS depth, t.role, t.text FROM m JOIN t ON t.conv_id = m.base AND t.pos <= m.m
  UNION ALL SELECT m.conv_id, t.pos - m.h + m.m, t.role, t.text FROM m JOIN t ON t.conv_id = m.conv_id AND t.pos > m.h),
k AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM i),
n AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(words) AS words FROM k GROUP BY key),
p AS (SELECT n.*, k.key AS parent FROM n LEFT JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth - 1),
c AS (SELECT parent, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT k.key, count(*) FILTER (WHERE c.parent IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved FROM n LEFT JOIN c ON c.parent = n.key JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth GROUP BY k.key),
e AS (SELECT k.key, sha256(string_agg(CAST(k.conv_id AS VARCHAR), ',' ORDER BY k.conv_id)) AS sha FROM k JOIN (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id) USING (conv_id, depth) GROUP BY k.key)
SELECT p.conv_id, CAST(p.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(p.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM p LEFT JOIN n u ON u.key = p.parent LEFT JOIN c ON c.parent = p.key JOIN s ON s.key = p.key LEFT JOIN e ON e.key = p.key
"""
