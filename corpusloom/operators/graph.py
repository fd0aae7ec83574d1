"""Citation graphs as edge tables (src cites dst). Iterations are fixed and staged every few rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import titles as tt
from corpusloom.functions.text import words
from corpusloom.operators.retrieve import small, top_k
from corpusloom.sources.staging import dealt, staged

DAMPING = 0.85
EVERY = 5  # rounds between tables
MOST_NODES = 1_000_000  # whose values (16 bytes each) go to all tasks that walk edges
EDGES_A_TASK = 1_000_000
MOST_EDGES = 30_000_000  # of a graph that is sent to the tasks, as numbers of four bytes, once for each direction
GROUP_EDGES = 2_000_000  # of a component that goes to a task as rows
FEW_EDGES = 4_000  # of a graph that is walked from many sources at once, edge by edge
WALK_CELLS = 8_000_000  # nodes times sources whose values go to the tasks that hold blocks of a larger graph
FEW_WALKS = 64  # times that many
FOUND = 200_000  # rows that a task gives back at once
CELLS = 4_000_000  # edges times sources that a task works on at once
STARTS = 256  # sources in a component that are one group's
DENSE = 3000  # nodes of a graph that may be held as a matrix
BLOCK_EDGES, PART_EDGES = 2_000_000, 2_000_000  # about as many links of sources and of seeds meet in a task
PIECE = 512  # seeds of a class that are opened up at once
RANGE = 64  # papers of a class in a range
MOST_CLASSES, OPENED = 200_000, 8_000_000  # classes, and nodes in them, that go to all tasks
STRONG, WEAK, GAP = 0.90, 0.55, 0.10
#: Citations in a text before its references, and entries after them.
IN_TEXT = r"\(?([A-Z][A-Za-z'\-]+)(?:\s+et\s+al\.?|\s+and\s+[A-Z][A-Za-z'\-]+)?,?\s*\(?((?:19|20)[0-9]{2})[a-z]?\)"
ENTRY = r"(?m)^\s*(?:\[?[0-9]+[\].]\s*)?([A-Z][A-Za-z'\-]+)[^\n]*?\(?((?:19|20)[0-9]{2})[a-z]?\)?[.,:]?\s+([^\n]{1,200})"


def cited(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """from, to_author, to_year, to_title_hint of in-text citations and reference entries, each once for a document."""
    cut = F.regexp_instr(text, F.lit(r"(?im)^#*\s*(references|bibliography|literature cited)\s*$"))
    parts = docs.select(F.col(key).alias("from"), F.when(cut > 0, F.expr(f"substring({text}, 1, 1)")).alias("_"), F.when(cut > 0, F.substring(F.col(text), F.lit(1), cut - 1)).otherwise(F.col(text)).alias("body"), F.when(cut > 0, F.substring(F.col(text), cut, F.length(text))).alias("tail")).drop("_")
    pick = lambda column, rule, g: F.regexp_extract_all(F.col(column), F.lit(rule), F.lit(g))
    body = parts.select("from", F.explode(F.arrays_zip(pick("body", IN_TEXT, 1).alias("a"), pick("body", IN_TEXT, 2).alias("y"))).alias("c")).select("from", F.col("c.a").alias("to_author"), F.col("c.y").alias("to_year"), F.lit("").alias("to_title_hint"))
    tail = parts.select("from", F.explode(F.arrays_zip(pick("tail", ENTRY, 1).alias("a"), pick("tail", ENTRY, 2).alias("y"), pick("tail", ENTRY, 3).alias("t"))).alias("c")).select("from", F.col("c.a").alias("to_author"), F.col("c.y").alias("to_year"), F.col("c.t").alias("to_title_hint"))
    return body.unionByName(tail).dropDuplicates()


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) of every edge in both directions, once."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()


def _dealt_both_ways(edges: DataFrame) -> DataFrame:
    """both_ways dealt by a to as many tasks as the edges need, however well they compress."""
    kept = staged(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), "edges")
    return dealt(kept.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "a", rows=EDGES_A_TASK).distinct()


def coupling(edges: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """seed, other, shared, jaccard, rank: sources whose targets overlap most with a seed's. edges: src, dst, distinct. seeds: src.

    Common targets make nearly all sources share something with a seed. So pairs are never rows: blocks of sources meet parts of the seeds, a task counts what each
    seed of the part shares with each source of the block, and the k best of a block go on. Numbers of sources are in their order, which decides between equals.
    """
    sized = edges.filter("src is not null").groupBy("src").agg(F.count("*").alias("n"))
    size = staged(sized.orderBy("src").withColumn("id", F.monotonically_increasing_id()), "sized")
    mine = edges.join(seeds.select("src").distinct(), "src", "left_semi")
    targets = staged(mine.filter("dst is not null").select("dst").distinct().withColumn("target", F.monotonically_increasing_id()), "targets")
    linked = staged(edges.join(targets, "dst").join(size, "src").select("src", "id", "target", "n"), "linked")
    asked = staged(linked.join(seeds.select("src").distinct(), "src", "left_semi").select("id", "target", "n"), "asked")
    blocks, parts = max(1, -(-linked.count() // BLOCK_EDGES)), max(1, -(-asked.count() // PART_EDGES))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _most_alike(_opened(a), _opened(b), k)

    # all links of a source are one row, as rows go to several tasks
    packed = lambda df: staged(df.groupBy("id", "n").agg(F.collect_list("target").alias("target")), "packed")
    found = meet(packed(asked), packed(linked), parts, blocks, best, "s long, o long, shared long")
    named = lambda i, c, n: size.select(F.col("id").alias(i), F.col("src").alias(c), F.col("n").alias(n))
    scored = found.join(named("s", "seed", "ns"), "s").join(named("o", "other", "no"), "o").withColumn("jaccard", F.round(F.col("shared") / (F.col("ns") + F.col("no") - F.col("shared")), 9))
    return top_k(scored, k, ["seed"], [F.col("jaccard").desc(), F.col("other")]).select("seed", "other", "shared", "jaccard", "rank")


def meet(asked: DataFrame, linked: DataFrame, parts: int, blocks: int, best, schema: str) -> DataFrame:
    """Rows of best(part, block), pandas functions, for each of the parts of asked with each of the blocks of linked; rows are dealt by their id."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
    right = linked.select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(best, schema)


def _opened(packed: pd.DataFrame) -> pd.DataFrame:
    """id, target, n of rows with arrays of targets."""
    many = packed["target"].map(len).to_numpy(np.int64)
    targets = np.concatenate([np.zeros(0, np.int64), *packed["target"]])
    return pd.DataFrame({"id": np.repeat(packed["id"].to_numpy(np.int64), many), "target": targets, "n": np.repeat(packed["n"].to_numpy(np.int64), many)})


def _likely(shared: np.ndarray, n_of: np.ndarray, n: int, k: int, unit: int) -> np.ndarray:
    """Places among which the k most alike to one of n targets are, by the targets that each place, of n_of targets, shares with it."""
    many = np.bincount(shared)[:0:-1].cumsum()  # how many share the most, so many or one less, and so on
    j = int(np.searchsorted(many, k))
    if j >= len(many) - 1:
        return np.flatnonzero(shared)
    floor = len(many) - j
    met = np.flatnonzero(shared >= floor)
    alike = shared[met] / (n + n_of[met] - shared[met])
    # those of fewer shared targets can't be as alike as the k-th of these, as a union has n at least
    least = max(1, math.ceil((np.partition(alike, -k)[-k] - 2 / unit) * n - 1e-6))
    return met if least >= floor else np.flatnonzero(shared >= least)


def _most_alike(asked: pd.DataFrame, linked: pd.DataFrame, k: int, unit: int = 10**9, itself: bool = False) -> pd.DataFrame:
    """s, o, shared: for each id of asked (id, target, n) the k others of linked with the greatest Jaccard in whole units, the least id of equals. itself: an id's own counts too."""
    out = []
    if len(asked) and len(linked):
        others, where = np.unique(linked["id"].to_numpy(), return_inverse=True)
        n_of = np.zeros(len(others), np.int64)
        n_of[where] = linked["n"].to_numpy()
        targets, which = np.unique(linked["target"].to_numpy(), return_inverse=True)
        order = np.argsort(which, kind="stable")
        listed, ends = where[order], np.concatenate([[0], np.bincount(which, minlength=len(targets)).cumsum()])
        asked = asked[asked["target"].isin(targets)].sort_values("id", kind="stable")
        seeds, at = np.unique(asked["id"].to_numpy(), return_index=True)
        places, n_seed = np.searchsorted(targets, asked["target"].to_numpy()), asked["n"].to_numpy()
        for seed, lo, hi in zip(seeds, at, [*at[1:], len(asked)]):
            hits = np.concatenate([listed[ends[t] : ends[t + 1]] for t in places[lo:hi]])
            if len(hits) * 8 > len(others):
                shared = np.bincount(hits, minlength=len(others))
                met = _likely(shared, n_of, int(n_seed[lo]), k + 1, unit)  # one more, as it may be the seed itself
                shared = shared[met]
            else:
                met, shared = np.unique(hits, return_counts=True)
            kept = (others[met] != seed) | itself
            met, shared = met[kept], shared[kept].astype(np.int64)
            union = n_seed[lo] + n_of[met] - shared
            if len(met) > k:
                alike = shared / union
                near = alike >= np.partition(alike, -k)[-k] - 2 / unit  # those that rounding may make equal
                met, shared, union = met[near], shared[near], union[near]
            rounded = (2 * unit * shared + union) // (2 * union)  # whole numbers: halves go up, as in round
            first = np.lexsort((met, -rounded))[:k]
            out.append((np.full(len(first), seed), others[met[first]], shared[first]))
    s, o, shared = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
    return pd.DataFrame({"s": s, "o": o, "shared": shared}, dtype="int64")


def cited_keys(references: DataFrame) -> DataFrame:
    """src, dst for coupling from rows of reference_graph: what a document cites is the document itself where that is known, else the author and year it names.

    Both kinds of keys are kept apart; of what names neither, all is one key, as in a comparison of missing values.
    """
    named = F.struct(F.lit(None).cast(references.schema["to"].dataType).alias("to"), F.col("to_author").alias("author"), F.col("to_year").alias("year"))
    sure = F.struct(F.col("to").alias("to"), F.lit(None).cast(references.schema["to_author"].dataType).alias("author"), F.lit(None).cast(references.schema["to_year"].dataType).alias("year"))
    return references.select(F.col("from").alias("src"), F.when(F.col("resolved"), sure).otherwise(named).alias("dst")).filter("src is not null").distinct()


def mentioned(seeds: DataFrame, mentions: DataFrame) -> DataFrame:
    """seed, paper: papers that name an author and a year which fit a seed: the author starts with the first four letters of one of its surnames, and the years are
    equal or the seed has none.

    seeds: seed, surnames (array), year. mentions: paper, author, year. Distinct names and years meet by equal prefixes, never by comparing all with all;
    seeds without surnames and mentions without author or year meet nothing.
    """
    some = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    wanted = seeds.select("seed", F.explode("surnames").alias("s"), some("year").alias("y")).select("seed", F.substring(F.lower(F.trim("s")), 1, 4).alias("prefix"), "y").filter("prefix <> ''").distinct()
    given = mentions.select("paper", F.lower(F.trim("author")).alias("author"), some("year").alias("year")).filter("author <> '' and year is not null").distinct()
    names = given.select("author", "year").distinct()
    keys = names.select("author", "year", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("author"), F.lit(4))), lambda i: F.substring(F.col("author"), F.lit(1), i))).alias("prefix"))
    # papers meet the prefixes that are asked for, not the seeds that ask for them; seeds without a year meet names without years
    met = wanted.select(F.col("prefix").alias("p")).distinct().join(keys, F.col("p") == F.col("prefix")).select("p", "author", "year")
    dated = wanted.select(F.col("prefix").alias("p"), F.col("y").alias("year")).filter("year is not null").distinct().join(met, ["p", "year"]).join(given, ["author", "year"]).select("p", "year", "paper").distinct()
    undated = met.select("p", "author").distinct().join(given.select("author", "paper").distinct(), "author").select("p", "paper").distinct()
    own = wanted.select("seed", F.col("prefix").alias("p"), F.col("y").alias("year"))
    return own.join(dated, ["p", "year"]).select("seed", "paper").unionByName(own.filter("year is null").join(undated, "p").select("seed", "paper")).distinct()


def first_of(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row of each group: the first strategy that found it."""
    return top_k(rows, 1, by, list(order)).drop("rank")


def hint_matches(left: DataFrame, right: DataFrame, least: Column) -> DataFrame:
    """l, r of title hints (l, tokens) and titles (r, tokens) that share at least ``least`` words; distinct hints go in once."""
    a = left.select("l", F.explode("tokens").alias("t"), F.size("tokens").alias("n"))
    b = right.select("r", F.explode("tokens").alias("t"), F.size("tokens").alias("m"))
    return a.join(b, "t").groupBy("l", "r").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m")).filter(F.col("shared") >= least)


def forward(seeds: DataFrame, verified: DataFrame, hints: DataFrame, mentions: DataFrame | None = None, one_table: bool = False) -> DataFrame:
    """seed, paper, how: papers citing a seed by a verified edge, else by a title hint that shares max(2, a third) of its words, else by naming author and year.

    seeds: seed, title, and with mentions surnames and year (see mentioned). verified: paper, seed. hints: paper, hint. mentions: paper, author, year.
    one_table: seeds and papers are documents of one table, and none cites itself.
    """
    # seeds that ask for the same words, names and year are a class: papers meet classes, and only the last step opens these up, without a shuffle of its pairs
    asks = [F.array_sort(F.array_distinct(words(F.col("title")))).alias("tokens")] + ([F.col("surnames"), F.col("year").cast("string").alias("year")] if mentions is not None else [])
    asked = seeds.filter("seed is not null").groupBy("seed").agg(F.sort_array(F.collect_set(F.struct(*asks))).alias("asks"))
    classes = staged(asked.groupBy("asks").agg(F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    size = F.ceil(F.col("n") / PIECE)
    members = staged(asked.join(classes, "asks").select("class", size.alias("pieces"), F.pmod(F.xxhash64("seed"), size).alias("piece"), "seed"), "members")
    each = classes.select("class", F.posexplode("asks").alias("i", "a"))
    titles = each.select(F.struct("class", "i").alias("l"), "a.tokens")
    named = hints.select(F.col("hint").alias("r")).distinct().withColumn("tokens", F.array_distinct(words(F.col("r"))))
    near = hint_matches(titles, named, F.greatest(F.lit(2.0), F.col("n") / 3)).select("l.class", F.col("r").alias("hint")).distinct()
    guessed = near.join(hints.distinct(), "hint").select("class", "paper").distinct().withColumn("p", F.lit(2))
    if mentions is not None:
        by_name = mentioned(each.select(F.col("class").alias("seed"), "a.surnames", "a.year"), mentions).select(F.col("seed").alias("class"), "paper", F.lit(3).alias("p"))
        guessed = guessed.unionByName(by_name).groupBy("class", "paper").agg(F.min("p").alias("p"))
    sure = staged(verified.join(seeds.select("seed"), "seed", "left_semi").select("seed", "paper").distinct(), "sure")
    taken = sure.join(members, "seed").groupBy(F.col("class").alias("_c"), F.col("paper").alias("_p")).agg(F.collect_set("seed").alias("taken"), F.collect_set("piece").alias("spots"))
    how = F.when(F.col("p") == 2, "hint").otherwise("author_year").alias("how")
    places = guessed.join(taken, (F.col("class") == F.col("_c")) & F.col("paper").eqNullSafe(F.col("_p")), "left").select("class", "paper", how, "taken", "spots")
    # a piece has about PIECE seeds, however many a class has; rows get many only when they are opened, so their number of partitions is kept, and pieces come to them
    parts, n = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    pieces = staged(members.groupBy("class", "pieces", "piece").agg(F.collect_list("seed").alias("all")), "pieces")
    open_ = places.repartition(parts, "class", "paper").join(small(pieces, n, OPENED), "class")
    left = F.when(F.array_contains("spots", F.col("piece")), F.array_except("all", "taken")).otherwise(F.col("all"))
    sure = sure.select("seed", "paper", F.lit("verified").alias("how"))
    if not one_table:
        return sure.unionByName(open_.select(F.explode(left).alias("seed"), "paper", "how"))
    sure, open_ = sure.filter("seed <> paper"), open_.filter("paper is not null")
    if guessed.schema["paper"].dataType != members.schema["seed"].dataType:
        return sure.unionByName(open_.select(F.explode(left).alias("seed"), "paper", "how").filter("seed <> paper"))
    # a paper that is a seed can only be in one piece of a class
    itself = F.pmod(F.xxhash64("paper"), F.col("pieces")) == F.col("piece")
    return sure.unionByName(open_.select(F.explode(F.when(itself, F.array_remove(left, F.col("paper"))).otherwise(left)).alias("seed"), "paper", "how"))


def backward(refs: DataFrame, library: DataFrame) -> DataFrame:
    """paper, hint, target, how: a reference's verified target, else the best title of Jaccard 0.5 or more, else unresolved.

    refs: paper, hint, verified (nullable). library: id, title.
    """
    # likeness is one of sets of words: hints and titles of the same words meet once, and of the titles the least id is the best
    kind = lambda text: F.array_sort(F.array_distinct(words(F.col(text))))
    named = staged(refs.select("hint", kind("hint").alias("l")).distinct(), "hints")
    hints = named.select("l", F.col("l").alias("tokens")).distinct()
    titles = library.groupBy(kind("title").alias("tokens")).agg(F.min("id").alias("r"))
    j = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    best = first_of(hint_matches(hints, titles, F.lit(1)).withColumn("j", F.round(j, 9)).filter("j >= 0.5"), ["l"], F.col("j").desc(), F.col("r")).select("l", F.col("r").alias("guess"))
    best = named.join(best, "l").select("hint", "guess")
    out = refs.join(best, "hint", "left")
    how = F.when(F.col("verified").isNotNull(), "verified").when(F.col("guess").isNotNull(), "title").otherwise("unresolved")
    return out.select("paper", "hint", F.coalesce("verified", "guess").alias("target"), how.alias("how"))


def reference_graph(docs: DataFrame, verified: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """from, to, to_author, to_year, to_title_hint, resolved: the citations that documents' texts make (see cited) and, resolved, the verified ones (src, dst)
    between different documents that exist, each once."""
    raw = cited(docs, key, text).select("from", F.lit(None).cast(docs.schema[key].dataType).alias("to"), "to_author", "to_year", "to_title_hint", F.lit(False).alias("resolved"))
    known = docs.select(F.col(key).alias("_k")).distinct()
    sure = verified.select("src", "dst").filter("src <> dst").distinct()
    sure = sure.join(known, F.col("src") == F.col("_k"), "left_semi").join(known, F.col("dst") == F.col("_k"), "left_semi")
    none = F.lit(None).cast("string")
    return raw.unionByName(sure.select(F.col("src").alias("from"), F.col("dst").alias("to"), none.alias("to_author"), none.alias("to_year"), none.alias("to_title_hint"), F.lit(True).alias("resolved")))


def neighbours(seeds: DataFrame, edges: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """seed, node, how: papers beside a seed; cited_by wins over cites, both over named, which are papers that a seed's unresolved citations name by author and
    year (source, paper; see bibliography.cited_by_name)."""
    a = seeds.join(edges, F.col("seed") == F.col("dst")).select("seed", F.col("src").alias("node"), F.lit("cited_by").alias("how"), F.lit(1).alias("p"))
    b = seeds.join(edges, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit("cites").alias("how"), F.lit(2).alias("p"))
    if named is None:
        # one pass over the edges: each as both of its ends see it, dealt by who sees it
        kept = staged(edges.select("src", "dst"), "edges")
        see = lambda seed, node, how, p: F.struct(F.col(seed).alias("seed"), F.col(node).alias("node"), F.lit(how).alias("how"), F.lit(p).alias("p"))
        ends = kept.select(F.explode(F.array(see("dst", "src", "cited_by", 1), see("src", "dst", "cites", 2))).alias("e")).select("e.*")
        n = seeds.count()
        ends = dealt(ends, "seed", rows=EDGES_A_TASK).join(small(seeds.select("seed").distinct(), n, MOST_NODES), "seed", "left_semi")
        return ends.groupBy("seed", "node").agg(F.min(F.struct("p", "how")).alias("m")).select("seed", "node", F.col("m.how").alias("how"))
    both = a.unionByName(b)
    if named is not None:
        both = both.unionByName(named.join(seeds, F.col("seed") == F.col("source")).select("seed", F.col("paper").alias("node"), F.lit("named").alias("how"), F.lit(3).alias("p")))
    return first_of(both.distinct(), ["seed", "node"], F.col("p")).drop("p")


def resolve(targets: DataFrame, registry: DataFrame, tolerance: int = 1) -> DataFrame:
    """surname, secondary, year, hint, key, score, gap, tier, method: the record that a cited (surname, secondary, year, hint) means.

    Records that any author's surname names, within ``tolerance`` years, are scored 0.55 for the surname (0.6 of it if it isn't the first author's), 0.35 for the
    year (half of it beside it) and 0.10 for the second surname (minus that if the record lacks it); with a hint that is seven tenths, and the blended
    similarity of the titles three. Ties go to more citations, more citations inside, the lesser key. Strong needs 0.90 and a gap of 0.10 to the
    runner-up, weak 0.55. registry: key, surname (the first author's), surnames, year, title, citations, in_corpus.
    """
    asked = ["surname", "secondary", "year", "hint"]
    once = targets.select(*asked).distinct()
    # titles and hints are tokenized once each, before they meet
    near = once.filter("surname <> '' and year > 0").withColumn("_a", F.array_sort(tt.title_tokens(F.col("hint")))).withColumn("_y", F.explode(F.sequence(F.col("year") - tolerance, F.col("year") + tolerance)))
    records = registry.filter("year is not null").select("key", F.col("surname").alias("_first"), F.array_sort(F.array_distinct("surnames")).alias("surnames"), F.col("year").alias("_y"), F.array_sort(tt.title_tokens(F.col("title"))).alias("_b"), F.coalesce("citations", F.lit(0)).alias("_c"), F.coalesce("in_corpus", F.lit(0)).alias("_i"), F.explode(F.array_distinct("surnames")).alias("surname"))
    # records of the same names, year and title words score alike, so two of them do; so do, of those of the same names, the two whose titles are nearest to a hint's words
    tie, names = [F.col("_c").desc(), F.col("_i").desc(), F.col("key")], ["_first", "surnames"]
    alike = top_k(records, 2, ["surname", "_y", *names, "_b"], tie).drop("rank")
    title = F.when((F.size("_a") == 0) | (F.size("_b") == 0), 0.0).otherwise(tt.blended_similarity(F.col("_a"), F.col("_b")))
    titled = near.select("surname", "_y", "_a").distinct().join(alike, ["surname", "_y"]).withColumn("_t", title)
    nearest = top_k(titled, 2, ["surname", "_y", "_a", *names], [F.round(0.3 * F.col("_t"), 9).desc(), *tie]).drop("rank")
    pairs = near.join(nearest, ["surname", "_y", "_a"])
    first, second = F.col("surname") == F.col("_first"), F.coalesce(F.col("secondary"), F.lit("")) != ""
    met = F.array_contains("surnames", F.col("secondary"))
    base = 0.55 * F.when(first, 1.0).otherwise(0.6) + 0.35 * F.when(F.col("_y") == F.col("year"), 1.0).otherwise(0.5) + 0.10 * F.when(second, F.when(met, 1.0).otherwise(-1.0)).otherwise(0.0)
    method = F.concat_ws("+", F.when(first, "first_author").otherwise("any_author"), F.when(F.col("_y") == F.col("year"), "year").otherwise(F.concat(F.lit("year_off"), F.abs(F.col("_y") - F.col("year")).cast("string"))), F.when(second, F.when(met, "coauthor_match").otherwise("coauthor_miss")))
    scored = pairs.withColumn("score", F.round(F.when(F.coalesce("hint", F.lit("")) != "", 0.7 * base + 0.3 * F.col("_t")).otherwise(base), 9)).withColumn("method", method)
    order = [F.col("score").desc(), *tie]
    ranked = top_k(scored, 2, asked, order).withColumn("gap", F.round(F.col("score") - F.lead("score").over(Window.partitionBy(*asked).orderBy(*order)), 9)).filter("rank = 1")
    tied = F.coalesce(F.col("gap") < GAP, F.lit(False))
    tier = F.when((F.col("score") >= STRONG) & ~tied, "strong").when(F.col("score") >= WEAK, "weak").otherwise("unmatched")
    found = ranked.select(*asked, "key", "score", "gap", tier.alias("tier"), F.concat("method", F.when(tied, "+tiebreak").otherwise("")).alias("method"))
    found = found.withColumn("key", F.when(F.col("tier") != "unmatched", F.col("key"))).withColumn("method", F.when(F.col("tier") == "unmatched", "low_score").otherwise(F.col("method")))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in asked]
    out = once.alias("t").join(found.alias("f"), same[0] & same[1] & same[2] & same[3], "left")
    bad = F.coalesce((F.col("t.surname") == "") | (F.col("t.year") <= 0), F.lit(True))
    return out.select(*[F.col(f"t.{c}").alias(c) for c in asked], "f.key", F.coalesce("f.score", F.lit(0.0)).alias("score"), "f.gap", F.coalesce("f.tier", F.lit("unmatched")).alias("tier"), F.coalesce("f.method", F.when(bad, "bad_target").otherwise("no_candidate")).alias("method"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, rank after a fixed number of rounds; the mass of nodes without targets is shared by all."""
    edges = staged(edges.distinct(), "edges")
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = edges.join(out, "src").repartition("src").cache()
    nodes = staged(nodes_of(edges).join(out.withColumnRenamed("src", "node"), "node", "left").select("node", "out"), "nodes")
    n = nodes.count()
    rank, kept = nodes.select("node", "out", F.lit(1.0 / max(n, 1)).alias("rank")), []
    for i in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        sent = weighted.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = nodes.join(sent, "node", "left").join(F.broadcast(lost)).select("node", "out", ((1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        # a round uses the last one twice: kept rows serve that, and every EVERY rounds a table cuts the lineage, so that a lost executor costs few rounds
        if i % EVERY == EVERY - 1 or i == rounds - 1:
            rank = staged(rank, "rank")
            while kept:
                kept.pop().unpersist()
        else:
            rank = rank.persist()
            kept.append(rank)
    weighted.unpersist()
    return rank.select("node", "rank")


def hits(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, authority, hub after a fixed number of rounds, each normalized to sum 1."""
    edges = staged(edges.distinct(), "edges")
    # of each node the edges in and out lie in one place; values of nodes go to them where these are few, so that a round shuffles sums of nodes only
    into, out = (staged(dealt(edges, side).sortWithinPartitions(side), "edges") for side in ("dst", "src"))
    nodes = staged(nodes_of(edges), "nodes")
    n = nodes.count()
    state = nodes.withColumn("authority", F.lit(1.0)).withColumn("hub", F.lit(1.0))
    for _ in range(rounds):
        a = into.join(small(state.select(F.col("node").alias("src"), "hub"), n, MOST_NODES), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("a"))
        a = staged(a, "authorities")
        total = a.agg(F.sum("a").alias("ta"))
        a = a.join(F.broadcast(total)).select("node", (F.col("a") / F.col("ta")).alias("authority"))
        h = out.join(small(a.select(F.col("node").alias("dst"), "authority"), n, MOST_NODES), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("h"))
        h = staged(h, "hubs")
        h = h.join(F.broadcast(h.agg(F.sum("h").alias("th")))).select("node", (F.col("h") / F.col("th")).alias("hub"))
        state = nodes.join(a, "node", "left").join(h, "node", "left").select("node", F.coalesce("authority", F.lit(0.0)).alias("authority"), F.coalesce("hub", F.lit(0.0)).alias("hub"))
        state = staged(state, "hits")
    return state


def degree_hits(edges: DataFrame) -> DataFrame:
    """node, authority, hub as shares of all edges: the fallback where HITS doesn't converge."""
    each = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    n = edges.agg(F.count("*").alias("n"))
    return each.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).join(F.broadcast(n)).select("node", (F.col("i") / F.col("n")).alias("authority"), (F.col("o") / F.col("n")).alias("hub"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that edges, in either direction, join a node with. Rounds of least neighbours and their labels' labels until nothing changes."""
    near = staged(both_ways(edges), "near")
    labels = staged(near.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        low = near.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        mid = staged(labels.join(low, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("component")), "mid")
        up = mid.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = staged(mid.join(up, "component").select("node", "was", F.least("component", "up").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.filter("was <> component").isEmpty():
            return labels


def _by_component(edges: DataFrame, starts: DataFrame, most_edges: int):
    """Edges (src, dst) and starts (node) dealt out by components of at most ``most_edges`` edges, whole components' edges with each part of their starts, for a cogroup
    by component and part; and the edges and starts of larger components."""
    at = components(edges)
    placed = edges.join(at.toDF("src", "component"), "src")
    sizes = placed.groupBy("component").agg(F.count("*").alias("m"))
    asked = starts.join(at, "node")
    sizes = staged(sizes.join(asked.groupBy("component").agg(F.ceil(F.count("*") / STARTS).alias("parts")), "component"), "components")
    placed, asked = placed.join(sizes, "component"), asked.join(sizes, "component")
    small, large = F.col("m") <= most_edges, F.col("m") > most_edges
    left = placed.filter(small).select("component", "src", "dst", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = asked.filter(small).select("component", "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    # a group's work is far more than its bytes, so the number of partitions is kept
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = left.repartition(n, "component", "part").groupBy("component", "part").cogroup(right.repartition(n, "component", "part").groupBy("component", "part"))
    return groups, placed.filter(large).select("src", "dst", "component"), asked.filter(large).select("node", "component")


def _numbered(edges: pd.DataFrame, starts: pd.DataFrame) -> tuple:
    """names, src, dst and starts as numbers, edges sorted by dst."""
    names, ends = np.unique(np.concatenate([edges["src"].to_numpy(), edges["dst"].to_numpy()]), return_inverse=True)
    src, dst = ends[: len(edges)].astype(np.int32), ends[len(edges) :].astype(np.int32)
    order = np.argsort(dst, kind="stable")
    return names, src[order], dst[order], np.searchsorted(names, starts["node"].to_numpy())


def _dense(n: int, m: int) -> bool:
    """Is a graph better kept as a matrix?"""
    return n <= DENSE and m * 64 >= n * n


def _numbers(nodes: DataFrame) -> DataFrame:
    """node, i: nodes numbered from 0 without gaps."""
    placed = staged(nodes.select("node", F.monotonically_increasing_id().alias("_m")), "placed")  # a task's number, then 33 bits of the row's
    task = F.shiftright("_m", 33)
    counts = placed.groupBy(task.alias("_p")).agg(F.count("*").alias("_n"))  # one row for each task
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return staged(placed.join(F.broadcast(before), task == F.col("_p")).select("node", (F.col("_m") - F.shiftleft(task, 33) + F.col("_b")).cast("int").alias("i")), "numbers")


def _by_number(edges: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """s, d: edges between numbers of at most MOST_NODES nodes."""
    of = lambda end, c: small(numbers.select(F.col("node").alias(end), F.col("i").alias(c)), n, MOST_NODES)
    return staged(edges.join(of("src", "s"), "src").join(of("dst", "d"), "dst").select("s", "d"), "numbered")


def _ranged(links: DataFrame, m: int, by: str) -> DataFrame:
    return links.repartitionByRange(max(1, -(-m // EDGES_A_TASK)), by).sortWithinPartitions(by)


def _links(links: DataFrame, n: int, m: int, by: str, other: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the links of each of n numbers begin, and their other ends, four bytes each."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, many = np.unique(b[by].to_numpy(), return_counts=True)
            if len(at):
                parts = [at, many.astype(np.int32), b[other].to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([int(at[0])], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["first", "at", "many", "ends"])

    rows = _ranged(links, m, by).mapInArrow(packed, "first int, at binary, many binary, ends binary").collect()
    rows.sort(key=lambda r: r["first"])  # a range's batches are in order; of a node that two of them have, either may come first
    begin, ends, filled = np.zeros(n + 1, np.int64), np.empty(m, np.int32), 0
    for r in rows:
        begin[np.frombuffer(r["at"], np.int32) + 1] += np.frombuffer(r["many"], np.int32)
        some = np.frombuffer(r["ends"], np.int32)
        ends[filled : filled + len(some)] = some
        filled += len(some)
    return np.cumsum(begin), ends


def _ends(begin: np.ndarray, ends: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The other ends of the links of some nodes, node after node."""
    lo, hi = begin[nodes], begin[nodes + 1]
    many = hi - lo
    total = int(many.sum())
    if total > 16 * len(nodes):
        return np.concatenate([ends[a:b] for a, b in zip(lo.tolist(), hi.tolist())])
    return ends[np.arange(total) + np.repeat(lo - (np.cumsum(many) - many), many)]


def reachable(seeds: DataFrame, edges: DataFrame, hops: int, most_edges: int = MOST_EDGES) -> DataFrame:
    """seed, node, hops: nodes within so many undirected steps, with the least number of steps.

    A graph of at most ``most_edges`` edges is sent to the tasks as arrays of numbers, and the seeds are dealt out over them. Of a larger one, components of at most
    GROUP_EDGES edges in both directions are walked in tasks, from many seeds at once; larger ones by joins on rows of seed and node.
    """
    near = staged(both_ways(edges).toDF("src", "dst"), "near")
    if most_edges < 1:
        return _reached_by_joins(seeds, near, hops)
    kind = near.schema["src"].dataType.simpleString()
    itself = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    m = near.count()
    nodes = staged(near.select(F.col("src").alias("node")).distinct(), "nodes")
    n = nodes.count()
    if m <= 2 * most_edges and n <= MOST_NODES:
        return itself.unionByName(_reached_by_arrays(seeds, near, nodes, n, m, hops))
    groups, far, rest = _by_component(near, seeds.select(F.col("seed").alias("node")).distinct(), min(most_edges, GROUP_EDGES))

    def walk(links: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"seed": starts["node"][:0], "node": starts["node"][:0], "hops": np.zeros(0, np.int32)})]
        if len(links) and len(starts):
            names, src, dst, at = _numbered(links, starts)
            n, m = len(names), len(src)
            matrix = None
            if _dense(n, m):
                matrix = np.zeros((n, n), np.float32)
                matrix[dst, src] = 1
            into, heads = np.unique(dst, return_index=True)
            size = STARTS if matrix is not None else max(1, min(64, CELLS // m))
            for lo in range(0, len(at), size):
                some = at[lo : lo + size]
                level = np.full((n, len(some)), -1, np.int32)
                level[some, np.arange(len(some))] = 0
                for h in range(1, hops + 1):
                    front = level == h - 1
                    if matrix is not None:
                        got = matrix @ front.astype(np.float32) > 0
                    else:
                        got = np.zeros_like(front)
                        got[into] = np.logical_or.reduceat(front[src], heads, axis=0)
                    level[got & (level < 0)] = h
                who, where = np.nonzero(level.T > 0)
                out.append(pd.DataFrame({"seed": names[some[who]], "node": names[where], "hops": level.T[who, where]}))
        return pd.concat(out)

    found = groups.applyInPandas(walk, f"seed {kind}, node {kind}, hops int")
    out = itself.unionByName(found)
    rest = rest.select(F.col("node").alias("seed"))
    return out if rest.isEmpty() else out.unionByName(_reached_by_joins(rest, far, hops).filter("hops > 0"))


def _reached_by_arrays(seeds: DataFrame, near: DataFrame, nodes: DataFrame, n: int, m: int, hops: int) -> DataFrame:
    """seed, node, hops over 0. A seed is walked alone, and no further than to the last node there is."""
    kind, spark = near.schema["src"].dataType.simpleString(), near.sparkSession
    numbers = _numbers(nodes)
    begin, ends = _links(_by_number(near, numbers, n), n, m, "s", "d")
    graph = spark.sparkContext.broadcast((begin, ends, numbers.orderBy("i").select("node").toArrow()["node"].combine_chunks()))  # at most MOST_NODES names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, ends, names = graph.value
        seen, found, waits = np.zeros(n, bool), [], 0

        def rows() -> pa.RecordBatch:
            who, where, step = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([names.take(pa.array(who)), names.take(pa.array(where)), pa.array(step)], ["seed", "node", "hops"])

        for batch in batches:
            for s in batch["i"].to_numpy():
                seen[s] = True
                fronts = [np.array([s])]
                met = 1
                for _ in range(hops):
                    new, front = [], fronts[-1]
                    # the links of a part of the front at a time, as often a few of them lead to all there is
                    for some in np.split(front, np.flatnonzero(np.diff((begin[front + 1] - begin[front]).cumsum() // max(n, 4096))) + 1):
                        if met == n or not len(some):
                            break
                        to = _ends(begin, ends, some)
                        if len(to) * 8 < n:
                            to = np.unique(to)
                            to = to[~seen[to]]
                        else:
                            hit = np.zeros(n, bool)
                            hit[to] = True
                            to = np.flatnonzero(hit & ~seen)
                        seen[to] = True
                        met += len(to)
                        new.append(to)
                    fronts.append(np.concatenate(new) if new else np.zeros(0, np.int64))
                for h, front in enumerate(fronts):
                    seen[front] = False
                    if h and len(front):
                        found.append((np.full(len(front), s, np.int32), front.astype(np.int32), np.full(len(front), h, np.int32)))
                waits += met
                if waits > FOUND and found:
                    yield rows()
                    found, waits = [], 0
        if found:
            yield rows()

    asked = numbers.join(seeds.select(F.col("seed").alias("node")).distinct(), "node", "left_semi").select("i")
    tasks = max(1, min(-(-n // 64), spark.sparkContext.defaultParallelism * 4))
    return asked.repartition(tasks, "i").mapInArrow(walk, f"seed {kind}, node {kind}, hops int")


def _reached_by_joins(seeds: DataFrame, near: DataFrame, hops: int) -> DataFrame:
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(near, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community by synchronous label propagation: the commonest label beside a node, the least of equals."""
    # of each node all edges lie in one place; labels go to them where nodes are few, so that a round shuffles no edges
    near = staged(_dealt_both_ways(edges).sortWithinPartitions("a"), "near")
    n = near.select("a").distinct().count()
    labels = near.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for i in range(rounds):
        labels = staged(labels, "labels") if n <= MOST_NODES or i % 7 == 6 else labels
        seen = near.join(small(labels.select(F.col("node").alias("b"), "label"), n, MOST_NODES), "b").groupBy(F.col("a").alias("node"), "label").agg(F.count("*").alias("n"))
        labels = seen.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("node", "m.label")
    return by_size(labels.withColumnRenamed("label", "community"))


def by_size(parts: DataFrame) -> DataFrame:
    """Communities numbered from the largest, the one with the least node first of equals, with their size.

    Communities are dealt out by ranges of that order; a number is a community's place in its range and the communities in the ranges before.
    """
    sizes = parts.groupBy("community").agg(F.count("*").alias("community_size"), F.min("node").alias("first")).withColumn("_o", -F.col("community_size"))
    ranged = staged(sizes.repartitionByRange("_o", "first").withColumn("_p", F.spark_partition_id()), "sizes")
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row for each range
    before = before.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    numbered = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_o", "first")) - 1).join(F.broadcast(before), "_p")
    return parts.join(numbered.select("community", (F.col("_b") + F.col("_r")).cast("long").alias("community_id"), "community_size"), "community").select("node", "community_id", "community_size")


def louvain(edges: DataFrame, rounds: int = 10, levels: int = 10, least_gain: float = 1e-7) -> DataFrame:
    """node, community_id, community_size by the Louvain method on the undirected graph, deterministic and in rounds of joins.

    In a round every node weighs the modularity that moving to a neighbour's community would gain, from sums of all communities. Nodes are dealt by hash to two
    halves that move in turn, so that neighbours don't just swap places, and a single node moves to another single one only where that has the
    lesser name. When modularity gains less than ``least_gain`` the communities become the nodes of a smaller, weighted graph, until nothing merges.
    """
    near = _dealt_both_ways(edges).filter("a <> b")
    links = staged(near.select("a", "b", F.lit(1.0).alias("w")), "links")  # each edge in both directions; loops of later levels once, with both ends' weight
    total = links.agg(F.sum("w").alias("t")).first()["t"] or 0.0
    whole = nodes_of(edges).select("node", F.col("node").alias("community"))
    if not total:
        return by_size(whole)
    for _ in range(levels):
        at = staged(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node")), "at")
        best, moved_any = None, False
        for r in range(rounds):
            after = _local_moves(_local_moves(at, links, total, 2 * r), links, total, 2 * r + 1)
            quality = _weighted_modularity(after, links, total)
            before = _weighted_modularity(at, links, total) if best is None else best
            if quality - before < least_gain:
                break
            at, best, moved_any = after, quality, True
        if not moved_any:
            break
        to = staged(at.select("node", "community"), "to")
        whole = staged(whole.withColumnRenamed("community", "_c").join(to.toDF("_c", "community"), "_c", "left").select("node", F.coalesce("community", "_c").alias("community")), "whole")
        links = staged(links.join(to.toDF("a", "ca"), "a").join(to.toDF("b", "cb"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "links")
    return by_size(whole)


def _local_moves(at: DataFrame, links: DataFrame, total: float, turn: int) -> DataFrame:
    """at (node, k, community) after the nodes of one half have moved to where modularity gains most."""
    sums = at.groupBy("community").agg(F.sum("k").alias("s"), F.count("*").alias("n"))
    into = links.filter("a <> b").join(at.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
    own = at.select("node", "k", F.col("community").alias("own"))
    rows = into.join(own, "node").join(sums, "community")
    # without itself: a node's own community loses the node's weight
    gain = F.col("w") - F.col("k") * (F.col("s") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / total
    single = sums.select(F.col("community").alias("own"), F.col("n").alias("n_own"))
    rows = rows.join(single, "own").filter((F.col("community") <= F.col("own")) | (F.col("n_own") > 1) | (F.col("n") > 1))
    best = rows.withColumn("g", F.round(gain, 9)).groupBy("node").agg(F.min(F.struct((-F.col("g")).alias("g"), (F.col("community") != F.col("own")).alias("away"), "community")).alias("m"), F.max(F.when(F.col("community") == F.col("own"), F.col("g"))).alias("stay"))
    # staying alone gains nothing; a node without a neighbour in its own community compares with leaving it
    base = at.select("node", "k", "community").join(sums, "community").select("node", F.round(-F.col("k") * (F.col("s") - F.col("k")) / total, 9).alias("left"))
    turnwise = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
    moved = at.join(best, "node", "left").join(base, "node")
    target = F.when(turnwise & (-F.col("m.g") > F.coalesce("stay", "left")), F.col("m.community")).otherwise(F.col("community"))
    return staged(moved.select("node", "k", target.alias("community")), "moves")


def _weighted_modularity(at: DataFrame, links: DataFrame, total: float) -> float:
    of = lambda c: at.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    inside = links.join(of("a"), "a").join(of("b"), "b").filter("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("i")).first()["i"]
    share = at.groupBy("community").agg((F.sum("k") / total).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s")).first()["s"]
    return inside / total - (share or 0.0)


def graph_fingerprint(metrics: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row: fingerprint, which changes with the nodes, their communities or the number of edges. metrics: node, community_id.

    A digest of all rows in order would need them in one place; the sum of the rows' hashes needs no order.
    """
    each = F.xxhash64(F.col("node").cast("string"), F.coalesce(F.col("community_id").cast("string"), F.lit("None")))
    out = metrics.agg(F.count("*").alias("n"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).alias("h"))
    n_edges = edges.agg(F.count("*").alias("e")) if edges is not None else metrics.sparkSession.range(1).select(F.lit(None).cast("long").alias("e"))
    return out.join(F.broadcast(n_edges)).select(F.substring(F.sha1(F.concat_ws("|", F.concat(F.lit("n="), F.col("n").cast("string")), F.col("h").cast("string"), F.concat(F.lit("e="), F.col("e").cast("string")))), 1, 12).alias("fingerprint"))


def distribution(values: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, min, median, mean, max, nonzero of each column's values, nulls left out; the median of an even number is the middle of two."""
    rows = values.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v is not null")
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.count_if(F.col("v") > 0).alias("nonzero"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: modularity of a partition (node, community_id) of the undirected graph."""
    near = staged(_dealt_both_ways(edges), "near")
    n = parts.count()
    of = lambda c: small(parts.select(F.col("node").alias(c), F.col("community_id").alias(f"c{c}")), n, MOST_NODES)
    m2 = near.count()
    inside = near.join(of("a"), "a").join(of("b"), "b").agg(F.sum((F.col("ca") == F.col("cb")).cast("double")).alias("e")).first()["e"] or 0.0
    share = near.join(of("a"), "a").groupBy("ca").agg((F.count("*") / m2).alias("s")).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("s"))
    return share.select((F.lit(inside / max(m2, 1)) - F.col("s")).alias("modularity"))


def _brandes(n: int, src: np.ndarray, dst: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Brandes' dependency sums of some sources, level by level for all of them together. Edges are sorted by dst."""
    cols = np.arange(len(sources))
    paths, level = np.zeros((n, len(sources))), np.full((n, len(sources)), -1, np.int32)
    paths[sources, cols], level[sources, cols] = 1.0, 0
    into, heads = np.unique(dst, return_index=True)
    by_src = np.argsort(src, kind="stable")
    out_of, tails = np.unique(src[by_src], return_index=True)
    depth = 0
    while True:
        got = np.add.reduceat(np.where(level[src] == depth, paths[src], 0.0), heads, axis=0)
        new = (level[into] < 0) & (got > 0)
        if not new.any():
            break
        depth += 1
        paths[into] += np.where(new, got, 0.0)
        level[into] = np.where(new, depth, level[into])
    share = np.zeros_like(paths)
    for d in range(depth, 0, -1):
        part = np.where((level[dst] == d) & (level[src] == d - 1), paths[src] / np.maximum(paths[dst], 1.0) * (1.0 + share[dst]), 0.0)
        share[out_of] += np.add.reduceat(part[by_src], tails, axis=0)
    share[sources, cols] = 0.0
    return share.sum(1)


def _brandes_dense(n: int, src: np.ndarray, dst: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """The same sums, where a product of matrices takes a level of all paths."""
    links, cols = np.zeros((n, n)), np.arange(len(sources))
    links[src, dst] = 1.0
    paths, level = np.zeros((n, len(sources))), np.full((n, len(sources)), -1, np.int32)
    paths[sources, cols], level[sources, cols] = 1.0, 0
    depth = 0
    while True:
        got = links.T @ np.where(level == depth, paths, 0.0)
        new = (level < 0) & (got > 0)
        if not new.any():
            break
        depth += 1
        paths[new], level[new] = got[new], depth
    share = np.zeros_like(paths)
    for d in range(depth, 0, -1):
        share += np.where(level == d - 1, paths * (links @ np.where(level == d, (1.0 + share) / np.maximum(paths, 1.0), 0.0)), 0.0)
    share[sources, cols] = 0.0
    return share.sum(1)


def _added(at: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers under n that are met, and the sums of their weights."""
    if len(at) * 8 < n:
        met, place = np.unique(at, return_inverse=True)
        return met, np.bincount(place, weights, len(met))
    sums = np.bincount(at, weights, n)
    met = np.flatnonzero(sums)
    return met, sums[met]


def _pulled(begin: np.ndarray, ends: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of some nodes, which all have links, the sum of the values at their other ends."""
    many = begin[nodes + 1] - begin[nodes]
    return np.add.reduceat(values[_ends(begin, ends, nodes)], np.cumsum(many) - many)


def _brandes_walk(n: int, out: tuple[np.ndarray, np.ndarray], into: tuple[np.ndarray, np.ndarray], sources: np.ndarray) -> np.ndarray:
    """The same sums, source by source along the links of the nodes that it reaches: at each level those out of the nodes reached last, or those into the nodes not reached yet, whichever are fewer."""
    n_out, n_in = np.diff(out[0]), np.diff(into[0])
    paths, share, front_of, level, total = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1, np.int32), np.zeros(n)
    for s in sources:
        paths[s], level[s] = 1.0, 0
        fronts, open_in, met = [np.array([s])], int(n_in.sum() - n_in[s]), 1
        while met < n:
            front = fronts[-1]
            if n_out[front].sum() <= open_in:
                to, got = _added(_ends(*out, front), np.repeat(paths[front], n_out[front]), n)
                new = level[to] < 0
            else:
                to = np.flatnonzero((level < 0) & (n_in > 0))
                front_of[front] = paths[front]
                got = _pulled(*into, to, front_of) if len(to) else np.zeros(0)
                front_of[front] = 0.0
                new = got > 0
            to, got = to[new], got[new]
            if not len(to):
                break
            paths[to], level[to] = got, len(fronts)
            fronts.append(to)
            open_in, met = open_in - int(n_in[to].sum()), met + len(to)
        for d in range(len(fronts) - 1, 0, -1):
            low, high = fronts[d - 1], fronts[d]
            each = (1.0 + share[high]) / paths[high]
            if n_out[low].sum() <= n_in[high].sum():
                low = low[n_out[low] > 0]
                front_of[high] = each
                share[low] = paths[low] * _pulled(*out, low, front_of)
                front_of[high] = 0.0
            else:
                at, sums = _added(_ends(*into, high), np.repeat(each, n_in[high]), n)
                is_low = level[at] == d - 1
                at = at[is_low]
                share[at] = paths[at] * sums[is_low]
        for d, front in enumerate(fronts):
            if d:
                total[front] += share[front]
            paths[front], share[front], level[front] = 0.0, 0.0, -1
    return total


def _dependencies(n: int, out: tuple[np.ndarray, np.ndarray], into: tuple[np.ndarray, np.ndarray], sources: np.ndarray) -> np.ndarray:
    """Sums of all sources: of small or dense graphs in batches, else one by one. out, into: where each node's links begin, and their other ends."""
    m = len(into[1])
    dense = _dense(n, m)
    if not dense and m > FEW_EDGES:
        return _brandes_walk(n, out, into, sources)
    src, dst = into[1], np.repeat(np.arange(n, dtype=np.int32), np.diff(into[0]))
    total, size = np.zeros(n), STARTS if dense else max(1, min(64, CELLS // max(m, 1)))
    for lo in range(0, len(sources), size):
        total += (_brandes_dense if dense else _brandes)(n, src, dst, sources[lo : lo + size])
    return total


def betweenness(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """node, betweenness (directed, normalized), exact.

    A graph of at most ``most_edges`` edges is sent to the tasks as arrays of numbers, and the sources are dealt out over them. A larger one is never
    gathered: its components of at most GROUP_EDGES edges go to tasks each, larger ones as arrays as many at a time as ``most_edges`` allows, and one of still more edges stays dealt
    out in blocks, past which some sources at a time are walked level by level (by joins on rows of source and node, if it has more than MOST_NODES nodes).
    """
    edges = staged(edges.select("src", "dst").distinct(), "edges")
    nodes = staged(nodes_of(edges), "nodes")
    n, m = nodes.count(), edges.count()
    total = _between_by_arrays(edges, nodes, n, m) if m <= most_edges and n <= MOST_NODES else _between_by_components(edges, nodes, most_edges)
    return nodes.join(total, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) / max((n - 1) * (n - 2), 1)).alias("betweenness"))


def sources_needed(n: int, error: float, risk: float) -> int:
    """How many of n sources bring the error of every node's betweenness under ``error``, but for a chance of ``risk`` that one is further off.

    What a source adds to a node is at most n - 2 of (n - 1)(n - 2), so by Hoeffding's inequality, which holds without replacement too, and a union over the nodes,
    the number grows with the logarithm of n only.
    """
    return n if n < 3 else min(n, math.ceil((n / (n - 1)) ** 2 * math.log(2 * n / risk) / (2 * error**2)))


def betweenness_sampled(edges: DataFrame, error: float = 0.01, risk: float = 0.05, most_edges: int = MOST_EDGES, salt: str = "") -> DataFrame:
    """node, betweenness (directed, normalized), sources, error: from the shortest paths of some sources, with a bound for how far off any node is.

    Sources are the nodes whose hash, which salt varies, is under a threshold that lets through slightly more than sources_needed; error is the bound for as
    many as came through, which holds for all nodes together but for a chance of ``risk``. A graph with no more nodes than needed, or of which none came through, is
    walked from every node: error 0. Work grows with edges times sources instead of edges times nodes; nothing is gathered but graphs under ``most_edges``, and the values of up to
    MOST_NODES nodes for some sources at a time.
    """
    edges = staged(edges.select("src", "dst").distinct(), "edges")
    nodes = staged(nodes_of(edges), "nodes")
    n, m = nodes.count(), edges.count()
    need, chosen = sources_needed(n, error, risk), None
    if need < n:
        hashed = F.conv(F.substring(F.md5(F.concat(F.col("node").cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
        chosen = staged(nodes.filter(hashed < F.lit(math.floor((need + 3 * math.sqrt(need)) / n * 2**32))), "sources")
    k = chosen.count() if chosen is not None else n
    if k in (0, n):
        k, chosen = n, None
    if m <= most_edges and n <= MOST_NODES:
        total = _between_by_arrays(edges, nodes, n, m, chosen)
    elif most_edges >= 1 and n <= MOST_NODES and k * n <= FEW_WALKS * WALK_CELLS:
        total = _between_by_blocks(edges, nodes, n, m, chosen)  # so few sources that components need not be found first
    else:
        total = _between_by_components(edges, nodes, most_edges, chosen)
    bound = 0.0 if chosen is None else n / (n - 1) * math.sqrt(math.log(2 * n / risk) / (2 * k))
    value = F.coalesce("b", F.lit(0.0)) * (n / max(k, 1)) / max((n - 1) * (n - 2), 1)
    return nodes.join(total, "node", "left").select("node", value.alias("betweenness"), F.lit(k).cast("long").alias("sources"), F.lit(bound).alias("error"))


def _between_by_arrays(edges: DataFrame, nodes: DataFrame, n: int, m: int, sources: DataFrame | None = None) -> DataFrame:
    spark = edges.sparkSession
    numbers = _numbers(nodes)
    links = _by_number(edges, numbers, n)
    graph = spark.sparkContext.broadcast((_links(links, n, m, "s", "d"), _links(links, n, m, "d", "s")))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n)
        for rows in batches:
            total += _dependencies(n, *graph.value, rows["i"].to_numpy())
        some = np.flatnonzero(total)
        yield pd.DataFrame({"i": some, "b": total[some]})

    size = max(1, min(64, CELLS // max(m, 1)))
    tasks = max(1, min(-(-n // size), spark.sparkContext.defaultParallelism * 4))
    walked = numbers if sources is None else numbers.join(sources, "node", "left_semi")
    added = walked.select("i").repartition(tasks, "i").mapInPandas(sums, "i int, b double").groupBy("i").agg(F.sum("b").alias("b"))
    return added.join(numbers, "i").select("node", "b")


def _between_by_components(edges: DataFrame, nodes: DataFrame, most_edges: int, sources: DataFrame | None = None) -> DataFrame:
    if most_edges < 1:
        return _between_by_joins(edges, nodes, sources)
    kind = nodes.schema["node"].dataType.simpleString()
    groups, far, rest = _by_component(edges, (nodes if sources is None else sources).select("node"), min(most_edges, GROUP_EDGES))

    def sums(links: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if not len(links) or not len(starts):
            return pd.DataFrame({"node": starts["node"][:0], "b": np.zeros(0)})
        names, src, dst, at = _numbered(links, starts)
        n = len(names)
        begin = lambda ends: np.concatenate([[0], np.bincount(ends, minlength=n).cumsum()])
        total = _dependencies(n, (begin(src), dst[np.argsort(src, kind="stable")]), (begin(dst), src), at)
        some = np.flatnonzero(total)
        return pd.DataFrame({"node": names[some], "b": total[some]})

    found = groups.applyInPandas(sums, f"node {kind}, b double")
    if not rest.isEmpty():
        far, rest = staged(far, "far"), staged(rest, "rest")
        for lot, m in _lots(far, most_edges):
            part = staged(far.join(F.broadcast(lot), "component", "left_semi").select("src", "dst"), "lot")
            within, starts = staged(nodes_of(part), "nodes"), rest.join(F.broadcast(lot), "component", "left_semi").select("node")
            n = within.count()
            if n > MOST_NODES:
                found = found.unionByName(_between_by_joins(part, within, staged(starts, "starts")))
            else:
                found = found.unionByName((_between_by_arrays if m <= most_edges else _between_by_blocks)(part, within, n, m, starts))
    return found.groupBy("node").agg(F.sum("b").alias("b"))


def _lots(placed: DataFrame, most: int) -> Iterator[tuple[DataFrame, int]]:
    """components, edges: large components (src, dst, component), as many together as have at most ``most`` edges; one that has more is alone."""
    sizes = placed.groupBy("component").agg(F.count("*").alias("m")).orderBy("m").collect()  # few, as each has more than a group's edges
    lots = []
    for c, m in sizes:
        if not lots or lots[-1][1] + m > most:
            lots.append(([], 0))
        lots[-1] = ([*lots[-1][0], (c,)], lots[-1][1] + m)
    for some, m in lots:
        yield placed.sparkSession.createDataFrame(some, f"component {placed.schema['component'].dataType.simpleString()}"), m


def _between_by_blocks(edges: DataFrame, nodes: DataFrame, n: int, m: int, sources: DataFrame | None = None) -> DataFrame:
    """node, b. Edges stay where they are dealt, sorted, by either end. Values of as many sources as make WALK_CELLS with at most MOST_NODES nodes go to all of them and come back summed, once a level."""
    spark = edges.sparkSession
    numbers = _numbers(nodes)
    links = _by_number(edges, numbers, n)
    into, out = (staged(_ranged(links, m, by), "links") for by in ("d", "s"))
    starts = np.sort(np.array([r["i"] for r in (numbers if sources is None else numbers.join(sources, "node", "left_semi")).select("i").collect()], np.int64))

    def summed(kept: DataFrame, by: str, other: str, values: np.ndarray) -> np.ndarray:
        """For each number the sum of the values at the other ends of its links."""
        sent = spark.sparkContext.broadcast(values)
        width = values.shape[1]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = sent.value
            for b in batches:
                at, ends = b[by].to_numpy(), b[other].to_numpy()
                if len(at):
                    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    if len(at) > 16 * len(heads):
                        got = np.array([values[ends[lo:hi]].sum(axis=0) for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(at)])])
                    else:
                        got = np.add.reduceat(values[ends], heads, axis=0)
                    some = got.any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(at[heads[some]], pa.int32()), pa.array([x.tobytes() for x in got[some]], pa.binary())], ["i", "v"])

        found = kept.mapInArrow(sums, "i int, v binary").toArrow()
        total = np.zeros((n, width))
        for b in found.to_batches():
            # a number's links can lie in two batches
            np.add.at(total, b["i"].to_numpy(), np.frombuffer(b"".join(b["v"].to_pylist()), np.float64).reshape(-1, width))
        sent.destroy()
        return total

    total, size = np.zeros(n), max(1, WALK_CELLS // max(n, 1))
    for lo in range(0, len(starts), size):
        some = starts[lo : lo + size]
        cols = np.arange(len(some))
        paths, level = np.zeros((n, len(some))), np.full((n, len(some)), -1, np.int32)
        paths[some, cols], level[some, cols] = 1.0, 0
        depth = 0
        while (level < 0).any():
            got = summed(into, "d", "s", np.where(level == depth, paths, 0.0))
            new = (level < 0) & (got > 0)
            if not new.any():
                break
            depth += 1
            paths[new], level[new] = got[new], depth
        share = np.zeros_like(paths)
        for d in range(depth, 0, -1):
            share += np.where(level == d - 1, paths * summed(out, "s", "d", np.where(level == d, (1.0 + share) / np.maximum(paths, 1.0), 0.0)), 0.0)
        share[some, cols] = 0.0
        total += share.sum(1)
    found = spark.createDataFrame(pd.DataFrame({"i": np.arange(n, dtype=np.int32), "b": total}), "i int, b double")
    return numbers.join(found, "i").select("node", "b")


def _between_by_joins(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    starts = nodes if sources is None else sources
    seen = staged(starts.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("paths")), "seen")
    depth = 0
    while True:
        step = seen.filter(F.col("level") == depth).join(edges, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        new = staged(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(depth + 1).alias("level"), "paths"), "level")
        if new.isEmpty():
            break
        depth, seen = depth + 1, seen.unionByName(new)
    share = None
    for d in range(depth, 0, -1):
        at = seen.filter(F.col("level") == d)
        at = at.withColumn("share", F.lit(0.0)) if share is None else at.join(share.filter(F.col("level") == d).select("s", "v", "share"), ["s", "v"], "left").fillna(0.0, ["share"])
        before = seen.filter(F.col("level") == d - 1).select("s", F.col("v").alias("src"), F.col("paths").alias("p"))
        part = at.join(edges.withColumnRenamed("dst", "v"), "v").join(before, ["s", "src"]).groupBy("s", F.col("src").alias("v")).agg(F.sum(F.col("p") / F.col("paths") * (1 + F.col("share"))).alias("share"))
        part = staged(part.withColumn("level", F.lit(d - 1)), "share")
        share = part if share is None else share.unionByName(part)
    if share is None:
        return nodes.select("node", F.lit(0.0).alias("b"))
    return share.filter("s <> v").groupBy(F.col("v").alias("node")).agg(F.sum("share").alias("b"))


def bridges(metrics: DataFrame) -> DataFrame:
    """Nodes with betweenness over zero, one for each community and value, best first; none if there is one community only. metrics: node, community, betweenness."""
    many = metrics.agg((F.count_distinct("community") >= 2).alias("many"))
    kept = first_of(metrics.filter("betweenness > 0").withColumn("_b", F.round("betweenness", 6)), ["community", "_b"], F.col("node"))
    return kept.join(F.broadcast(many)).filter("many").select("node", "community", F.col("_b").alias("betweenness"))


def orphans(metrics: DataFrame) -> DataFrame:
    """node, score: influential outside, uncited inside: (rcr / max) (1 - in_corpus / max)."""
    most = metrics.agg(F.max("rcr").alias("mr"), F.max("in_corpus").alias("mc"))
    score = F.coalesce(F.col("rcr") / F.col("mr"), F.lit(0.0)) * (1 - F.coalesce(F.col("in_corpus") / F.col("mc"), F.lit(0.0)))
    return metrics.join(F.broadcast(most)).select("node", score.alias("score"))


def uncited_pairs(seeds: DataFrame | None, papers: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """seed, other, shared: papers of a seed's community that share ``least`` words with it and aren't beside it; without seeds
    all such pairs, each once with the lesser node first. papers: node, community, tokens."""
    # papers of a community with the same words are a class: classes are compared, and only the last step opens them up, without a shuffle of its pairs
    papers = papers.filter("node is not null and community is not null").select("node", "community", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    classes = staged(papers.groupBy("community", "tokens").agg(F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    # a class is opened by ranges of nodes, so that whole ranges come after a seed and few rows are compared with it
    ranges = max(1, -(-size["most"] // RANGE))
    tasks = max(ranges, papers.sparkSession.sparkContext.defaultParallelism)
    placed = papers.join(small(classes, size["k"], MOST_CLASSES), ["community", "tokens"]).select("node", "class", "community").repartitionByRange(tasks, "node")
    members = staged(placed.withColumn("range", F.floor(F.spark_partition_id() * ranges / tasks).cast("int")), "members")
    toks = classes.select("class", "community", F.explode("tokens").alias("t"))
    # of the words that two papers share the rarest stands behind ``least`` - 1 others in both papers' order, so each paper's commonest words make no candidates
    counted = toks.join(toks.groupBy("community", "t").agg(F.count("*").alias("df")), ["community", "t"])
    order = Window.partitionBy("class").orderBy(F.col("df").desc(), "t")
    rare = counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") >= least).select("class", "community", "t")
    met = rare.withColumnRenamed("class", "ca").join(rare.withColumnRenamed("class", "cb"), ["community", "t"]).select("ca", "cb").distinct()
    of = lambda c: classes.select(F.col("class").alias(f"c{c}"), F.col("tokens").alias(f"t{c}"))
    alike = met.join(of("a"), "ca").join(of("b"), "cb").select("ca", "cb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("shared")).filter(F.col("shared") >= least)
    alike = staged(alike, "alike")
    # edges between communities take no pair away, and go before they are turned round
    of = lambda end, c: small(members.select(F.col("node").alias(end), F.col("community").alias(c)), size["n"], MOST_NODES)
    inside = edges.select("src", "dst").join(of("src", "_ca"), "src").join(of("dst", "_cb"), "dst").filter("_ca = _cb").select("src", "dst")
    spot = F.xxhash64("class", "range")  # two spots of one hash cost a comparison, nothing else
    near = both_ways(inside).join(small(members.select(F.col("node").alias("b"), spot.alias("spot")), size["n"], MOST_NODES), "b")
    beside = near.groupBy(F.col("a").alias("seed")).agg(F.collect_set("b").alias("beside"), F.collect_set("spot").alias("spots"))
    own = members.select(F.col("node").alias("seed"), F.col("class").alias("ca"), F.col("range").alias("own"))
    own = own if seeds is None else own.join(seeds.select("seed").distinct(), "seed", "left_semi")
    pieces = staged(members.groupBy("class", "range").agg(F.collect_list("node").alias("all")).select(F.col("class").alias("cb"), "range", spot.alias("spot"), "all"), "pieces")
    # rows get many only when they are opened, so their number of partitions is kept, and what is opened comes to them
    parts = int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = own.join(beside, "seed", "left").repartition(parts, "seed")
    opened = asked.join(small(alike, alike.count(), MOST_NODES), "ca").join(small(pieces, size["n"], OPENED), "cb")
    left = F.when(F.array_contains("spots", F.col("spot")), F.array_except("all", "beside")).otherwise(F.col("all"))
    if seeds is not None:
        return opened.select("seed", F.explode(F.when(F.col("range") == F.col("own"), F.array_remove(left, F.col("seed"))).otherwise(left)).alias("other"), "shared")
    after = opened.filter("range > own").select("seed", F.explode(left).alias("other"), "shared")
    return after.unionByName(opened.filter("range = own").select("seed", F.explode(left).alias("other"), "shared").filter("other > seed"))
