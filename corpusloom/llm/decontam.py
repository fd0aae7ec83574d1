"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact weighted-shingle similarity.

Each benchmark item of w words is compared with document windows of w words. Words are runs of letters and digits in lower
case; shingles are five words. A window can only be similar to an item if it shares a shingle with it, so windows are laid where a
shingle of some item occurs, in line with the place the shingle has in the item, and one and two words to either side, and where a run
of an item's shingles starts, which holds the best window (see places_of). Windows and items get a 64-bit SimHash of their shingles, each weighted by how often it occurs. Fingerprints are cut into BLOCKS blocks; every item is indexed under
all values within RADIUS // BLOCKS bits of each of its blocks, which by the pigeonhole principle finds every window of
its length within RADIUS bits. Candidates within the radius are verified by exact weighted Jaccard similarity.

A text with candidates is cut into segments of neighbouring shingles, and a window is a row of its own from there on, so that no row grows with a
repetitive text beyond the text itself.

Everything is built-in functions. Defined cases: null texts are empty; an item or a text of fewer than five words has no
shingle and matches nothing; a document shorter than an item is compared as one window; repeated item ids are each
compared; repeated documents are each reported; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, broadcast_if_small, scratch, staged, table, text_or_empty
from .sketches import bound

BLOCKS, BLOCK_BITS = 8, 8
RADIUS = 23  # at most 2 differing bits in some block
SLACK = (-2, -1, 0, 1, 2)  # words beside the aligned window
SEGMENT = 256  # window starts in a segment of a text, at least
LANES = 0x0000000100000001  # two 32-bit counters in a long


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of all five-word runs, in order; none for a shorter text."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    runs = lambda h: F.when(F.size(h) < SHINGLE_WORDS, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(h) - (SHINGLE_WORDS - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(SHINGLE_WORDS)]))
    )
    return bound(hashes, runs)


def with_simhash(rows: DataFrame, by: list[str], hashes: str = "sh") -> DataFrame:
    """by and fp, 64 bits: each is set if most of the row's hashes, repeats counted, have it.

    A long holds two counters of 32 bits, so 32 sums count all bits. Twice a count plus 2^30 - 1 - n reaches 2^30 just where the
    count is over n / 2, which sets bit 30 of its counter.
    """
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANES))).alias(f"s{j}") for j in range(32)]
    counted = rows.select(*by, F.explode(hashes).alias("h")).groupBy(*by).agg(F.count("*").alias("_n"), *sums)
    fp = F.lit(0).cast("long")
    for j in range(32):
        most = F.shiftrightunsigned(F.col(f"s{j}") * 2 + (F.lit((1 << 30) - 1) - F.col("_n")) * LANES, 30).bitwiseAND(F.lit(LANES))
        fp = fp.bitwiseOR(F.shiftleft(most, j))
    return counted.select(*by, fp.alias("fp"))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater weights, a shingle's weight being how often it occurs.

    Both sides are sorted together, and one pass adds up, for each shingle, the lesser number of its occurrences.
    """
    side = lambda xs, i: F.transform(xs, lambda x: F.struct(x.alias("v"), F.lit(i).alias("s")))
    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    # of a run of one value the first side comes first: its left is what the second side can still match
    zero = F.struct(F.lit(None).cast("bigint").alias("v"), F.lit(0).alias("left"), F.lit(0).alias("least"))

    def step(t: Column, x: Column) -> Column:
        same = F.coalesce(t["v"] == x["v"], F.lit(False))
        first, met = x["s"] == 0, same & (x["s"] == 1) & (t["left"] > 0)
        left = F.when(first, F.when(same, t["left"] + 1).otherwise(1)).when(met, t["left"] - 1).otherwise(F.when(same, t["left"]).otherwise(0))
        return F.struct(x["v"].alias("v"), left.alias("left"), (t["least"] + F.when(met, 1).otherwise(0)).alias("least"))

    least = F.aggregate(both, zero, step, lambda t: t["least"])
    return bound(least, lambda m: m / (F.size(a) + F.size(b) - m))


def block_values(fingerprint: Column) -> Column:
    """array<struct<block, value>> of the fingerprint's blocks."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for i in range(BLOCKS)])


def probes() -> list[int]:
    """Masks of all ways to change at most RADIUS // BLOCKS bits of a block."""
    return [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def places_of(hits: DataFrame) -> DataFrame:
    """_id, _tie, start, n: the windows to compare. hits: _id, _tie, m, n, item, pos, at, h, shingles of a text (m in all) that an item (n) has.

    Some best window starts with a shingle of the item, or ends with the text: moving it on past other shingles loses nothing. Moving it
    back by one shingle of the item gains one and loses at most one, unless that shingle comes again inside the window. So the starts
    of runs, and the places after a shingle that comes again within n, hold a best window.
    """
    at = ["_id", "_tie", "item"]
    each = hits.groupBy(*at, "m", "n", "pos", "h").agg(F.collect_set("at").alias("ats"))
    again = each.withColumn("again", F.lead("pos").over(Window.partitionBy(*at, "h").orderBy("pos")))
    before = Window.partitionBy(*at).orderBy("pos")
    runs = again.withColumn("_p", F.lag("pos").over(before)).withColumn("_again", F.lag("again").over(before))
    inside = F.coalesce((F.col("_p") == F.col("pos") - 1) & ~F.coalesce(F.col("_again") <= F.col("_p") + F.col("n"), F.lit(False)), F.lit(False))
    starts = F.flatten(F.transform("ats", lambda a: F.array(*[F.col("pos") - a + s for s in SLACK])))
    starts = F.concat(starts, F.when(inside & (F.col("pos") <= F.col("m") - F.col("n")), F.array().cast("array<int>")).otherwise(F.array("pos")))
    clamped = F.array_distinct(F.transform(starts, lambda s: F.greatest(F.lit(0), F.least(F.col("m") - F.col("n"), s))))
    return runs.select("_id", "_tie", F.explode(clamped).alias("start"), "n").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", least: float = NEAR) -> DataFrame:
    """See _leaks; the tables written on the way are deleted."""
    with scratch() as keep:
        return keep(staged(_leaks(docs, items, key, item, text, least), "leaks"))


def _leaks(docs: DataFrame, items: DataFrame, key: str, item: str, text: str, least: float) -> DataFrame:
    """One row for each document row and item that it holds: key, item, start (word of the best window, from 0), words,
    distance (of the fingerprints), similarity, n_windows (verified), and _row, which tells repeated document rows apart."""
    bench = staged(items.select(F.col(item).alias("item_id"), shingles(text_or_empty(text)).alias("sh")).filter(F.size("sh") > 0).withColumn("n", F.size("sh")), "bench")
    size = bench.agg(F.sum("n").alias("s"), F.count("*").alias("c"), F.max("n").alias("longest")).first()
    step, longest = max(SEGMENT, size["longest"] or 0), size["longest"] or 0
    places = bench.select(F.col("n"), F.xxhash64("sh").alias("item"), F.posexplode("sh").alias("at", "h")).distinct()
    places = broadcast_if_small(places, size["s"] or 0, 48)
    rows = docs.select(F.xxhash64(text_or_empty(text)).alias("_tie"), F.col(key).alias("_id"), text_or_empty(text).alias("_text"))
    each = rows.select("_id", "_tie", shingles(F.col("_text")).alias("sh")).filter(F.size("sh") > 0)
    hits = each.select("_id", "_tie", F.size("sh").alias("m"), F.posexplode("sh").alias("pos", "h")).join(places, "h")
    # the starts of a segment are at most step times the number of different item lengths
    in_segment = staged(places_of(hits).groupBy("_id", "_tie", F.floor(F.col("start") / step).cast("int").alias("seg")).agg(F.collect_set(F.struct("start", "n")).alias("at")), "places")
    wanted = in_segment.groupBy("_id", "_tie").agg(F.collect_list("seg").alias("segs")).toDF("_i", "_t", "segs")
    marked = rows.join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t")))
    # a segment takes its own shingles along and the longest item's beyond them, a window just its own
    part = lambda sh: lambda s: F.struct(s.alias("seg"), F.slice(sh, s * step + 1, F.lit(step + longest)).alias("sh"))
    parts = marked.select("_id", "_tie", F.explode(bound(shingles(F.col("_text")), lambda sh: F.transform("segs", part(sh)))).alias("p")).select("_id", "_tie", "p.seg", "p.sh")
    parts = parts.groupBy("_id", "_tie", "seg").agg(F.first("sh").alias("sh"))  # repeated documents have the same segments
    placed = in_segment.toDF("_i", "_t", "_s", "at")
    cut = parts.join(placed, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t")) & (F.col("seg") == F.col("_s"))).select("_id", "_tie", "seg", "sh", F.explode("at").alias("w"))
    cut = cut.select("_id", "_tie", "w.start", "w.n", F.slice("sh", F.col("w.start") - F.col("seg") * step + 1, F.col("w.n")).alias("sh"))
    at = ["_id", "_tie", "start", "n"]
    windows = staged(cut, "windows")
    prints = with_simhash(windows, at)
    known = staged(bench.withColumn("_k", F.monotonically_increasing_id()), "items")
    index = with_simhash(known, ["_k", "item_id", "n"]).select("_k", "item_id", "n", F.col("fp").alias("item_fp"), F.explode(block_values(F.col("fp"))).alias("b"))
    index = index.withColumn("mask", F.explode(F.array(*[F.lit(p).cast("long") for p in probes()])))
    index = index.select("_k", "item_id", "n", "item_fp", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("mask")).alias("value"))
    index = broadcast_if_small(index, (size["c"] or 0) * BLOCKS * len(probes()), 64)
    looked = prints.select(*at, "fp", F.explode(block_values(F.col("fp"))).alias("b")).select("*", F.col("b.block").alias("block"), F.col("b.value").alias("value")).drop("b")
    found = looked.join(index, ["n", "block", "value"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("distance") <= RADIUS)
    found = found.select(*at, "_k", "item_id", "distance").distinct()
    exact = found.join(windows.select(F.col("_id").alias("_i"), F.col("_tie").alias("_t"), F.col("start").alias("_s"), F.col("n").alias("_n"), "sh"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t")) & (F.col("start") == F.col("_s")) & (F.col("n") == F.col("_n")))
    exact = exact.join(broadcast_if_small(known.select("_k", F.col("sh").alias("item_sh")), size["s"] or 0, 16), "_k")
    exact = exact.withColumn("similarity", weighted_jaccard(F.col("item_sh"), F.col("sh"))).filter(F.col("similarity") >= least)
    best = exact.groupBy("_id", "_tie", "item_id").agg(F.count("*").alias("n_windows"), F.max(F.struct("similarity", -F.col("start"), "n", "distance")).alias("b"))
    return best.select(
        F.col("_id").alias(key), F.col("_tie").alias("_row"), F.col("item_id").alias(item), (-F.col("b.col2")).cast("long").alias("start"), (F.col("b.n") + SHINGLE_WORDS - 1).cast("long").alias("words"),
        F.col("b.distance").cast("long").alias("distance"), F.col("b.similarity").alias("similarity"), "n_windows",
    )


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item."""
    leaks = find_leaks(docs, items, key=key, text=text).select(F.col(key).alias("_k"), F.col("_row").alias("_r")).distinct()
    return docs.join(leaks, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text_or_empty(text)) == F.col("_r")), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")
