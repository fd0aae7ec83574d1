"""PageRank and HITS until they converge: residuals decide when to stop, and only nodes that still change send anything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import DAMPING, degree_hits, nodes_of
from corpusloom.sources.staging import staged

HELD = 20  # rounds whose changes are kept apart before they are added up in one table


def pagerank_until(edges: DataFrame, tolerance: float = 1e-6, most: int = 200) -> DataFrame:
    """node, rank, rounds, residual: PageRank with an error of at most ``tolerance`` in all, or what ``most`` rounds give.

    A node waits with what its rank has still to change by. In a round the nodes that wait with more than their share of the tolerance take it over and
    send it on, damped, along their edges; the others go on waiting, so that a round costs the edges of the active nodes. What waits in all, over
    1 - damping, bounds the error (residual). The mass of nodes without targets is left out and the ranks are scaled to a sum of 1 in the end, which is the same
    as dealing it out to all. No edges give no rows.
    """
    pairs = staged(edges.distinct(), "edges")
    out = pairs.groupBy("src").agg((1.0 / F.count("*")).alias("w"))
    links = staged(pairs.join(out, "src").select("src", "dst", "w"), "links")
    nodes = staged(nodes_of(pairs), "nodes")
    n = max(nodes.count(), 1)
    least = tolerance * (1 - DAMPING) / n
    got = links.groupBy(F.col("dst").alias("node")).agg((F.sum("w") / n).alias("got"))
    waiting = nodes.join(got, "node", "left").select("node", ((1 - DAMPING - 1.0) / n + DAMPING * F.coalesce("got", F.lit(0.0))).alias("delta"))
    taken = [nodes.select("node", F.lit(1.0 / n).alias("delta"))]
    add = lambda parts: reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("delta").alias("delta"))
    large = F.abs("delta") > least
    rounds = 0
    while True:
        waiting = staged(waiting, "waiting")
        left = waiting.agg(F.coalesce(F.sum(F.abs("delta")), F.lit(0.0)).alias("sum"), F.count_if(large).alias("active")).first()
        residual = left["sum"] / (1 - DAMPING)
        if residual <= tolerance or not left["active"] or rounds == most:
            break
        rounds += 1
        active = waiting.filter(large)
        taken.append(active)
        sent = active.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("delta") * F.col("w") * DAMPING).alias("delta"))
        waiting = add([waiting.filter(~large), sent])
        if len(taken) > HELD:
            taken = [staged(add(taken), "taken")]
    ranks = staged(add([*taken, waiting]), "ranks")
    total = ranks.agg(F.sum("delta").alias("total"))
    return ranks.join(F.broadcast(total)).select("node", (F.col("delta") / F.col("total")).alias("rank"), F.lit(rounds).alias("rounds"), F.lit(residual).alias("residual"))


def hits_until(edges: DataFrame, tolerance: float = 1e-8, most: int = 200) -> DataFrame:
    """node, authority, hub, how, rounds, residual: HITS, each side scaled to a sum of 1, until hubs change by at most ``tolerance`` in all in a round.

    Where ``most`` rounds don't get there how is degree instead of power, and authority and hub are the shares of edges (see degree_hits). No edges give no rows.
    """
    pairs = staged(edges.distinct(), "edges")
    nodes = staged(nodes_of(pairs), "nodes")
    state = nodes.select("node", F.lit(0.0).alias("authority"), F.lit(1.0 / max(nodes.count(), 1)).alias("hub"))
    residual, rounds = float("inf"), 0
    while rounds < most and residual > tolerance:
        rounds += 1
        a = pairs.join(state.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("a"))
        # only shares count, so one sum at the end of the round is enough for both sides
        h = pairs.join(a.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("a").alias("h"))
        raw = staged(state.select("node", F.col("hub").alias("before")).join(a, "node", "left").join(h, "node", "left"), "hits")
        sums = raw.agg(F.sum("a").alias("a"), F.sum("h").alias("h")).first()
        share = lambda c: F.coalesce(F.col(c) / F.lit(sums[c] or 1.0), F.lit(0.0))  # noqa: E731, B023
        both = raw.select("node", share("a").alias("authority"), share("h").alias("hub"), "before")
        residual = both.agg(F.coalesce(F.sum(F.abs(F.col("hub") - F.col("before"))), F.lit(0.0)).alias("r")).first()["r"]
        state = both.drop("before")
    how = "power" if residual <= tolerance else "degree"
    rows = state if how == "power" else degree_hits(pairs)
    return rows.select("node", "authority", "hub", F.lit(how).alias("how"), F.lit(rounds).alias("rounds"), F.lit(residual).alias("residual"))
