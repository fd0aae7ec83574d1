"""What goes through shuffles must not grow with pairs where many rows ask for the same."""

import time

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import bibliography, graph, topics, trees


def shuffled(spark, run):
    """Bytes that a run writes to shuffles, and its result."""
    seen = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, out = seen(), run()
    time.sleep(1)
    return seen() - before, out


def most_joined(spark):
    """Rows of the largest join of the last query."""
    time.sleep(1)
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes, rows = store.executionMetrics(last), store.planGraph(last).allNodes(), [0]
    for node in (nodes.apply(i) for i in range(nodes.size())):
        for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
            if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                rows.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(rows)


def test_forward_shuffles_classes_not_pairs(spark):
    n = 1500
    seeds = spark.range(n).selectExpr("id AS seed", "concat('red ', array('bolt', 'ring')[id % 2], ' part') AS title", "array('Smith', 'Jones') AS surnames", "if(id % 2 = 0, '1990', '') AS year")
    verified = spark.range(0, n, 7).selectExpr("id + 5000 AS paper", "id AS seed")
    hints = spark.range(n).crossJoin(spark.range(4).withColumnRenamed("id", "i")).selectExpr("id + 5000 AS paper", "concat('red ', array('bolt', 'ring', 'nut', 'part')[i]) AS hint")
    mentions = spark.range(n).selectExpr("id + 5000 AS paper", "'Smithers' AS author", "'1990' AS year")
    for more in (None, mentions):
        size, got = shuffled(spark, lambda: graph.forward(seeds, verified, hints, more).groupBy("how").count().collect())
        sure = -(-n // 7)
        assert {r["how"]: r["count"] for r in got} == {"verified": sure, "hint": n * n - sure}
        assert size < 2_000_000


def test_names_and_years_shuffle_classes_not_pairs(spark):
    n = 1500
    asked = spark.range(n).crossJoin(spark.range(4).withColumnRenamed("id", "i")).selectExpr("id + 5000 AS source", "array('Smith et al.', 'Smit & Wu', 'Smi, ', 'Nobody')[i] AS author", "'1990' AS year", "concat('line ', 4 - i) AS via")
    papers = spark.range(n).selectExpr("id AS paper", "'1990' AS year", "array('smithers', 'wu') AS surnames")
    size, got = shuffled(spark, lambda: bibliography.cited_by_name(asked, papers).groupBy("via").count().collect())
    assert {r["via"]: r["count"] for r in got} == {"line 2": n * n}
    assert size < 1_000_000


def generated_from(df):
    """Plans that open arrays or joins under them: what a row passes before it is opened, and what shuffles it after."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Generate explode", 1)


def test_names_and_years_are_opened_where_a_source_is(spark):
    """Classes and their papers go to the sources, nothing is filtered or sent after the opening, and no paper names itself."""
    n = 1200
    asked = spark.range(n).selectExpr("id AS source", "array('Smith et al.', 'Wu & Lee', 'Wuu')[id % 3] AS author", "'1990' AS year", "concat('line ', id % 2) AS via").union(spark.createDataFrame([(None, "Smith", "1990", "x")], "source long, author string, year string, via string"))
    papers = spark.range(n).selectExpr("id AS paper", "'1990' AS year", "array('smithers', 'wuu')  AS surnames")
    found = bibliography.cited_by_name(asked, papers)
    above, below = generated_from(found)
    assert "Filter" not in above and "Exchange" not in above and "Exchange hashpartitioning(paper" not in below and "SortMergeJoin" not in below
    got = found.collect()
    naming = [s for s in range(n) if s % 3 != 1]
    assert len(got) == len(naming) * (n - 1) and {(r["source"], r["paper"]) for r in got} == {(s, p) for s in naming for p in range(n) if p != s}
    assert all(r["via"] == f"line {r['source'] % 2}" for r in got)
    # keys of other types are compared too
    got = bibliography.cited_by_name(asked.withColumn("source", F.col("source").cast("string")), papers).collect()
    assert len(got) == len(naming) * (n - 1)


def test_uncited_pairs_shuffle_classes_not_pairs(spark):
    n = 1500
    papers = spark.range(n).selectExpr("id AS node", "1 AS community", "array('red', 'bolt', 'part') AS tokens")
    edges = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    size, got = shuffled(spark, lambda: graph.uncited_pairs(None, papers, edges).groupBy("shared").count().collect())
    assert {r["shared"]: r["count"] for r in got} == {3: n * (n - 1) // 2 - (n - 1)}
    assert size < 1_000_000


def test_uncited_pairs_drop_edges_between_communities_first(spark, monkeypatch):
    """Edges that take no pair away aren't shuffled; ranges of a class give each pair once, and seeds get all."""
    n = 300
    papers = spark.range(n).selectExpr("id AS node", "id % 2 AS community", "array('red', 'bolt', array('a', 'b', 'c')[id % 3]) AS tokens")
    many = spark.range(300_000).selectExpr("id % 150 * 2 AS src", "id * 2 + 1 AS dst").unionByName(spark.range(n - 2).selectExpr("id AS src", "id + 2 AS dst"))
    monkeypatch.setattr(graph, "RANGE", 4, raising=False)
    beside = {frozenset((i, i + 2)) for i in range(n - 2)}
    want = {(i, j, 3 if i % 3 == j % 3 else 2) for i in range(n) for j in range(n) if i != j and i % 2 == j % 2 and frozenset((i, j)) not in beside}
    size, got = shuffled(spark, lambda: graph.uncited_pairs(None, papers, many).collect())
    assert sorted(map(tuple, got)) == sorted(x for x in want if x[0] < x[1]) and size < 1_000_000
    seeds = spark.createDataFrame([(7,), (298,), (5000,)], "seed long")
    assert sorted(map(tuple, graph.uncited_pairs(seeds, papers, many).collect())) == sorted(x for x in want if x[0] in (7, 298))


def test_pieces_of_seeds_come_to_papers(spark):
    """Rows of paper and piece are neither joined by shuffle nor filtered after they are opened; verified pairs and a paper's own aren't found twice."""
    n = 1200
    seeds = spark.range(n).selectExpr("id AS seed", "'red bolt part' AS title", "array('Smith') AS surnames", "'1990' AS year")
    verified = spark.range(0, 40).selectExpr("id + 1000 AS paper", "id * 30 AS seed")
    hints = spark.range(n - 5, n + 5).selectExpr("id AS paper", "'red bolt' AS hint")
    mentions = spark.range(n - 10, n - 3).selectExpr("id AS paper", "'Smithers' AS author", "'1990' AS year")
    found = graph.forward(seeds, verified, hints, mentions, one_table=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join [" in x and "piece#" in x]
    sure = {(30 * i, 1000 + i): "verified" for i in range(40)}
    want = {(s, p): "author_year" for p in range(n - 10, n - 3) for s in range(n)} | {(s, p): "hint" for p in range(n - 5, n + 5) for s in range(n)} | sure
    got = [tuple(r) for r in found.select("seed", "paper", "how").collect()]
    assert sorted(got) == sorted((s, p, how) for (s, p), how in want.items() if s != p)


def test_coupling_sends_a_source_as_one_row(spark, monkeypatch):
    """What goes to several tasks is one row a source; the best are those of all pairs, also where many are nearly as good."""
    n, k = 1200, 3
    rng = np.random.default_rng(4)
    cites = {s: set(rng.integers(0, 60, rng.integers(1, 25)).tolist()) for s in range(n)}
    edges = spark.createDataFrame([(s, t) for s in cites for t in sorted(cites[s])], "src long, dst long").cache()
    edges.count()
    monkeypatch.setattr(graph, "BLOCK_EDGES", 1_500)
    monkeypatch.setattr(graph, "PART_EDGES", 1_500)
    seeds = edges.select("src").distinct().filter("src % 4 = 0")
    size, got = shuffled(spark, lambda: graph.coupling(edges, seeds, k).collect())
    found = {s: [(r["other"], r["shared"]) for r in sorted(got, key=lambda r: r["rank"]) if r["seed"] == s] for s in range(0, n, 40)}
    for s in found:
        all_ = sorted((-round(len(cites[s] & cites[o]) / len(cites[s] | cites[o]), 9), o, len(cites[s] & cites[o])) for o in cites if o != s and cites[s] & cites[o])
        assert found[s] == [(o, shared) for _, o, shared in all_[:k]]
    assert size < 550_000


def test_coupling_shuffles_the_best_not_pairs(spark, monkeypatch):
    n = 1500
    edges = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "dst")).selectExpr("concat('s', lpad(id, 4, '0')) AS src", "dst").filter("src <> 's0700' OR dst > 0")
    seeds = edges.select("src").distinct()
    for most in (2_000_000, 1_000):  # one block, then several
        monkeypatch.setattr(graph, "BLOCK_EDGES", most)
        monkeypatch.setattr(graph, "PART_EDGES", most)
        size, got = shuffled(spark, lambda: graph.coupling(edges, seeds, 2).collect())
        best = {s: [r["other"] for r in sorted(got, key=lambda r: r["rank"]) if r["seed"] == s] for s in ("s0000", "s0001", "s0700")}
        assert len(got) == 2 * n and best == {"s0000": ["s0001", "s0002"], "s0001": ["s0000", "s0002"], "s0700": ["s0000", "s0001"]}
        assert {(r["shared"], r["jaccard"]) for r in got if r["seed"] == "s0700"} == {(2, 0.666666667)}
        assert size < 2_000_000


def test_dense_sums_equal_those_of_lists():
    rng = np.random.default_rng(3)
    src, dst = np.nonzero((rng.random((40, 40)) < 0.2) & ~np.eye(40, dtype=bool))
    order = np.argsort(dst, kind="stable")
    src, dst = src[order].astype(np.int32), dst[order].astype(np.int32)
    assert np.allclose(graph._brandes_dense(40, src, dst, np.arange(30)), graph._brandes(40, src, dst, np.arange(30)))


def test_components_are_walked_in_tasks(spark, monkeypatch):
    """Two components that together have too many edges go to tasks, not to joins."""
    dense = [(f"a{i}", f"a{j}") for i in range(6) for j in range(6) if (i * j + i) % 3 and i != j]
    edges = spark.createDataFrame(dense + [("b1", "b2"), ("b2", "b3")], "src string, dst string").coalesce(1).cache()
    seeds = spark.createDataFrame([("b1",), ("z",)], "seed string").coalesce(1)
    value = lambda df: {r["node"]: round(r["betweenness"], 9) for r in df.collect()}
    want = value(graph.betweenness(edges))

    def no(*_):
        raise AssertionError("walked by joins")

    monkeypatch.setattr(graph, "_between_by_joins", no)
    monkeypatch.setattr(graph, "_reached_by_joins", no)
    assert value(graph.betweenness(edges, most_edges=len(dense))) == want and want["b2"] > 0
    assert sorted(map(tuple, graph.reachable(seeds, edges, 2).collect())) == [("b1", "b1", 0), ("b1", "b2", 1), ("b1", "b3", 2), ("z", "z", 0)]


def one_piece(spark, monkeypatch, n=60, m=240):
    """A connected graph with cycles, a tail, and a way in only; walks by joins are refused."""
    rng = np.random.default_rng(8)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b} | {(i, i + 1) for i in range(n, n + 4)} | {(3, n), (n + 9, 5)})

    def no(*_):
        raise AssertionError("walked by joins")

    monkeypatch.setattr(graph, "_between_by_joins", no)
    monkeypatch.setattr(graph, "_reached_by_joins", no)
    return edges, spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string").coalesce(1).cache()


def test_a_large_component_is_reached_in_tasks(spark, monkeypatch):
    edges, df = one_piece(spark, monkeypatch)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked, want = [0, 7, 63, 69, 1000], []
    for s in asked:
        seen, front = {s}, {s}
        want.append((f"n{s}", f"n{s}", 0))
        for h in (1, 2, 3):
            front = {w for v in front for w in near.get(v, ())} - seen
            seen |= front
            want += [(f"n{s}", f"n{v}", h) for v in front]
    seeds = spark.createDataFrame([(f"n{s}",) for s in asked], "seed string")
    for found in (graph.FOUND, 10):  # rows given back at once
        monkeypatch.setattr(graph, "FOUND", found, raising=False)
        assert sorted(map(tuple, graph.reachable(seeds, df, 3, most_edges=len(edges)).collect())) == sorted(want)


def test_a_large_component_is_walked_in_tasks(spark, monkeypatch):
    """More edges than a group has, or than go to the tasks at all, aren't walked by joins; sources walked one by one give what batches give."""
    edges, df = one_piece(spark, monkeypatch)
    value = lambda df: {r["node"]: round(r["betweenness"], 9) for r in df.collect()}
    want = value(graph.betweenness(df))
    monkeypatch.setattr(graph, "_dense", lambda n, m: False, raising=False)
    assert value(graph.betweenness(df)) == want and want["n60"] > 0
    monkeypatch.setattr(graph, "FEW_EDGES", 0, raising=False)
    assert value(graph.betweenness(df)) == want
    # two pieces with more edges together than may be sent at once, of which one or both are large; then blocks
    both = df.union(df.selectExpr("concat('x', src)", "concat('x', dst)")).cache()
    twice = value(graph.betweenness(both))
    monkeypatch.setattr(graph, "GROUP_EDGES", 5, raising=False)
    monkeypatch.setattr(graph, "WALK_CELLS", 1000, raising=False)
    for most in (len(edges), len(edges) - 1):
        assert value(graph.betweenness(both, most_edges=most)) == twice


def test_blocks_of_many_links(spark, monkeypatch):
    """Nodes with many links each, whose values are added up node by node."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in np.argwhere(rng.random((70, 70)) < 0.4) if a != b], "src long, dst long").cache()
    value = lambda df: {r["node"]: round(r["betweenness"], 9) for r in df.collect()}
    want = value(graph.betweenness(df))
    monkeypatch.setattr(graph, "GROUP_EDGES", 5, raising=False)
    assert value(graph.betweenness(df, most_edges=100)) == want


def test_bridges_of_a_large_component(spark, monkeypatch):
    """The exact betweenness that bridges needs, of a graph with more edges than a task gets."""
    edges, df = one_piece(spark, monkeypatch)
    of = lambda most: graph.bridges(graph.betweenness(df, most).withColumn("community", F.length("node")))
    rows = lambda df: sorted((r["node"], r["community"], round(r["betweenness"], 6)) for r in df.collect())
    assert rows(of(len(edges) - 1)) == rows(of(len(edges))) != []


def test_few_sources_need_no_components(spark, monkeypatch):
    """Some sources of a graph too large to be sent walk its blocks, and its components aren't looked for."""
    edges, df = one_piece(spark, monkeypatch, 150, 500)
    rows = lambda df: {(r["node"], round(r["betweenness"], 9), r["sources"], round(r["error"], 9)) for r in df.collect()}
    want = rows(graph.betweenness_sampled(df, error=0.3))

    def no(*_):
        raise AssertionError("components")

    monkeypatch.setattr(graph, "components", no)
    monkeypatch.setattr(graph, "WALK_CELLS", 2000, raising=False)
    got = rows(graph.betweenness_sampled(df, error=0.3, most_edges=len(edges) - 1))
    assert got == want and all(0 < s < 155 for _, _, s, _ in got)


def test_resolve_shuffles_classes_not_pairs(spark):
    """Many targets and records of one name and year; the gap is that to the second of the alike."""
    n = 1500
    targets = spark.range(n).selectExpr("'Smith' AS surname", "if(id % 2 = 0, 'Wu', '') AS secondary", "1990 AS year", "concat('red bolt ', id) AS hint")
    registry = spark.range(n).selectExpr("id AS key", "'Smith' AS surname", "array('Smith', if(id < 3, 'Wu', 'Lee')) AS surnames", "1990 AS year", "if(id = 7, 'red bolt', 'nut') AS title", "id % 5 AS citations", "0 AS in_corpus")
    size, got = shuffled(spark, lambda: graph.resolve(targets, registry).collect())
    # short numbers are no title words; to a Wu record 7 lacks the second name, and records 2, 1 and 0 the title
    plain = {(r["secondary"], r["key"], r["score"], r["gap"]) for r in got if len(r["hint"].split()[-1]) < 3}
    assert plain == {("Wu", 7, 0.86, 0.16), ("", 7, 0.93, 0.3)}
    assert len(got) == n and size < 2_000_000


def test_related_shuffles_the_best_not_pairs(spark, monkeypatch):
    """Topics and citations that all papers share, vectors that point away, and a pair that only a citation makes best."""
    n = 1500
    papers = spark.range(n).selectExpr("id AS node", "array('red', array('bolt', 'ring')[id % 2]) AS topics")
    edges = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "dst")).selectExpr("id AS src", "dst").unionByName(spark.createDataFrame([(7, 9), (1401, 9)], "src long, dst long"))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (2, [-1.0, 0.0]), (4, [0.0, 1.0]), (1498, [1.0, 1.0])], "node long, embedding array<float>")
    forward = spark.createDataFrame([(8, 1402)], "seed long, other long")
    for most in (2_000_000, 1_000):  # one block, then several
        for name in ("BLOCK", "PART", "PAIRS"):
            monkeypatch.setattr(topics, name, most)
        size, got = shuffled(spark, lambda: topics.related(papers.select(F.col("node").alias("seed")).filter("seed < 10"), papers, edges, 3, vectors, forward).collect())
        best = {s: [r["other"] for r in sorted(got, key=lambda r: r["rank"]) if r["seed"] == s] for s in range(10)}
        assert best == {0: [1498, 4, 6], 1: [3, 5, 9], 2: [4, 6, 8], 3: [1, 5, 9], 4: [1498, 0, 2], 5: [1, 3, 9], 6: [0, 2, 4], 7: [1401, 1, 3], 8: [1402, 0, 2], 9: [1, 3, 5]}
        assert size < 2_000_000


def test_title_prefixes_meet_by_classes(spark):
    """Many papers and entries of one name, year and title: all entries count, the least is named."""
    n = 1500
    papers = spark.range(n).selectExpr("id AS key", "'Smith' AS surname", "if(id = 3, '', '1990') AS year", "if(id = 5, 'nut', 'red bolt') AS title", "'of bolts' AS abstract")
    entries = spark.range(n).selectExpr("id AS entry", "'SMITH' AS surname", "'1990' AS year", "'red-bolt part' AS title", "if(id >= 7, 'of bolts', null) AS abstract", "'10.1/x' AS doi")
    out = bibliography.by_title_prefix(papers, entries)
    assert {tuple(r) for r in out.groupBy("entry", "status").count().collect()} == {(7, "multi_match", n - 2), (None, "no_year", 1), (None, "no_match", 1)}
    assert 0 < most_joined(spark) <= 2 * n


def test_pages_of_trees_never_become_rows(spark):
    """Two documents of a hundred thousand pages: children that overlap, reach out of their parent, run backwards or have no pages."""
    nodes = spark.createDataFrame(
        [(d, *r) for d in (1, 2) for r in [(0, None, 1, 100_000), (1, 0, 11, 50_000), (2, 0, 40_000, 60_000), (3, 0, 99_991, 200_000), (4, 3, None, 7), (5, 3, 99_999, 99_995)]], "doc long, ord int, parent int, start int, end int"
    )
    size, got = shuffled(spark, lambda: trees.residual_pages(nodes).collect())
    assert {(r["ord"], r["span"], r["residual"]) for r in got} == {(0, 100_000, 10 + 39_990), (1, 49_990, 49_990), (2, 20_001, 20_001), (3, 100_010, 100_005), (4, None, 0), (5, -3, 5)} and len(got) == 12
    assert size < 20_000
    kids = nodes.filter("parent is not null").selectExpr("doc", "parent AS ord", "start", "end")
    packed = nodes.join(kids.groupBy("doc", "ord").agg(F.collect_list(F.struct("start", "end")).alias("kids")), ["doc", "ord"], "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<struct<start:int,end:int>>")))
    for given in (kids, "kids"):
        size, got = shuffled(spark, lambda: trees.expand_cost(nodes if given is kids else packed, given).collect())
        assert {(r["ord"], r["cost"], r["residual"], r["expand"]) for r in got} == {(0, 100_011.0, 40_000, False), (3, 100_006.0, 100_005, True)} and len(got) == 4
        assert size < 20_000


def test_documents_are_folded_as_a_stream(spark):
    """Rows dealt by document are shuffled once, and documents of several batches are whole."""
    n = 25_000
    nodes = spark.range(2 * n).selectExpr("id % 2 AS doc", "cast(id div 2 as int) AS ord", "if(id < 2, 1, 2) AS level", "cast(id as int) AS start", "cast(id as int) AS end", "cast(30 as int) AS words", "cast(id as int) AS pages")
    dealt = nodes.repartition(3, "doc")
    runs = {"thin": lambda: trees.thin(dealt, 20), "covering": lambda: trees.covering_ranges(dealt), "intervals": lambda: trees.intervals(dealt)}
    found = {name: run() for name, run in runs.items()}
    for name, df in found.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, name
    assert found["thin"].filter("ord = into").count() == 2 * n
    assert {tuple(r) for r in found["covering"].filter("ord = 0").collect()} == {(0, 0, 0, 2 * n - 2), (1, 0, 1, 2 * n - 1)} and found["covering"].count() == 2 * n
    assert {(r["doc"], r["last"]) for r in found["intervals"].filter("parent is null").collect()} == {(0, n - 1), (1, n - 1)}


def test_prose_without_an_end_is_read_once(spark):
    from corpusloom.functions import metadata as md

    start = time.time()
    text = F.concat(F.repeat(F.lit("a "), 300_000), F.lit("\nA sentence of more than forty characters stands here. Short. Another one that is longer than forty characters too!"))
    row = spark.range(1).select(md.sentences_by(text, "prose").alias("prose"), md.clean_sentence(text).alias("first")).first()
    assert [len(s) for s in row["prose"]] == [53, 54] and row["first"].startswith("Another one")
    assert time.time() - start < 30


def test_texts_of_one_file_are_dealt_to_tasks(spark, sf):
    from corpusloom.plans import catalogue

    for name in ("sentence_facts", "normal_forms"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(doc_id" in plan, name


def test_frequent_words_meet_queries_where_their_documents_are(spark):
    from corpusloom.operators import retrieve as rt

    n = 2000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('red bolt ', if(id = 7, 'blue', 'part')) AS text").coalesce(1)
    asked = spark.range(100).selectExpr("id AS query_id", "explode(array('red', 'bolt', if(id = 3, 'blue', 'part'))) AS term")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        size, got = shuffled(spark, lambda: rt.bm25(docs, asked, 2).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(got) == 200 and {r["doc_id"] for r in got if r["query_id"] == 3} == {0, 7}
    assert size < 400_000


def test_rounds_over_edges_shuffle_nodes_not_edges(spark):
    """A dense graph: what ten more rounds shuffle is far less than its edges."""
    n = 400
    edges = spark.range(n).crossJoin(spark.range(n).withColumnRenamed("id", "dst")).selectExpr("id AS src", "dst").filter("src <> dst and (src * 7 + dst * 3) % 5 < 4").localCheckpoint()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for run in (lambda k: graph.hits(edges, k).count(), lambda k: graph.communities(edges, k).count()):
            few, many = (shuffled(spark, lambda k=k: run(k))[0] for k in (1, 5))
            assert many - few < 400_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_backward_meets_titles_by_classes(spark):
    n = 1500
    refs = spark.range(n).selectExpr("id AS paper", "concat(if(id % 2 = 0, 'red bolt ', 'Bolt red '), repeat('!', int(id))) AS hint", "if(id = 3, 9, cast(null as long)) AS verified")
    library = spark.range(n).selectExpr("id + 10 AS id", "array('nut', 'bolt, red', 'red')[id % 3] AS title")
    size, got = shuffled(spark, lambda: graph.backward(refs, library).groupBy("target", "how").count().collect())
    assert {tuple(r) for r in got} == {(9, "verified", 1), (11, "title", n - 1)} and most_joined(spark) <= 2 * n


def test_only_likely_links_are_measured(monkeypatch):
    """Vectors that are hardly alike: few pairs are measured, and the partners are those found one cluster after the other."""
    rng, n = np.random.default_rng(5), 1000
    v = rng.normal(size=(2 * n, 32))
    v[n : n + 300] = v[:300] + rng.normal(scale=0.3, size=(300, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, own = np.arange(2 * n), np.arange(2 * n) // 2 * 2
    whole, measured, plain = set(own[own % 3 > 0].tolist()), [], np.round
    monkeypatch.setattr(np, "round", lambda x, k: measured.append(np.size(x)) or plain(x, k))
    run = lambda: sorted(topics._best_partners(ids[:n], own[:n], v[:n], ids[n:], own[n:], v[n:], whole, 0.1))
    got = run()
    few = sum(measured)
    monkeypatch.setattr(topics, "DENSE", n * n)
    assert run() == got and len(got) > 100
    monkeypatch.undo()
    links = (plain(v[:n] @ v[n:].T, 9) >= 0.6).sum()
    measured.clear()
    monkeypatch.setattr(np, "round", lambda x, k: measured.append(np.size(x)) or plain(x, k))
    list(topics._best_partners(ids[:n], own[:n], v[:n], ids[n:], own[n:], v[n:], whole, 0.6))
    assert links <= sum(measured) <= links + 10 and few <= n * n


def test_metric_index_shuffles_queries_once_a_block(spark):
    """Vectors that are all much alike: queries want nearly all shells, but neither go to each of them nor take k rows from each."""
    from corpusloom.operators import metric
    from corpusloom.operators import retrieve as rt

    v = np.random.default_rng(4).normal(size=(2000, 32)).astype(np.float32)
    v[100] = v[0] + 1e-5  # as near as equal once rounded, and further by its id
    rows = spark.createDataFrame([(2000 - i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3).localCheckpoint()
    asked = rows.filter("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "embedding")
    index = metric.MetricIndex(rows)
    size, got = shuffled(spark, lambda: sorted(map(tuple, index.search(asked, 5).select("query_id", "vec_id", "distance", "rank").collect())))
    assert index.skipped(400) < 0.5
    assert got == sorted(map(tuple, rt.knn_batch(rows, asked, 5).select("query_id", "vec_id", "distance", "rank").collect()))
    assert size < 8_000_000


def test_folds_of_trees_take_few_steps_a_row(spark):
    """Steps of Python that a node costs, on trees with missing pages and a missing document, and what becomes of them."""
    import sys
    from types import SimpleNamespace as N

    import pandas as pd

    n = 2000
    part = pd.DataFrame({"doc": np.repeat(np.append(np.arange(n - 1), np.nan), 3), "ord": np.tile([0, 1, 2], n), "level": np.tile([1, 2, 3], n), "start": np.tile([5.0, np.nan, 2.0], n), "end": np.tile([6.0, 9.0, np.nan], n), "words": np.tile([9, 30, 1], n), "_at": np.tile([1, 2, 3], n)})
    folds, held = [], trees.by_document
    trees.by_document = lambda rows, fold, *_: folds.append(fold)
    try:
        rows = N(select=lambda *_: None, schema={"doc": N(dataType=N(simpleString=lambda: "long"))})
        trees.thin(rows, 20)
        trees.covering_ranges(rows)
    finally:
        trees.by_document = held
    calls = [0]
    out = []
    for fold in folds:
        sys.setprofile(lambda frame, event, _: calls.__setitem__(0, calls[0] + (event == "call")))
        try:
            out.append(fold(part.copy()))
        finally:
            sys.setprofile(None)
    assert calls[0] < 6 * n  # Python functions called, few for each document
    thin, covering = out
    assert thin["into"].tolist() == [0, 0, 0] * (n - 1) and covering["start"].tolist() == [2, 2, 2] * (n - 1)
    assert covering["end"].iloc[:2].tolist() == [9, 9] and covering["end"].iloc[2::3].isna().all()
