"""The library from ingest to answers, SQL functions, sinks and the tree folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import sql
from corpusloom.operators import bibliography, converge, directions, graph, guard, topics, trees
from corpusloom.plans.library import Library, setting
from corpusloom.sources import sinks


def paper(n):
    body = f"Chondrocytes of kind{n} divide in the growth plate number{n}. " * 12
    return f"Title line\n# Abstract\n{body}\nRESULTS\n{body}It was {n}.\n# References\nSmith 2020"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("lib")))
    docs = spark.createDataFrame([(f"p{i}.md", paper(i)) for i in range(5)] + [("short.md", "x")], "source string, text string")
    assert lib.ingest(docs) == 5
    assert lib.ingest(docs) == 0
    return lib


def test_ingest_is_idempotent_and_upserts(spark, library):
    n = library.table("children").count()
    assert library.ingest(spark.createDataFrame([("p1.md", paper(1) + " ")], "source string, text string")) == 1
    assert library.table("children").count() == n and library.table("documents").count() == 5
    assert not library.table("parents").filter("content like '%Smith 2020%'").count()


def test_search(spark, library):
    q = spark.createDataFrame([(1, "growth plate kind3"), (2, "number4 divide")], "query_id long, query string")
    hits = library.search(q, 4).collect()
    best = {h.query_id: h.source for h in hits if h["rank"] == 1}
    assert best == {1: "p3.md", 2: "p4.md"}
    assert max(sum(h.source == s for h in hits if h.query_id == 1 and h["rank"] <= 4) for s in {h.source for h in hits}) <= 2
    library.write("edges", spark.createDataFrame([("p1.md", "p3.md"), ("p0.md", "p1.md")], "src string, dst string"))
    library.measure()
    assert library.search(q, 4).count() == 8


def test_answer_checks_sources(library):
    got = directions.answer(library, "growth plate kind3", lambda q, p: f"{p[0][:20]}\nSources:\n- p3.md\n- invented.md")
    assert got["sources"] == ["p3.md"] and got["dropped"] == ["invented.md"]


def test_remove_is_dry_by_default(library):
    assert library.remove(["P0"]) == 1 and library.table("documents").count() == 5
    assert library.remove(["P0"], dry_run=False) == 1 and library.table("children").filter("source = 'p0.md'").count() == 0


def test_store_reads(spark, library):
    assert {r.source for r in library.parents_by_source("p3.md").collect()} == {"p3.md"} and library.parents_by_source("gone").count() == 0
    assert library.stats().first().n_sources == library.sources().count() == library.table("documents").count()


def test_scaffold(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "new"))
    lib.scaffold()
    lib.scaffold()
    asked = spark.createDataFrame([(1, "growth plate")], "query_id long, query string")
    assert lib.search(asked).count() == 0 and lib.search_or_broaden(asked).count() == 0 and lib.table("parents").count() == 0
    assert lib.ingest(spark.createDataFrame([("a.md", paper(1))], "source string, text string")) == 1 and lib.search(asked).first().source == "a.md"


def test_filters_and_metadata_channel(spark, library):
    library.write("meta", spark.createDataFrame([(f"p{i}.md", f"Title {i}", f"Koolpe{i}, Ann", "J", "2002") for i in range(5)], "source string, title string, authors string, journal string, year string"))
    library.rebuild_index()
    asked = spark.createDataFrame([(1, "Koolpe2 2002")], "query_id long, query string")
    top = library.search(asked, 3).orderBy("rank").first()
    assert top.source == "p2.md" and "meta" in top.channels and top.text.startswith("Title 2")
    assert {r.source for r in library.search(asked, 3, filters={"source": {"$in": ["p1.md", "p3.md"]}}).collect()} <= {"p1.md", "p3.md"}


def test_settings(spark, monkeypatch):
    assert setting(spark, "root.dir", "a") == "a"
    spark.conf.set("corpusloom.root.dir", "b")
    assert setting(spark, "root.dir", "a") == "b"
    monkeypatch.setenv("CORPUSLOOM_ROOT_DIR", "c")
    assert setting(spark, "root.dir", "a") == "c"


def test_sql(spark, sf):
    sql.register(spark, sf)
    row = spark.sql("SELECT corpus_doi('https://doi.org/10.1000/ABCv2') d, corpus_words('A bé-2') w, corpus_jaccard(array('a'), array('a', 'b')) j, corpus_pmcid('PMC1234567') p, corpus_stem('a b.md') s").first()
    assert tuple(row) == ("10.1000/abcv2", ["a", "bé", "2"], 0.5, "PMC1234567", "a_b_md")
    assert spark.sql("SELECT count(*) n FROM documents, LATERAL corpus_chunks(text)").first().n > 200
    assert spark.sql("SELECT key, year FROM corpus_bib('@article{k, year = 2020}')").first().key == "k"


def test_bibliography(spark):
    rows = [(f"s{i}", ("On bones", "Smith, Ann; Lee, Bo", "2020", "J Bone" if i else "", "10.1/x")) for i in range(12)]
    df = spark.createDataFrame(rows, "source string, meta struct<title: string, authors: string, year: string, journal: string, doi: string>")
    got = {r.source: r for r in sinks.bibliography(df).collect()}
    assert got["s0"].key == "smith_2020_bonesa" and got["s0"].entry.startswith("@misc{smith_2020_bonesa,\n  title = {On bones},\n  author = {Smith, Ann and Lee, Bo}")
    assert len({r.key for r in got.values()}) == 12


def test_ledger_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "claim_id long, text string")
    for s in ("one", "two"):
        sinks.append_ledger(df, str(tmp_path / "ledger"), s)
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2


def test_betweenness(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    for most in (graph.MOST_EDGES, 2):  # as arrays, and by joins where the graph is too large for that
        got = {r.node: round(r.betweenness * 12) for r in graph.betweenness(path, most_edges=most).collect()}
        assert got == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}


@pytest.mark.parametrize("most", [graph.MOST_EDGES, 0])
def test_betweenness_equals_brute_force(spark, most):
    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 14, (40, 2)) if a != b})
    nodes = sorted({x for e in edges for x in e})
    out = {n: [b for a, b in edges if a == n] for n in nodes}

    def paths(s):  # all shortest paths from s
        found, front = {s: [[s]]}, [s]
        while front:
            new = {}
            for v in front:
                for w in out[v]:
                    if w not in found:
                        new.setdefault(w, []).extend(p + [w] for p in found[v])
            found |= new
            front = list(new)
        return found

    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t, ps in paths(s).items():
            for v in nodes:
                if s != v != t != s:
                    want[v] += sum(v in p for p in ps) / len(ps)
    n = len(nodes)
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "src long, dst long"), most).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v / ((n - 1) * (n - 2)), 9) for k, v in want.items()}


@pytest.mark.parametrize("most", [graph.MOST_EDGES, 0])
def test_sampled_betweenness_keeps_its_bound(spark, most):
    rng = np.random.default_rng(11)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 120, (260, 2)) if a != b} | {(i, 0) for i in range(1, 60)} | {(0, i) for i in range(60, 120)})
    df = spark.createDataFrame(edges, "src long, dst long").cache()
    exact = {r.node: r.betweenness for r in graph.betweenness(df).collect()}
    seen = set()
    for salt in ("", "a"):
        rows = graph.betweenness_sampled(df, error=0.3, most_edges=most, salt=salt).collect()
        assert {r.node for r in rows} == set(exact)
        assert all(graph.sources_needed(120, 0.3, 0.05) <= r.sources < 120 and 0 < r.error <= 0.3 for r in rows)
        assert max(abs(r.betweenness - exact[r.node]) for r in rows) <= rows[0].error
        seen.add(tuple(round(r.betweenness, 9) for r in sorted(rows)))
    assert len(seen) == 2 and max(exact.values()) > 0.2  # other sources give other estimates, and there is something to estimate


def test_sampled_betweenness_of_small_and_empty_graphs(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    got = graph.betweenness_sampled(path, error=0.01).collect()
    assert {r.node: round(r.betweenness * 12) for r in got} == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0} and {(r.sources, r.error) for r in got} == {(5, 0.0)}
    for most in (graph.MOST_EDGES, -1):
        assert graph.betweenness_sampled(path.limit(0), most_edges=most).count() == 0
    assert graph.sources_needed(10**9, 0.01, 0.05) < 130_000


def test_forward_by_author_and_year(spark):
    seeds = spark.createDataFrame([("a", "growth of bone plates", ["Lecuit", "Yap"], "2007"), ("b", "", ["Li"], None), ("c", "", [], "2007"), ("d", "", None, "2007")], "seed string, title string, surnames array<string>, year string")
    verified = spark.createDataFrame([("p1", "a"), ("a", "a")], "paper string, seed string")
    hints = spark.createDataFrame([("p2", "bone growth")], "paper string, hint string")
    mentions = spark.createDataFrame(
        [("p1", "Lecuit", "2007"), ("p2", "lecuit", "2007"), ("p3", "LECUYER", "2007"), ("p4", "Lecuit", "2008"), ("p5", "Yapp", "2007"), ("p6", "Linden", "1999"), ("p7", "L", "2007"), ("p8", "Linden", ""), ("p9", None, "2007"), ("b", "Li", "2001")],
        "paper string, author string, year string",
    )
    got = {(r.seed, r.paper): r.how for r in graph.forward(seeds, verified, hints, mentions, one_table=True).collect()}
    assert got == {("a", "p1"): "verified", ("a", "p2"): "hint", ("a", "p3"): "author_year", ("a", "p5"): "author_year", ("b", "p6"): "author_year"}


def test_coupling_keeps_kinds_of_keys_apart(spark):
    rows = [("x", "t", None, None, True), ("x", None, "Lee", "2000", False), ("y", None, "Lee", "2000", False), ("y", "u", None, None, True), ("z", None, "t", None, False), ("z", "t", "Lee", "2000", True), ("z", "t", "Lee", "2000", True)]
    keys = graph.cited_keys(spark.createDataFrame(rows, "`from` string, `to` string, to_author string, to_year string, resolved boolean"))
    got = {(r.seed, r.other): (r.shared, round(r.jaccard, 3)) for r in graph.coupling(keys, keys.select("src").distinct()).collect()}
    assert got == {("x", "y"): (1, 0.333), ("y", "x"): (1, 0.333), ("x", "z"): (1, 0.333), ("z", "x"): (1, 0.333)}


def test_louvain_finds_planted_communities(spark):
    rng = np.random.default_rng(8)
    edges = [(i, j) for i in range(60) for j in range(i) if rng.random() < (0.6 if i // 12 == j // 12 else 0.02)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: (r.community_id, r.community_size) for r in graph.louvain(df).collect()}
    assert len(got) == 60 and {len({got[i] for i in range(12 * c, 12 * c + 12)}) for c in range(5)} == {1} and len(set(got.values())) == 5
    parts = spark.createDataFrame([(n, c) for n, (c, _) in got.items()], "node long, community_id long")
    labels = graph.communities(df, 5)
    assert graph.modularity(df, parts).first()["modularity"] >= graph.modularity(df, labels).first()["modularity"] - 1e-9 > 0


def test_citations_in_text(spark):
    docs = spark.createDataFrame([("a", "Bone grows (Smith et al., 2020).\nReferences\n[1] Lee B. (2019) Growth of bone in mice")], "source string, text string")
    got = {(r.to_author, r.to_year, r.to_title_hint) for r in graph.cited(docs).collect()}
    assert ("Smith", "2020", "") in got and any(a == "Lee" and y == "2019" and "Growth of bone" in h for a, y, h in got)


def test_verification(spark):
    h = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    e = spark.createDataFrame([("a", 0.9, True), ("b", None, True), ("c", 0.1, True), ("d", 0.9, False), ("f", 0.6, True)], "id string, similarity double, valid boolean")
    v = spark.createDataFrame([("a", "supported"), ("b", "Contradicted"), ("c", "supported"), ("d", "supported"), ("f", "inconclusive")], "id string, verdict string")
    assert {r.id: r.status for r in directions.verification(h, e, v).collect()} == {"a": "verified", "b": "refuted", "c": "unsupported", "d": "unsupported", "e": "unsupported", "f": "speculative"}


def test_research_takes_an_id_once(spark):
    ideas = [[("a",), ("b",)], [("b",), ("c",), ("c",)], [("x",)]]
    got = directions.research(3, lambda i: spark.createDataFrame(ideas[i], "id string"), lambda new: new.withColumn("status", F.lit("open")), spark.createDataFrame([("x",)], "id string"))
    assert sorted((r.id, r["round"]) for r in got.collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_diverge_ranks_by_focus(spark):
    a = spark.createDataFrame([("bone growth", 1.0), ("skin", 3.0)], "text string, score double")
    b = spark.createDataFrame([("bone growth", 9.0), ("bone", 2.0)], "text string, score double")
    got = [(r.text, r.channel) for r in directions.diverge([("a", a), ("b", b)], "bone growth").orderBy("rank").collect()]
    assert got == [("bone growth", "a"), ("bone", "b"), ("skin", "a")]


def test_tree_folds(spark):
    lines = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([5, 5, 5, 20, 1])], "doc string, ord int, t string")
    assert [(r["first"], r["last"]) for r in trees.paginate(lines, "t", 10, overlap=0).orderBy("page").collect()] == [(0, 1), (2, 2), (3, 3), (4, 4)]
    assert [(r["first"], r["last"]) for r in trees.paginate(lines, "t", 18).orderBy("page").collect()] == [(0, 2), (2, 3), (3, 4)]
    assert [(r["first"], r["last"]) for r in trees.paginate(lines, "t", 36).collect()] == [(0, 4)]
    nodes = spark.createDataFrame([("d", 0, 1, 100), ("d", 1, 2, 5), ("d", 2, 3, 2), ("d", 3, 3, 70), ("d", 4, 2, 60)], "doc string, ord int, level int, words int")
    assert {r.ord: r.into for r in trees.thin(nodes, 50).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4}
    codes = spark.createDataFrame([("d", "1"), ("d", "1.2"), ("d", "3.1")], "doc string, code string")
    assert {r.code: r.parent_code for r in trees.from_codes(codes).collect()} == {"1": None, "1.2": "1", "3.1": None}
    spans = spark.createDataFrame([("d", 0, None, 2, 3, 1), ("d", 1, 0, 3, 4, 2), ("d", 2, 1, 4, 9, 3)], 'doc string, ord int, parent int, start int, end int, level int').withColumn("title", F.lit("t"))
    assert {r.ord: (r.start, r.end) for r in trees.covering_ranges(spans).collect()} == {0: (2, 9), 1: (3, 9), 2: (4, 9)}
    assert {r.ord: (r["first"], r["last"]) for r in trees.own_pages(spans).collect()} == {0: (2, 3), 1: (3, 4), 2: (4, 9)}
    pages = spark.createDataFrame([("d", i, f"<{i}>") for i in range(1, 10)], "doc string, page int, text string")
    assert {r.ord: r.text for r in trees.node_text(spans, pages).collect()} == {0: "<2><3>", 1: "<3><4>", 2: "<4><5><6><7><8><9>"}
    picks = spark.createDataFrame([(1, "d", 2, 0, "0001"), (1, "d", 1, 1, "0002"), (1, "d", 1, 3, "0001"), (1, "d", 3, 0, "0009")], "query_id int, doc string, part int, pos int, node_id string")
    hits = trees.retrieve_nodes(picks, spans.withColumn("node_id", F.lpad(F.col("ord").cast("string"), 4, "0")), pages, top=2).orderBy("rank").collect()
    assert [(h["rank"], h.ord, h.text) for h in hits] == [(1, 2, "<4><5><6><7><8><9>"), (2, 1, "<3><4>")]
    assert trees.with_preface(spans).filter("ord = -1").first()["end"] == 1
    assert [(r.ord, r.path) for r in trees.ancestors(spans).orderBy("ord").collect()][2] == (2, ["t", "t", "t"])


def test_diverge_ranks_by_anchors(spark):
    metrics = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 2), ("p4", 1), ("p5", 2), ("p6", 3), ("p7", None)], "node string, community_id int")
    seeds = spark.createDataFrame([("p1",), ("p2",), ("p2",), ("p3",), ("p7",), (None,)], "source string")
    a = spark.createDataFrame([("other", 5.0, ["p6"]), ("two", 1.0, ["p5", "p6"]), ("bone", 9.0, []), ("none", 1.0, None)], "text string, score double, anchors array<string>")
    b = spark.createDataFrame([("one", 1.0, ["p4"]), ("seed", 0.0, ["p6", "p7"])], "text string, score double, anchors array<string>")
    plain = spark.createDataFrame([("bones", 2.0)], "text string, score double")
    got = directions.diverge([("a", a), ("b", b), ("c", plain)], "bone", seeds=seeds, metrics=metrics).orderBy("rank").collect()
    assert [(r.text, round(r.anchor, 4)) for r in got] == [("seed", 1.0), ("one", 0.8333), ("two", 0.6667), ("bone", 0.0), ("other", 0.0), ("none", 0.0), ("bones", 0.0)]
    none = directions.diverge([("a", a)], "bone", seeds=seeds.limit(0), metrics=metrics).orderBy("rank").collect()
    assert none[0].text == "bone" and {r.anchor for r in none} == {0.0}


def test_offset_mode_breaks_full_ties(spark):
    rows = [(d, 1, 10, 10 + o) for d in range(40) for o in ((2, 0, 1) if d % 2 else (0, 2, 1))]
    got = trees.offset_mode(spark.createDataFrame(rows, "doc int, pos int, printed long, physical long").repartition(4))
    assert {r.doc: (r.offset, r.n) for r in got.collect()} == {d: (0, 1) for d in range(40)}


def test_offsets_by_titles(spark):
    contents = spark.createDataFrame([("d", 0, "Intro", 1), ("d", 1, "Methods", 5), ("d", 2, "Results", 9), ("d", 3, None, None), ("e", 0, "Intro", 1), ("f", 0, "Lost", 2)], "doc string, ord int, title string, page int")
    found = spark.createDataFrame([("d", 0, "Intro", 2), ("d", 1, "Methods", 17), ("d", 2, "Results", 21), ("d", 3, "methods", 5), ("d", 4, None, 9), ("e", 0, "Intro", None)], "doc string, ord int, title string, physical int")
    pairs = trees.title_pairs(contents, found, start=3)  # the first title was found ahead of the text
    assert sorted((r.doc, r.printed, r.physical) for r in pairs.collect()) == [("d", 5, 17), ("d", 9, 21)]
    got = {(r.doc, r.ord): r.physical for r in trees.shift_pages(contents, trees.offset_mode(pairs)).collect()}
    assert got == {("d", 0): 13, ("d", 1): 17, ("d", 2): 21, ("d", 3): None, ("e", 0): None, ("f", 0): None}


def test_slices_of_picked_nodes(spark):
    nodes = spark.createDataFrame([("d", "a", 0, "A", 2, 3, "s"), ("d", "b", 1, "B", 2, None, None), ("d", "c", 2, "C", None, 4, None), ("d", "e", 3, "E", 3, 2, None), ("d", "z", 4, "Z", 0, 1, None), ("w", "a", 0, "W", 1, 1, None)], "doc string, node_id string, ord int, title string, start int, end int, summary string")
    pages = spark.createDataFrame([("d", i, f"<{i}>") for i in range(1, 4)], "doc string, page int, text string")
    picks = spark.createDataFrame([(1, "d", 1, i, n) for i, n in enumerate("abcez")] + [(2, "w", 1, 0, "a")], "query_id int, doc string, part int, pos int, node_id string")
    whole = spark.createDataFrame([("w", "x" * 5000)], "doc string, text string")
    got = {(r.query_id, r.title): r.text for r in trees.retrieve_nodes(picks, nodes, pages, top=5, whole=whole, separator="\n\n", most=6).collect()}
    assert got == {(1, "A"): "<2>\n\n<", (1, "B"): "<2>", (1, "C"): "", (1, "E"): "", (1, "Z"): "<1>", (2, "W"): "x" * trees.WHOLE_CHARS}


def test_uncited_pairs_of_all_papers(spark):
    papers = [(i, i % 2, [w for w, d in (("a", 1), ("b", 2), ("c", 3), ("d", 5)) if i % d == 0]) for i in range(1, 25)]
    cites = {(1, 3), (6, 2), (12, 24), (5, 15)}
    got = graph.uncited_pairs(None, spark.createDataFrame(papers, "node long, community long, tokens array<string>"), spark.createDataFrame(sorted(cites), "src long, dst long"))
    shared = {(i, j): len(set(s) & set(t)) for i, c, s in papers for j, d, t in papers if i < j and c == d and (i, j) not in cites and (j, i) not in cites}
    assert sorted(map(tuple, got.collect())) == sorted((i, j, n) for (i, j), n in shared.items() if n >= 2)


def complete_link(pairs: list[tuple[int, int, float]], least: float) -> dict[int, int]:
    """item -> cluster (least member): pairs from the most similar on; two clusters merge only if all their cross pairs are similar enough."""
    sim = {(min(a, b), max(a, b)): s for a, b, s in pairs}
    of: dict[int, int] = {}
    members: dict[int, set[int]] = {}
    for (a, b), s in sorted(sim.items(), key=lambda x: (-x[1], x[0])):
        for x in (a, b):
            if x not in of:
                of[x], members[x] = x, {x}
        p, q = of[a], of[b]
        if p != q and all(sim.get((min(x, y), max(x, y)), -1.0) >= least for x in members[p] for y in members[q]):
            keep, drop = min(p, q), max(p, q)
            for x in members.pop(drop):
                of[x] = keep
                members[keep].add(x)
    return of


@pytest.mark.parametrize("block,part,ties,most", [(7, 2048, False, 0), (4096, 2048, True, 20), (16, 2, False, 0), (4096, 2048, True, 4096)])
def test_clusters_equal_complete_linkage_of_the_whole_table(spark, monkeypatch, block, part, ties, most):
    """In rounds, in rounds until few vectors are left, with clusters in parts, and link after link."""
    monkeypatch.setattr(topics, "CLUSTER_PART", part)
    monkeypatch.setattr(topics, "IN_ORDER", most)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 4))
    vs = [(centres[i % 12] + rng.normal(scale=0.4, size=4)).tolist() for i in range(90)]
    if ties:
        vs = np.round(vs).tolist()
    vs[70:80], vs[80:82] = [vs[0]] * 10, [[0.0] * 4] * 2
    m = np.array(vs)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(m @ m.T, 9)
    of = complete_link([(i, j, s[i, j]) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.9], 0.9)
    rows = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(vs)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.cluster for r in topics.clusters(rows, 0.9, block=block).collect()}
    assert got == {i: of.get(i, i) for i in range(90)} and len(set(got.values())) < (80 if ties else 60)
    assert topics.clusters(rows.filter("false"), 0.9, block=block).count() == 0


def test_metric_index_equals_all_pairs(spark, monkeypatch):
    from corpusloom.operators import metric
    from corpusloom.operators import retrieve as rt

    monkeypatch.setattr(metric, "BLOCK", 16)
    rng = np.random.default_rng(9)
    centres = rng.normal(scale=9, size=(8, 6))
    vs = [(centres[i % 8] + rng.normal(scale=0.5, size=6)).round(1).tolist() for i in range(400)]
    vs[100:180] = [vs[3]] * 80  # a third of a shell is one vector: ties by key
    rows = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>").repartition(3)
    asked = rows.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding").unionByName(spark.createDataFrame([(-1, [50.0] * 6), (-2, [0.0] * 6)], "query_id long, embedding array<double>"))
    index = metric.MetricIndex(rows)
    got = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "distance", "rank").collect()))
    for k in (1, 7, 500):
        assert got(index.search(asked, k)) == got(rt.knn_batch(rows, asked, k))
    index.search(asked, 7).count()
    assert index.skipped(asked.count()) > 0.6
    assert metric.MetricIndex(rows.filter("false")).search(asked, 3).count() == 0


def test_tree_costs_count_residual_pages(spark):
    """A leaf costs its pages, a parent one step and the worst of its children and of the pages none of them has."""
    rows = [("d", 0, None, 1, 20), ("d", 1, 0, 3, 6), ("d", 2, 0, 7, 9), ("e", 0, None, 1, 2), ("e", 1, 0, 1, 1), ("e", 2, 0, 2, 2)]
    got = {(r.doc, r.ord): (r.cost, r.kept) for r in trees.collapse_costs(spark.createDataFrame(rows, "doc string, ord int, parent int, start int, end int")).collect()}
    assert got == {("d", 0): (14.0, True), ("d", 1): (4.0, False), ("d", 2): (3.0, False), ("e", 0): (2.0, False), ("e", 1): (1.0, False), ("e", 2): (1.0, False)}


def test_deep_trees(spark):
    """A thousand levels in one pass, levels with gaps, ends that are given, and subtrees as ranges."""
    deep = [("d", i, i + 1, f"t{i}", i, 2000 - i) for i in range(1000)] + [("e", 0, 3, "a", 5, 5), ("e", 1, 9, "b", 1, 7), ("e", 2, 4, "c", 6, 6), ("e", 3, 1, "z", 8, 8)]
    nodes = spark.createDataFrame(deep, "doc string, ord int, level int, title string, start int, end int")
    got = {(r.doc, r.ord): r for r in trees.intervals(nodes).collect()}
    assert all((got["d", i].parent, got["d", i].depth, got["d", i].last, len(got["d", i].path)) == (i - 1 if i else None, i + 1, 999, i + 1) for i in range(1000))
    assert [(got["e", i].parent, got["e", i].last, got["e", i].low, got["e", i].high) for i in range(4)] == [(None, 2, 1, 7), (0, 1, 1, 7), (0, 2, 6, 6), (None, 3, 8, 8)]
    assert sorted((r.top, r.ord) for r in trees.subtree(nodes, spark.createDataFrame([("e", 0), ("d", 998)], "doc string, top int")).collect()) == [(0, 0), (0, 1), (0, 2), (998, 998), (998, 999)]
    some = spark.createDataFrame([("x", 0, 1, True, 7), ("x", 1, 4, True, None)], "doc string, ord int, start int, opens boolean, end int").withColumn("pages", F.lit(9))
    assert [r.end for r in trees.with_ends(some).orderBy("ord").collect()] == [7, 9] and [r.end for r in trees.with_ends(some.drop("end")).orderBy("ord").collect()] == [3, 9]


def test_page_thinning(spark):
    rows = [("d", 0, None, 1, 9), ("d", 1, 0, 1, 1), ("d", 2, 1, 1, 1), ("d", 3, 0, 2, 3), ("d", 4, 3, 3, 4)]
    df = spark.createDataFrame(rows, "doc string, ord int, parent int, start int, end int")
    # the last descendant ends on page 4, one page node loses its child, a short one only in a large tree
    assert {r.ord: r.end for r in trees.thin_pages(df).collect()} == {0: 9, 1: 1, 3: 3, 4: 4}
    assert {r.ord: r.end for r in trees.thin_pages(df, most_nodes=4, least_pages=4).collect()} == {0: 9, 1: 1, 3: 4}
    assert {r.ord: r.end for r in trees.thin_pages(df, most_nodes=4, least_pages=5).collect()} == {0: 4}


def test_generations(spark, tmp_path):
    from corpusloom.sources.generations import Generations

    table = Generations(spark, str(tmp_path / "t"))
    rows = lambda ids, v: spark.createDataFrame([(f"s{i}" if i is not None else None, v) for i in ids], "source string, v int")
    assert table.read() is None and not table.exists()
    table.append(rows([*range(20), None], 1))
    held = table.read()
    table.append(rows([3], 2).union(rows([3], 3)))
    assert table._read("rows", table.names()[1:]).count() == 2  # only its own rows were written
    assert sorted(r.v for r in table.read().collect()) == [1] * 20 + [2, 3]
    assert held.agg(F.sum("v")).first()[0] == 21  # a reader of the older generation isn't disturbed
    table.append(rows([5], 8), tag="once")
    table.append(rows([5], 9), tag="once")  # ran before
    assert [r.v for r in table.read().filter("source = 's5'").collect()] == [8]
    # two writers that saw the same table: both stay, and of a key that both wrote the later one's
    a, b = Generations(spark, str(tmp_path / "t")), Generations(spark, str(tmp_path / "t"))
    seen = table.names()
    a.names = b.names = lambda: seen
    a.append(rows([30, 31], 4))
    b.append(rows([31, 32], 5))
    assert [r.v for r in table.read().filter("source in ('s30', 's31', 's32')").orderBy("source").collect()] == [4, 5, 5]
    # one that broke off before its keys were committed is not seen
    table._fs().delete(table._at(f"keys/gen={table.names()[-1]}/_SUCCESS"), False)
    assert [r.v for r in table.read().filter("source in ('s30', 's31', 's32')").orderBy("source").collect()] == [4, 4]
    table.append(rows([None], 7))
    assert [r.v for r in table.read().filter("source is null").collect()] == [7]
    before = sorted(map(tuple, table.read().filter("source is not null").collect()))
    table.compact()
    assert len(table.names()) == 1 and sorted(map(tuple, table.read().filter("source is not null").collect())) == before
    table.delete(rows([*range(40), None], 0).select("source"))
    assert table.read().count() == 0 and table.read().columns == ["source", "v"]
    table.replace_all(rows([1], 4))
    assert [tuple(r) for r in table.read().collect()] == [("s1", 4)]


def test_stored_index_equals_scan(spark, sf, tmp_path, monkeypatch):
    from corpusloom.operators import phrases
    from corpusloom.operators import retrieve as rt
    from corpusloom.operators.index import StoredIndex
    from corpusloom.sources.tables import read

    docs = read(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    terms = rt.terms_of(items)
    asked = items.select("query_id", F.concat_ws(" ", F.array_join(F.slice(F.split("text", " "), 1, 3), "-"), F.split("text", " ")[4]).alias("query"))
    index = StoredIndex(spark, str(tmp_path / "i"))
    index.rebuild(docs.filter("source <> 'src2'").unionByName(docs.filter("source = 'src1'").withColumn("text", F.lit("old words"))))
    index.refresh(docs.filter("source in ('src1', 'src2')"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", F.round("score", 6), "rank").collect()))
    for every in (False, True):
        assert rows(index.search_words(terms, 5, every=every)) == rows(rt.bm25(docs, terms, 5, every=every))
    assert rows(index.search(asked, 5)) == rows(phrases.bm25_phrases(docs, asked, 5))
    monkeypatch.setattr(phrases, "MOST_LITERALS", 3)  # terms that are joined, not named
    assert rows(index.search(asked, 5)) == rows(phrases.bm25_phrases(docs, asked, 5))
    index.remove(docs.filter("source = 'src3'").select("source").distinct())
    index.compact()
    assert rows(index.search_words(terms, 5)) == rows(rt.bm25(docs.filter("source <> 'src3'"), terms, 5))


def brute_phrases(docs, queries, k):
    """BM25 of the same units, one document and one query at a time."""
    import math
    import re

    run = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+"
    grams = lambda r: [r[i : i + 2] for i in range(len(r) - 1)] or [r]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def streams(t):
        return [words(t), *map(grams, re.findall(run, t))]

    def count(unit, t):
        return sum(s[i : i + len(unit)] == unit for s in streams(t) for i in range(len(s)))

    dl = {d: sum(map(len, streams(t))) for d, t in docs}
    mean = sum(dl.values()) / len(dl)
    out = []
    for q, text in queries:
        latin = re.sub(run, " ", text)
        groups = [([u := words(x) for x in re.sub(r'["^{}()\[\]*:]', " ", latin).split() if words(x)],) * 2]
        groups += [([[g] for g in dict.fromkeys(grams(r))], [grams(r)]) for r in re.findall(run, text)]
        hits = []
        for scores, required in groups:
            scores = [list(u) for u in dict.fromkeys(map(tuple, scores))]
            found = {}
            for u in scores:
                tf = {d: n for d, t in docs if (n := count(u, t))}
                idf = max(math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
                for d, n in tf.items():
                    found[d] = found.get(d, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl[d] / mean))
            whole = {d for d, t in docs if d in found and all(count(u, t) for u in required)}
            best = sorted((-round(s, 9), d) for d, s in found.items() if d in whole or not whole)[:k]
            hits += [(d, -s) for s, d in best if d not in {h[0] for h in hits}]
        out += [(q, d, round(s, 6), n) for n, (d, s) in enumerate(hits, 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    from corpusloom.operators import phrases

    docs = [
        (1, "Ephrin-B1 guides axons"), (2, "ephrin guides B1 axons"), (3, "B1 ephrin b1, EPHRIN b1 again"), (4, "轴突导向因子 guides"), (5, "轴突 and 导向"), (6, "因子轴突导 向"),
        (7, ""), (8, "il 6 il-6 il 6"), (9, "骨"), (10, "a a a b a_a"), (11, "カタカナ 轴突导向"), (12, "guides guides axons IL"),
    ]
    queries = [(1, "ephrin-B1"), (2, "ephrin-B1 guides"), (3, "IL-6 axons"), (4, "轴突导向"), (5, "guides 轴突导向因子 骨"), (6, "导突向"), (7, "a-a-a"), (8, "a-a b"), (9, ""), (10, "カタ nothing-here"), (11, '"(axons)"'), (12, "向因"), (13, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = phrases.bm25_phrases(df, spark.createDataFrame(queries, "query_id long, query string"), 4)
    assert sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in got.collect()) == brute_phrases(docs, [q for q in queries if q[1]], 4)
    # words that stand apart are no hyphenated term
    assert {r.doc_id for r in got.filter("query_id = 1").collect()} == {1, 3} and {r.doc_id for r in got.filter("query_id = 4").collect()} == {4, 11}


def test_files(spark, tmp_path):
    """Markdown, JSON lines, parent files, CSV, missing files and the sinks that write reports and edges."""
    from corpusloom.sources import tables

    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("# A\ntext")
    (tmp_path / "md" / "b.txt").write_text("no")
    assert [tuple(r) for r in tables.markdown(spark, str(tmp_path / "md")).collect()] == [("a.md", "# A\ntext")]
    (tmp_path / "g.jsonl").write_text('{"q": "x", "gold": ["a"]}\nbroken\n')
    assert [(r.q, r.gold) for r in tables.json_lines(spark, str(tmp_path / "g.jsonl"), "q string, gold array<string>").collect()] == [("x", ["a"]), (None, None)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.json").write_text('[{"parent_id": "1", "content": "c"},\n {"parent_id": "2", "content": "d"}]')
    (tmp_path / "p" / "bad.json").write_text("[{")
    assert sorted(r.parent_id for r in tables.parent_store(spark, str(tmp_path / "p"), "parent_id string, content string").collect()) == ["1", "2"]
    for name, v in (("one", "old"), ("two", "new")):
        (tmp_path / f"{name}.csv").write_text(f'source,title\nk1,"{v}, quoted ""x"""\n' + ("k2,only\n" if name == "one" else ""))
    got = tables.csv_rows(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], "source", "source string, title string").collect()
    assert sorted(map(tuple, got)) == [("k1", 'new, quoted "x"'), ("k2", "only")]
    stems = lambda *x: spark.createDataFrame([(i,) for i in x], "stem string")
    assert [r.stem for r in tables.missing_files(stems("a", "b"), stems("b")).collect()] == ["a"]


def _matrix(edges):
    names = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b in set(edges):
        m[at[a], at[b]] = 1
    return names, m


def test_pagerank_to_convergence(spark):
    """Rings, a chain that ends nowhere, a hub and a repeated edge, against 500 rounds with a dense matrix."""
    edges = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [(f"c{i}", f"c{i + 1}") for i in range(6)] + [(f"x{i}", "hub") for i in range(20)] + [("hub", "r0"), ("hub", "r0"), ("r2", "c0")]
    names, m = _matrix(edges)
    out, n = m.sum(1), len(names)
    want = np.full(n, 1 / n)
    for _ in range(500):
        want = 0.15 / n + 0.85 * ((want / np.maximum(out, 1) * (out > 0)) @ m + want[out == 0].sum() / n)
    df = spark.createDataFrame(edges, "src string, dst string")
    rows = converge.pagerank_until(df, 1e-4).collect()
    assert sorted(r.node for r in rows) == names and abs(sum(r["rank"] for r in rows) - 1) < 1e-9
    assert rows[0].residual <= 1e-4 and 5 < rows[0].rounds < 80
    assert sum(abs(r["rank"] - want[names.index(r.node)]) for r in rows) < 2e-4
    # stopped early it says so
    few = converge.pagerank_until(df, 1e-9, most=3).first()
    assert few.rounds == 3 and few.residual > 1e-9
    assert converge.pagerank_until(df.limit(0)).count() == 0


def test_hits_to_convergence_or_degrees(spark):
    edges = [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("c", "y"), ("c", "z"), ("c", "z")]
    names, m = _matrix(edges)
    u, _, v = np.linalg.svd(m)
    hub, authority = abs(u[:, 0]) / abs(u[:, 0]).sum(), abs(v[0]) / abs(v[0]).sum()
    df = spark.createDataFrame(edges, "src string, dst string")
    for r in converge.hits_until(df, 1e-9).collect():
        i = names.index(r.node)
        assert (r.how, round(r.hub, 6), round(r.authority, 6)) == ("power", round(hub[i], 6), round(authority[i], 6))
    short = {r.node: r for r in converge.hits_until(df, 1e-12, most=2).collect()}
    assert short["x"].how == "degree" and short["x"].authority == 3 / 6 and short["c"].hub == 3 / 6 and short["c"].rounds == 2
    assert converge.hits_until(df.limit(0)).count() == 0


def test_answers_of_a_registry_resume(spark):
    papers = spark.createDataFrame([("a", "10.1000/A](https://doi.org/10.1000/a)"), ("b", "10.1000/b"), ("b2", "10.1000/b"), ("c", "10.1000/c"), ("d", None), ("e", "n/a")], "source string, doi string")
    none = spark.createDataFrame([], "doi string, refs array<string>")
    ask = lambda s: {(r.doi[-1], r.why) for r in bibliography.dois_to_ask(papers, s).collect()}
    answers = lambda *rows: spark.createDataFrame(rows, "doi string, status string, refs array<string>")
    assert ask(none) == {("a", "new"), ("b", "new"), ("c", "new")}
    first = bibliography.with_answers(none, answers(("10.1000/a", "ok", ["10.1000/B", "10.1000/a", "10.9/x", "", None]), ("10.1000/B", "timeout", None), ("10.1000/b", "timeout", None)))
    assert ask(first) == {("b", "again"), ("c", "new")}
    second = bibliography.with_answers(first, answers(("10.1000/b", "404", None), ("10.1000/c", "ok", ["10.1000/A"]), ("10.1000/a", "timeout", None)))
    assert ask(second) == set() and {r.doi[-1]: r.refs for r in second.collect()} == {"a": ["10.1000/a", "10.1000/b", "10.9/x"], "b": [], "c": ["10.1000/a"]}
    edges = bibliography.doi_edges(papers, second)
    assert {tuple(r) for r in edges.collect()} == {("a", "b2"), ("c", "a")}
    more = spark.createDataFrame([("a", "b2"), ("d", "a")], "src string, dst string")
    nodes, every = bibliography.citation_graph(papers.selectExpr("*", "repeat('t', 200) as title", "2001 as year", "cast(null as string) as journal"), edges, more)
    assert every.count() == 3
    assert {r.source: (r.in_corpus_cited_by, r.in_corpus_cites, r.doi[-1:], len(r.title), r.year, r.journal) for r in nodes.collect()} == {
        "a": (2, 1, "a", 90, "2001", ""), "b": (0, 0, "b", 90, "2001", ""), "b2": (1, 0, "b", 90, "2001", ""), "c": (0, 1, "c", 90, "2001", ""), "d": (0, 1, "", 90, "2001", ""), "e": (0, 0, "", 90, "2001", ""),
    }


def test_numbers_weaken_claims_and_are_surfaced(spark):
    """Every combination of numbers and evidence, against the column function that looks each number up in whole texts."""
    said = ["4", "5", "4.5", "grew 4.5-fold", "in 2001", "1,200 cells", "none", "5.6", "45", "4 or 99"]
    texts = ["it was 4.5.6", "4,5", ".5 and 4.", "12 or 1200", "", None, "x45 y", "1.200", "2001", "14.5", "4..5"]
    claims, evidence, parents = [], [], [(f"p{j}", t) for j, t in enumerate(texts)]
    for i, c in enumerate(said):
        for j, t in enumerate(texts):
            for k, (note, title) in enumerate([(None, None), ("see 5.6", "Of 1499 and 2001 and 45")]):
                claims.append((f"s{i}.{j}", k, c, "strong"))
                evidence.append((f"s{i}.{j}", k, 1, f"p{j}", note, title, True, "verified"))
    c = spark.createDataFrame(claims, "session string, pos int, text string, confidence string")
    e = spark.createDataFrame(evidence, "session string, pos int, n int, parent_id string, note string, title string, verified boolean, status string")
    p = spark.createDataFrame(parents, "parent_id string, content string")
    got, after = guard.recheck_numbers(c, e, p)
    got = {(r.session, r.pos): r for r in got.collect()}
    want = c.join(e.drop("n"), ["session", "pos"]).join(p, "parent_id").select("session", "pos", guard.numeric_mismatch(F.col("text"), F.array("content", "note"), F.when(F.col("title").isNotNull(), F.array(F.lit(2001)))).alias("m")).collect()
    assert len(got) == len(claims) == len(want) and {k: r.mismatch for k, r in got.items()} == {(r.session, r.pos): bool(r.m) for r in want}
    assert 40 < sum(r.mismatch for r in got.values()) < len(claims) - 40
    assert all((r.confidence, r.n_verified, r.n_unresolved) == (("weak", 0, 1) if r.mismatch else ("strong", 1, 0)) for r in got.values())
    assert all((r.status == "unresolved", r.verified, r.reason) == ((True, False, "numeric-mismatch") if got[r.session, r.pos].mismatch else (False, True, None)) for r in after.collect())
    # without evidence a number stands nowhere; without numbers nothing is wrong
    alone = spark.createDataFrame([("a", 1, "has 7", "strong"), ("a", 2, "has none", "strong")], c.schema)
    assert [(r.pos, r.mismatch, r.n_unresolved) for r in guard.recheck_numbers(alone, e, p)[0].orderBy("pos").collect()] == [(1, True, 0), (2, False, 0)]
    shown = spark.createDataFrame([("a", 2, "second " + "y" * 200, 0, 1), ("a", 1, "first", 0, 2), ("a", 3, "fine", 1, 1), ("b", 1, "outside", 0, 0), ("c", 1, "c", 0, 1)], "session string, pos int, text string, n_verified int, n_unresolved int")
    answers = spark.createDataFrame([("a", "Body\n**Sources:**\n- **Sources:**"), ("b", "B **Sources:**"), ("c", "no list"), ("d", None)], "session string, text string")
    assert {r.session: (r.text, r.n_unverified) for r in guard.surface_unverified(answers, shown).collect()} == {
        "a": ("Body\n\n\n⚠ Unverified claims (2):\n- first\n- second " + "y" * 113 + "\n\n**Sources:**\n- **Sources:**", 2), "b": ("B **Sources:**", 0), "c": ("no list", 1), "d": (None, 0),
    }


def test_citation_scores(spark):
    """The first supported sentence counts, else the best one; lost and empty parents have no score; an answer without a list has no rate."""
    first = "Osteoblasts mineralize trabecular scaffolds during prolonged mechanical loading experiments."
    second = "Osteoclasts resorb trabecular scaffolds during prolonged mechanical loading experiments."
    listed = "\n\n**Sources:**\n- Parent ID: a.md#s#1\n- b.md#s#2 and more\n- something invented\n- c.md#s#3\n- d.md#s#4"
    answers = spark.createDataFrame([("x", f"{second} Short one. {first}{listed}"), ("y", "No list here, only a sentence that is quite long."), ("z", None), ("w", f"Too short.{listed}")], "session string, text string")
    known = spark.createDataFrame([(s, f"{p}.md#s#{i}", None) for s in "xw" for i, p in enumerate("abcd", 1)], "session string, parent_id string, title string")
    parents = spark.createDataFrame([("a.md#s#1", first), ("b.md#s#2", "Quite another matter altogether, namely ships and harbours"), ("c.md#s#3", "")], "parent_id string, content string")
    got = {r.session: r for r in guard.citation_scores(answers, known, parents).collect()}
    tokens = lambda t: [w for w in t.lower().rstrip(".").split()]
    weigh = lambda ws: sum(3 if len(w) >= guard.RARE_LENGTH else 1 for w in ws)
    mine = [w for w in tokens(second) if w != "during"]
    x = got["x"]
    assert (x.n_source_lines, x.n_whitelisted, x.whitelist_rate, x.n_dropped, x.n_annotated) == (5, 4, 0.8, 1, 1)
    assert len(x.lexical_scores) == 2 and x.lexical_scores[1] == 0.0
    # the second sentence of the answer would score 1.0, but the first is supported already
    assert 0.5 < x.lexical_scores[0] < 1.0 and abs(x.lexical_scores[0] - weigh([w for w in mine if w in tokens(first)]) / weigh(mine)) < 0.06
    assert (got["w"].n_whitelisted, got["w"].n_annotated, got["w"].lexical_scores) == (4, 0, [])
    for s in "yz":
        assert (got[s].n_source_lines, got[s].whitelist_rate, got[s].lexical_scores) == (0, None, [])
