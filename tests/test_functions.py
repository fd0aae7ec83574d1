"""Functions on single values: the cases that the engine's behaviour is known by."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import identifiers as ids
from corpusloom.functions import models
from corpusloom.functions import text as tx
from corpusloom.functions import titles as tt
from corpusloom.operators import chunking, guard, topics, trees
from corpusloom.operators import retrieve as rt
from corpusloom.sources import bibtex


def one(spark, column, *values):
    row = spark.range(1).select(column(*[F.lit(v) for v in values]).alias("v")).first()
    return row["v"]


@pytest.mark.parametrize(
    "raw, doi",
    [
        ("https://doi.org/10.1016/J.YDBIO.2021.01.002", "10.1016/j.ydbio.2021.01.002"),
        ("doi: 10.1016/j.ydbio.2021.01.002v2", "10.1016/j.ydbio.2021.01.002"),
        ("10.1093/nar/gkv370", "10.1093/nar/gkv370"),
        ("（１０．２０１０３／ｊ．ｓｔｘｂ）", "10.20103/j.stxb"),
        ("no identifier", None),
        (None, None),
    ],
)
def test_normalize_doi(spark, raw, doi):
    assert one(spark, lambda c: ids.normalize_doi(c.cast("string")), raw) == doi


@pytest.mark.parametrize(
    "raw, doi",
    [
        ("10.1016/xabcd](https://doi.org/10.1016/xabcd)", "10.1016/xabcd"),
        ("10.1038/nature22041<br>Transmission", "10.1038/nature22041"),
        ("10.1242/jcs.111559/-/DC1", "10.1242/jcs.111559"),
        ("10.1016/s0306-4522(98)00526-0", "10.1016/s0306-4522(98)00526-0"),
        ("10.1371/journal.", None),
    ],
)
def test_extract_doi(spark, raw, doi):
    assert one(spark, ids.extract_doi, raw) == doi


def test_detect_identifier(spark):
    kinds = {"arXiv:2103.12345v2": ("arxiv", "2103.12345"), "PMCID: PMC3452677": ("pmcid", "PMC3452677"), "pmid: 123456": ("pmid", "123456"), "x": ("unknown", None)}
    for raw, want in kinds.items():
        assert tuple(one(spark, ids.detect_identifier, raw)) == want


def test_doi_agree_has_three_values(spark):
    assert one(spark, ids.doi_agree, "10.1016/j.x.2021.01", "10.1016/j.x.2021.01.002") is True
    assert one(spark, ids.doi_agree, "10.1016/j.x.1", "10.1016/j.x.2") is False
    assert one(spark, ids.doi_agree, "10.1016/j.x.1", "none") is None


def test_cjk_bigrams(spark):
    assert one(spark, tx.cjk_bigrams, "细胞 BMP4 骨 软骨发育") == ["细胞", "骨", "软骨", "骨发", "发育"]
    assert one(spark, tx.cjk_bigrams, "none") == []


def test_claim_tokens(spark):
    assert one(spark, tx.claim_tokens, "The growth-plate of BMP4 [12] (Smith et al., 2020) was 35") == ["growth-plate", "bmp4", "35"]


def test_references_are_cut(spark):
    text = "a\nACKNOWLEDGMENTS\nb\nc\nd\ne\nf\n**References**\nx"
    assert one(spark, tx.before_references, text) == "a\nACKNOWLEDGMENTS\nb\nc\nd\ne\nf"
    assert one(spark, tx.before_references, "a\nAppendix\nb\nc\nd\ne") == "a\nAppendix\nb\nc\nd\ne"
    assert one(spark, tx.before_references, "a\nb\nc\nd\nAppendix\ne") == "a\nb\nc\nd"


def test_trailing_references(spark):
    assert one(spark, tx.strip_trailing_references, "It grows (Fig. 2a) (see Table S3)") == "It grows"


def test_pages(spark):
    assert one(spark, tx.expand_pages, "1-3, 7") == [1, 2, 3, 7]
    assert one(spark, tx.expand_pages, "3-1") is None
    assert one(spark, tx.expand_pages, "a") is None
    assert one(spark, tx.expand_pages, "1-51") is None
    assert spark.range(1).select(tx.format_pages(F.array(*map(F.lit, [1, 2, 3, 7, 9, 10])))).first()[0] == "1-3,7,9-10"


def test_titles(spark):
    assert one(spark, tt.is_junk_title, "Case report") is True
    assert one(spark, tt.is_junk_title, "Bone growth in young mice") is False
    assert one(spark, lambda c: tt.is_junk_title(c, True), "BONE GROWTH IN YOUNG MICE") is True
    assert one(spark, tt.strip_author_year, "Smith et al. - 2020 - Bone growth") == "Bone growth"
    assert tuple(one(spark, tt.filename_key, "Smith_et_al__-_2019_On bone")) == ("smith", "2019", "onbone")
    assert one(spark, tt.citation_string, "Smith, Ann; Lee, Bo; Wu, C", "2020") == "(Smith et al., 2020)"
    assert one(spark, tt.authors_quality, "Smith, A; Lee, B") == "initials_only"
    assert one(spark, tt.bibtex_key, "Smith, Ann", "2020", "The Bone") == "smith_2020_bone"


def test_empty_title_sets_are_equal(spark):
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(tt.jaccard(empty, empty)).first()[0] == 1.0


def test_sections_and_captions(spark):
    docs = spark.createDataFrame([("a", "lost\n# Abstract\nfirst\nRESULTS\nold\nDiscussion\nRESULTS\nnew\n\nFigure 3: x\n\nAs Figure 3 shows")], "source string, text string")
    got = {r.section: r.content for r in chunking.sections(docs).collect()}
    assert got == {"abstract": "first", "results": "new\n\nFigure 3: x\n\nAs Figure 3 shows"}
    assert [(r.label, r.content) for r in chunking.captions(docs).collect()] == [("3", "Figure 3: x")]


def test_children_overlap():
    words = [f"w{i}" for i in range(400)]
    kids = chunking.pack(" ".join(words[:60]) + "\n\n" + " ".join(words[60:160]) + "\n\n" + " ".join(words[160:220]))
    assert kids[1].startswith(" ".join(words[40:60]) + "\n\n")
    assert set(" ".join(kids).split()) == set(words[:220])
    assert chunking.pack("") == []


def test_bibtex_braces():
    e = bibtex.entries("@article{k1,\n\ttitle = {On {DNA} {and} bone},\n\tyear={2020},\n\tauthor = \"A B\"}\n@misc{k2, date = {2019-05}}")
    assert (e[0]["title"], e[0]["year"], e[0]["author"], e[1]["year"]) == ("On DNA and bone", "2020", "A B", "2019")


def test_rrf_counts_repeats(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 20, 3)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 20, 1)], "query_id long, doc_id long, rank int")
    got = [(r.doc_id, r.rrf, r.channels) for r in rt.rrf([("vec", a), ("bm25", b)]).orderBy("rank").collect()]
    assert got == [(10, round(1 / 61 + 1 / 62, 5), "vec"), (20, round(1 / 63 + 1 / 61, 5), "bm25,vec")]


def test_source_cap_backfills(spark):
    rows = [(1, s, i) for i, s in enumerate("XXXYZXW", 1)]
    got = rt.cap_sources(spark.createDataFrame(rows, "query_id long, source string, rank int"), k=6).orderBy("rank").collect()
    assert [r.source for r in got] == ["X", "X", "Y", "Z", "W", "X"]


def test_knn_batch_equals_knn(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id in (3, 8)").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in rt.knn_batch(v, q, 4, block=16).collect()}
    for n, x in ((3, [3.0, 3.0]), (8, [1.0, 3.0])):
        assert [got[n, i] for i in range(1, 5)] == [r.vec_id for r in rt.knn(v, x, 4).collect()]


def test_models_are_optional(spark):
    broken = models.endpoint(lambda texts: 1 / 0, "double")
    assert spark.createDataFrame([("a",)], "t string").select(broken(F.col("t"))).first()[0] is None
    assert one(spark, models.best_sentence, "bone growth", "Nothing. Bone growth is slow. Bone.") == "Bone growth is slow."


def test_weak_claims_pass(spark):
    claims = spark.createDataFrame([(1, ["a1"] * 3), (2, ["chondrocyte", "differentiation", "hypertrophy", "x1", "x2", "x3"])], "claim_id long, tokens array<string>")
    chunks = spark.createDataFrame([(7, ["chondrocyte", "differentiation", "hypertrophy"]), (8, ["other"])], "chunk_id long, tokens array<string>")
    got = {(r.claim_id, r.chunk_id): (r.score, r.supported) for r in guard.lexical_support(claims.select("claim_id").crossJoin(chunks.select("chunk_id")), claims, chunks).collect()}
    assert got[1, 8] == (1.0, True) and got[2, 7] == (0.75, True) and got[2, 8] == (0.0, False)


def test_tree_parents(spark):
    docs = spark.createDataFrame([("d", "# A\n## B\n```\n# no\n```\n### C\n## D\n**E**")], "doc string, text string")
    got = [(r.title, r.parent, r.is_leaf) for r in trees.with_parents(trees.headings(docs)).orderBy("ord").collect()]
    assert got == [("A", None, False), ("B", 0, False), ("C", 1, True), ("D", 0, True), ("E", None, True)]


def test_stream_ingest(spark, tmp_path):
    from corpusloom.streaming import events
    from corpusloom.sources.generations import Generations

    schema, target = "source string, text string", str(tmp_path / "out")
    docs = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1)
    ingest = lambda checkpoint, **more: events.ingest(spark, str(tmp_path / "in"), docs(("a", "")).schema, target, str(tmp_path / checkpoint), **more).awaitTermination()
    texts = lambda: {(r.source, r.text) for r in events.latest(spark, target).collect()}
    Generations(spark, target).replace_all(docs(("a", "zero"), ("old", "kept")).withColumn("hash", F.md5("text")))
    for n, rows in enumerate(([("a", "one"), ("b", "two")], [("a", "three")])):
        docs(*rows).write.mode("append").parquet(str(tmp_path / "in"))
        ingest("cp")
    assert texts() == {("a", "three"), ("b", "two"), ("old", "kept")}  # a table that was there loses nothing but what the stream replaces
    before = len(Generations(spark, target).names())
    ingest("cp")
    assert texts() == {("a", "three"), ("b", "two"), ("old", "kept")} and len(Generations(spark, target).names()) == before
    Generations(spark, target).append(docs(("a", "by hand"), ("c", "more")).withColumn("hash", F.md5("text")))
    ingest("cp2")  # a new stream into the same table reads everything again
    assert texts() == {("a", "three"), ("b", "two"), ("old", "kept"), ("c", "more")}


def test_stream_replays_a_batch_once(spark, tmp_path):
    """A batch whose rows were written, but which the stream didn't note as done, is left alone when it runs again."""
    import shutil

    from corpusloom.sources.generations import Generations
    from corpusloom.streaming import events

    docs = spark.createDataFrame([("a", "one")], "source string, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "in"))
    run = lambda: events.ingest(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    shutil.rmtree(tmp_path / "cp" / "commits")
    table = Generations(spark, str(tmp_path / "out"))
    n = len(table.names())
    run()
    assert len(table.names()) == n and [tuple(r)[:2] for r in table.read().collect()] == [("a", "one")]


def test_stream_drops_texts_it_has_seen(spark, tmp_path):
    """Equal texts under other keys, in one batch, a later one and after a restart, are written once; a file that is late, but within the time, still counts."""
    import os
    import time

    from corpusloom.streaming import events

    schema, at = "source string, text string", str(tmp_path / "in")
    run = lambda: events.ingest(spark, at, spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour").awaitTermination()
    for age, rows in ((0, [("a", "one"), ("b", "one"), ("c", "two")]), (0, [("d", "two"), ("e", "three")]), (1800, [("f", "three"), ("g", "four")])):
        before = set(os.listdir(at)) if os.path.isdir(at) else set()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        for name in set(os.listdir(at)) - before:
            if name.endswith(".parquet"):
                os.utime(f"{at}/{name}", (time.time() - age,) * 2)
        run()
    got = events.latest(spark, str(tmp_path / "out"))
    assert sorted(r.text for r in got.collect()) == ["four", "one", "three", "two"] and {r.source for r in got.collect()} >= {"c", "e", "g"}


def brute_children(text, paragraph="\n\n", size=500):
    """The packing as a list of steps: each piece either joins what is held or closes it and opens with its tail."""
    import re

    steps = []
    for p in [p.strip() for p in text.split(paragraph) if p.strip()]:
        cut = len(p) > 1.5 * size
        steps += [(s, cut) for s in (re.split(r"(?<=[.!?])\s+", p) if cut else [p])]
    out, held = [], ""
    for piece, sentence in steps:
        if len(held) + len(piece) > size and held:
            out.append(held.strip())
            w = held.split()
            tail = " ".join(w[-20:]) if len(w) > 20 else held[-100:] if sentence else ""
            held = tail + " " + piece if sentence else tail + (paragraph if tail else "") + piece
        elif sentence:
            held += " " + piece if held else piece
        else:
            held += (paragraph if held else "") + piece
    return out + ([held.strip()] if held.strip() else [])


def test_children_equal_brute_force(spark, sf):
    import random

    from corpusloom.operators import chunking
    from corpusloom.sources.tables import read

    rng = random.Random(3)
    word = lambda: rng.choice(["a", "of", "bones", "growth", "plates.", "why?", "x" * 40, "x" * 700])
    texts = ["", "\n\n", "one", "x" * 2000] + ["\n\n".join(" ".join(word() for _ in range(rng.randrange(0, 160))) for _ in range(rng.randrange(0, 6))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunking.children(df, "id", "text").orderBy("id", "idx").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {i: c for i, t in enumerate(texts) if (c := brute_children(t))}
    docs = read(spark, sf, "documents").select("doc_id", "text")
    lines = {}
    for r in chunking.children(docs, "doc_id", "text", "\n").orderBy("doc_id", "idx").collect():
        lines.setdefault(r.doc_id, []).append(r.text)
    assert lines == {r.doc_id: c for r in docs.collect() if (c := brute_children(r.text or "", "\n"))}


def test_outline_parts_equal_brute_force(spark, sf):
    """The folds over documents without SQL: parts of an even size, thinned nodes."""
    import math

    from corpusloom.plans import catalogue
    from corpusloom.sources.tables import read

    want = {}
    for r in read(spark, sf, "documents").select("doc_id", "text").collect():
        n = [len(x) for x in (r.text or "").split("\n")]
        total, parts, at, held = sum(n), [], 0, 0
        budget = math.inf if total <= 4000 else math.ceil((total / math.ceil(total / 4000) + 4000) / 2)
        for i, x in enumerate(n):
            if held + x > budget:
                parts.append((at, i - 1) if i > at else (None, None))
                at = max(i - 1, 0)
                held = sum(n[at:i])
            held += x
        want[r.doc_id] = [*parts, (at, len(n) - 1)]
    got = {}
    for r in catalogue.QUERIES["outline_parts"](spark, sf).orderBy("doc", "page").collect():
        got.setdefault(r.doc, []).append((r["first"], r["last"]))
    assert got == want


def test_metadata_functions(spark):
    from corpusloom.functions import metadata as md

    col = F.lit
    row = spark.range(1).select(
        md.extract_meta(col("A study of the growth plate in mice\nNature Medicine 2019\ndoi:10.1/x PMID: 123 PMCID: PMC99"), col("f.pdf")).alias("a"),
        md.extract_meta(col("Title: x"), col("+ Lee_2020_Growth.md")).alias("b"),
        md.upsert_front_matter(col("\nTitle: old\nYear: 1999\n\n\nBody\nYear: 5"), {"Title": col("new"), "doi": col("10.1/y")}).alias("c"),
        md.upsert_front_matter(col("Body"), {"Title": col(" ")}).alias("d"),
        md.is_fake_doi(col("10.1002/(SICI)1")).alias("e"), md.is_fake_doi(col("10.1/x")).alias("f"),
        md.queries_of(col("[1, \"a\"]")).alias("g"), md.classes_of(col('{"0": "review: a", "0": "methods: b", "1": {')).alias("h"),
        md.class_entry(col("Essay: a")).alias("i"), md.sentences_by(col("One. two! Three"), "starts").alias("j"),
    ).first()
    assert tuple(row.a) == ("A study of the growth plate in mice", "2019", "A study of the growth plate in mice\nNature Medicine", "10.1/x", "123", "PMC99")  # a journal may run over lines
    assert row.b.title == "Lee_2020_Growth" and row.b.year == ""
    assert row.c == "Title: new\ndoi:10.1/y\n\nBody\nYear: 5" and row.d == "Body" and row.e and not row.f
    assert row.g == ["1", "a"] and row.h == {0: "methods: b"} and row.i is None and row.j == ["One. two!", "Three"]


def brute_surnames(text):
    """Registry authors, one name at a time."""
    import re
    import unicodedata

    from corpusloom.functions.authors import PARTICLES

    fold = lambda t: re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())
    a = " ".join((text or "").split())
    segs = [s.strip() for s in a.split(";")] if ";" in a else [p.strip() for p in a.split(",") if p.strip()][0::2] if "," in a else [a]
    found = []
    for seg in segs:
        toks = seg.split(",")[0].split()
        lead = []
        while toks and toks[0].lower().strip(".") in PARTICLES:
            lead.append(toks.pop(0))
        if toks:
            full = fold("".join(lead) + toks[0])
            found += [full] if not lead or re.fullmatch(r"[A-Z]{1,3}[.]?", toks[0]) else [full, fold(toks[0])]
        elif lead:
            found.append(fold(lead[0]))
    found = [f for f in found if len(f) > 1]
    return found[0] if found else "", set(found), bool(found)


def test_registry_authors(spark):
    from corpusloom.functions import authors

    texts = [
        None, "", " ,; ", "Smith,John; Van Dyke,Anna", "Woodward WA; De Rooij F; von der Leyen U.", "Smith, Barry M., Jones, Sarah, O'Neil, T. J.", "Müller", "van den", "De. Graaf X", "WA", "de WA", "Åström-Núñez, É.; Łuk",
        "'t Hooft G", "A; B; Li", "Smith  John\tPaul", "le, la", "Ñandú e\u0301clair", "van", "La Rue", ";;Smith;", "Smith,",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", authors.registry_authors(F.col("t")).alias("r")).collect()
    assert [(r.t, r.r.first, set(r.r.surnames), r.r.ok) for r in rows] == [(t, *brute_surnames(t)) for t in texts]
    cited = {"Daniel and Reynolds": ("daniel", "reynolds"), "Gebbink et al.": ("gebbink", ""), "van der Meer & de la Cruz, 2004": ("vandermeer", "delacruz"), "Smith": ("smith", ""), None: ("", ""), "X and Li and Wu": ("li", ""), "van der": ("vander", ""), "Émile et. al": ("emile", ""), "andover": ("andover", "")}
    got = spark.createDataFrame([(c,) for c in cited], "t string").select("t", authors.target_authors(F.col("t")).alias("r")).collect()
    assert {r.t: tuple(r.r) for r in got} == cited
    names = {"Abdul-Wajid et al. - 2015 - Title.md": "abdulwajid", "Autorino_2026_Tissue.md": "autorino", "2020_x.md": "", "X - y.md": ""}
    assert {r.t: r.s for r in spark.createDataFrame([(n,) for n in names], "t string").select("t", authors.filename_surname(F.col("t")).alias("s")).collect()} == names


def test_broken_answers(spark):
    from corpusloom.functions import answers

    rows = ['{"1": {"article_type": "review", "topics": ["a", \'b c\']}, "2": {"article_type": "methods" "topics": [x, ]}, "3": {"article_type": "review", "topics": ["cut', "```json\n{\"7\": {\"article_type\": \"review\",\n \"topics\": []}, \"7\": {\"article_type\": \"new\", \"topics\": [\"z\"]}}\n```", "none", None]
    got = [{k: (v.article_type, v.topics) for k, v in r.m.items()} for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").select(answers.detailed_rows(F.col("t")).alias("m")).collect()]
    assert got == [{1: ("review", ["a", "b c"]), 2: ("methods", ["x"])}, {7: ("new", ["z"])}, {}, {}]
    texts = {
        '{"claim": "c", "expected_evidence": ["a", "", 3], "scores": {"interesting": 2.5, "feasible": 99, "testable": null}}': ("c", ["a", "3"], 2, 10, None), 'so {"claim": "in {braces}"} it is': ("in {braces}", None, None, None, None), '{"claim": "cut': None, "[1]": None, "": None,
        '```\n{"claim": " x ", "expected_evidence": "one", "scores": {"interesting": "7"}}\n```': ("x", ["one"], 7, None, None), '{"claim": "  "}': None, '{"a": 1} and {"claim": "two"}': None,
    }
    got = {r.t: r.h and (r.h.claim, r.h.expected_evidence or None, r.h.interesting, r.h.feasible, r.h.testable) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", answers.hypothesis(F.col("t")).alias("h")).collect()}
    assert got == texts
    said = {'{"verdict": " SUPPORTED ", "reason": "r "}': ("supported", "r"), '{"verdict": "no"}': None, "x": None, '```json {"verdict": "inconclusive"}```': ("inconclusive", "")}
    assert {r.t: r.v and tuple(r.v) for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", answers.verdict(F.col("t")).alias("v")).collect()} == said


def test_normal_forms_equal_the_standard_library(spark):
    import random
    import unicodedata

    from corpusloom.functions import normal

    rng = random.Random(3)
    marks, composed, canonical = list(normal._MARKS), list(normal._COMPOSED), list(normal._CANONICAL)
    hangul = [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xAC00, 0xAC60))]
    pools = ["abeioAEO \n", marks, "\u0301\u0323\u0308\u0304\u0327\u0345", composed, canonical, [d[-1] for d in normal._CANONICAL.values()], hangul]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [unicodedata.normalize(form, c) for c in (*composed, *canonical) for form in ("NFC", "NFD", "NFKD")] + composed
    texts += ["", "plain", None, "\u0323\u0301 leads", "\u1112\u1161\u11ab\u11ab", "e\u0301" * 5000 + "e\u0323\u0301"]

    def bare(t):  # syllables stay whole
        return "".join(c for x in t for c in (x if 0xAC00 <= ord(x) < 0xD7A4 else unicodedata.normalize("NFKD", x)) if not unicodedata.combining(c))

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normal.nfkc(F.col("t")).alias("a"), normal.bare(F.col("t")).alias("b"))
    for r in df.collect():
        assert (r.a, r.b) == ((None, None) if r.t is None else (unicodedata.normalize("NFKC", r.t), bare(r.t)))


def test_strict_normal_composes(spark):
    assert one(spark, tx.strict_normal, "cafe\u0301 \ufb01g\u3000\u2013 x") == "caf\u00e9 fig - x"
    assert one(spark, tx.squash, "\u0132ssel, Mu\u0308ller \u2460") == "ijsselmuller1"
