"""Compaction, the prefix trie and the mix of sources against brute force, and on messy rows."""

import glob
import hashlib
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, compaction, mixing, queries, trie

# 11 ---------------------------------------------------------------------------------------------------------------


def brute_files(rows):
    """What compaction leaves of rows (click_id, arrived_at, value): day, lot, piece, sources, ids, cents, rewritten of each file."""
    share = lambda x: 1 + len(rows) // x
    days = defaultdict(list)
    for i, at, value in rows:
        days[None if at is None else (at - datetime(1970, 1, 1)) // timedelta(days=1)].append((i, at, value))
    out = []
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            files[h // 16 % (1 + len(own) // share(150)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[1] is not None, r[1] or datetime.min, r[0] is not None, r[0] or 0))
        groups = []
        for k in sorted((k for k in files if len(files[k]) < share(600)), key=lambda k: (-len(files[k]), k)):
            size = len(files[k])
            room = next((g for g in groups if sum(len(files[x]) for x in g) + size <= share(400)), None)
            if room is None:
                groups.append([k])
            else:
                room.append(k)
        groups += [[k] for k in files if len(files[k]) >= share(600)]
        for g in groups:
            every = [r for k in g for r in files[k]]
            cents = sum(int((Decimal(float(100 * r[2] + 0.5))).to_integral_value("ROUND_FLOOR")) for r in every if r[2] is not None)
            out.append((str(day), *g[0], ",".join(f"{a}-{b}" for a, b in g), ["" if r[0] is None else str(r[0]) for r in every], cents, len(g) > 1))
    return sorted(out)


def held(files, folder_of):
    got = []
    for r in files:
        t = pq.ParquetFile(r.path.removeprefix("file://")).read()
        ids = ["" if i is None else str(i) for i in t.column("click_id").to_pylist()]
        assert r.columns == ",".join(t.column_names) and r.n_rows == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        known = [int(i) for i in ids if i]
        assert (r.min_click_id, r.max_click_id) == ((min(known), max(known)) if known else (None, None))
        got.append((str(r.day), r.lot, r.piece, r.sources, ids, r.cents, r.rewritten))
    assert sorted(glob.glob(f"{folder_of}/**/*.parquet", recursive=True)) == sorted(r.path.removeprefix("file://") for r in files)
    return sorted(got)


def test_compaction_equals_brute_force(spark, sf):
    got = queries.QUERIES["op11_compaction"](spark, sf).collect()
    clicks = common.table(spark, sf, "clicks")
    folder = got[0].path.removeprefix("file://").rpartition("/")[0]
    assert held(got, folder) == brute_files([(r.click_id, r.arrived_at, r.value) for r in clicks.collect()])
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)
    again = queries.QUERIES["op11_compaction"](spark, sf).drop("path").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in spark.createDataFrame(got).drop("path").select(*again[0].__fields__).collect())


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_compaction_of_messy_rows(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)  # with broadcasts, and with shuffled joins only
    start = datetime(1969, 12, 30)
    rows = [(None if i % 17 == 0 else i % 900 - 40, None if i % 13 == 0 else start + timedelta(hours=(i * i) % 200 if i % 3 else 60), None if i % 5 == 0 else i / 8 - 30.0, "clash", i % 2) for i in range(1500)]
    df = spark.createDataFrame(rows + rows[:200], "click_id long, arrived_at timestamp_ntz, value double, _file string, `day.of` long").repartition(3)
    folder = str(tmp_path / "out")
    files = compaction.compact(spark, df, folder, "arrived_at", "click_id")
    got = compaction.described(spark, df.schema, folder, files, "click_id", "value").collect()
    assert held(got, folder) == brute_files([r[:3] for r in rows + rows[:200]])
    assert sorted(map(repr, spark.read.parquet(folder).collect())) == sorted(map(repr, df.collect()))


def test_compaction_of_nothing(spark, sf, monkeypatch):
    clicks = common.table(spark, sf, "clicks")
    monkeypatch.setattr(compaction, "table", lambda *_: clicks.filter("false"))
    out = queries.QUERIES["op11_compaction"](spark, sf)
    assert out.count() == 0 and out.columns[:3] == ["day", "lot", "piece"]


def test_first_fit_in_lockstep():
    rng = np.random.default_rng(5)
    sizes = -np.sort(-rng.integers(1, 50, (40, 30)) * (rng.random((40, 30)) < 0.8), axis=1)
    at = compaction.first_fit(sizes, 60)
    for day, row in enumerate(sizes):
        left = []
        for rank, size in enumerate(row):
            if not size:
                assert at[day, rank] == -1
                continue
            g = next((i for i, x in enumerate(left) if x >= size), len(left))
            left[g:] = left[g:] or [60]
            left[g] -= size
            assert at[day, rank] == g


# 12 ---------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    """A row for each node of the trie of rows (conv_id, turn, role, text), one conversation at a time."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((n is not None, n or 0, hashlib.md5(f"{role}\x01{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    words = lambda t: len([w for w in t.translate({i: 32 for i in range(9, 14)}).split(" ") if w])
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = int(not kids[node]), (len(members[node]) - 1) * (words(node[-1][1]) if node else 0)
        sums[node] = (leaves + sum(sums[k][0] for k in kids[node]), saved + sum(sums[k][1] for k in kids[node]))
    ends = lambda node: hashlib.sha256(",".join(str(c) for c in members[node] if len(built[c]) == len(node)).encode()).hexdigest()
    return sorted((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids[node]), *sums[node], ends(node)) for node, m in members.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = common.table(spark, sf, "conversations").collect()
    assert sorted(tuple(r[c] for c in TRIE) for r in queries.QUERIES["op12_prefix_trie"](spark, sf).collect()) == brute_trie([tuple(r) for r in rows])


def test_trie_of_messy_rows(spark, monkeypatch):
    """One long conversation over several ranges, common beginnings, copies, ties, nulls, ids below zero, and bases that are absent or short."""
    monkeypatch.setattr(trie, "CHUNK", 3)
    rng = np.random.default_rng(3)
    rows = [(40, i, "user" if i % 2 else None, f"turn {i % 7} x\x0b\u00a0y") for i in range(700)]
    for c in range(-30, 90):
        if c not in (40, 20):
            rows += [(c, None if i == 0 and c % 4 == 0 else i, ["user", "assistant", None][(i + int(c == 3)) % 3], None if i == 2 else ["a b", "c", "", "a b"][int(rng.integers(0, 1 + (c % 3 + i) % 4))]) for i in range(int(rng.integers(0, 7)))]
    rows += [(81, 1, "user", "tie b"), (81, 1, "user", "tie a"), (81, 1, "user", "tie a"), (None, 1, "user", "no one's"), (100, None, None, None), (101, None, None, None), (102, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for c in ("node", "depth", "words", "_p", "pos"):
        df = df.withColumn(c, F.lit("clash"))
    assert sorted((tuple(r[c] for c in TRIE) for r in trie.prefix_trie(df).collect()), key=repr) == sorted(brute_trie(rows), key=repr)
    assert trie.prefix_trie(df.filter("false")).count() == 0


# 13 ---------------------------------------------------------------------------------------------------------------


def brute_mix(rows):
    """size, source_size, target, taken of rows (doc_id, text, source), each in the order of its hash."""
    from decimal import Decimal as D
    from fractions import Fraction as Fr
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for n, (i, t, s) in enumerate(rows):
        h = int(hashlib.md5("|".join(["" if i is None else str(i), s or "", t or ""]).encode()).hexdigest()[:15], 16)
        by[s].append((h, size(t), n))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(x[1] for x in by[s]) for s in names}
    full, target = set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = Fr(3, 2) * sum(total.values()) - sum(2 * total[s] for s in full)
        target = {s: Fr(2 * total[s]) if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    out = {}
    for s in names:
        whole = int(min(target[s] / total[s], 2)) if total[s] else 0
        rest, longest, taken, yes = target[s] - whole * total[s], 2**62, 0, set()
        for h, n in sorted((h, sum(x[1] for x in by[s] if x[0] == h)) for h in {x[0] for x in by[s] if x[1]}):
            each = next(x[1] for x in by[s] if x[0] == h)
            if each > longest:
                continue
            if taken + n <= rest:
                taken += n
                yes.add(h)
            elif rest - taken > target[s] / 1000:
                longest = int(rest - taken)
            else:
                longest = 0
        for h, n, at in by[s]:
            out[at] = (n, total[s], round(float(target[s]), 6), n * (whole + (h in yes)))
    return [out[n] for n in range(len(rows))]


@pytest.mark.parametrize("most", [32 << 20, 0])
@pytest.mark.parametrize("step", [12, 4])
def test_mix_equals_brute_force(spark, monkeypatch, most, step):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    monkeypatch.setattr(mixing, "STEP", step)
    rng = np.random.default_rng(7)
    rows = [(None if i % 50 == 0 else i, None if i % 31 == 0 else "w\x0b \u00a0x " * int(rng.integers(0, 1 + 400 // (1 + i % 40))), [None, "a", "B", "é", "z9", "", "\U0001f600"][min(6, i % 11)]) for i in range(200)]
    rows += [(7, "same row", "a")] * 5 + [(8, "long " * 3000, "z9")] + [(900 + i, None, "empty") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("size", "target", "_x", "n", "_b"):
        df = df.withColumn(c, F.lit("clash"))
    out = mixing.mix(df)
    assert set(out.columns) == {"doc_id", "text", "source", "size", "source_size", "target", "taken", "_x", "n", "_b"}
    got = sorted((r.doc_id or 0, r.source or "", r.text or "", r.size, r.source_size, round(r.target, 6), r.taken) for r in out.collect())
    assert got == sorted((i or 0, s or "", t or "", *b) for (i, t, s), b in zip(rows, brute_mix(rows)))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2
