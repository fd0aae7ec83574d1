"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and read by FILTERS learned filters of WIDTH bytes. The filters run over chunks of CHUNK window
starts; neighbouring chunks overlap by WIDTH - 1 bytes, and the last one is moved back to end with the text, so every window of
the whole document is read. Each filter is max-pooled in each chunk. Over the document's chunks the pooled values
give their maximum, mean and minimum, and one hidden layer turns these into a single probability.

Training runs on the driver on at most TRAIN_ROWS labelled rows (those with the least hash of their id) and TRAIN_BYTES of
text, from each at most TRAIN_CHUNKS chunks an epoch. Executors cut a longer training text to TRAIN_PIECES evenly spaced pieces, TRAIN_TEXT characters in all, and the
bytes are counted before anything is sent. A share SNIPPETS of the rows is cut to a few words, so that short texts are
known too. Scoring reads everything. Nothing but the text's bytes enters a score.

Defined cases: null text is empty; an empty text is one blank chunk and gets a score like any other; repeated rows get equal
scores; without any usable label every score is 0.5; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, staged, table, text_or_empty

FILTERS, WIDTH, EMBED, HIDDEN = 32, 6, 4, 24
CHUNK = 256
PAD = 256  # the byte after the end of a text
TRAIN_ROWS = 4000
TRAIN_BYTES = 64 << 20
TRAIN_TEXT, TRAIN_PIECES = 1 << 16, 8  # characters of a training text
TRAIN_CHUNKS = 6
SNIPPETS = 0.15
EPOCHS = 24
FOLDS, HELD_OUT = 3, 1


def starts_of(n: int) -> np.ndarray:
    """Where the chunks of a text of n bytes start."""
    if n <= CHUNK + WIDTH - 1:
        return np.zeros(1, np.int64)
    last = n - (CHUNK + WIDTH - 1)
    return np.append(np.arange(0, last, CHUNK), last)


def chunks_of(raw: bytes, starts: np.ndarray | None = None) -> np.ndarray:
    """(chunks, CHUNK + WIDTH - 1) byte values; a short text is padded."""
    size = CHUNK + WIDTH - 1
    codes = np.frombuffer(raw, np.uint8).astype(np.int16)
    if len(codes) < size:
        codes = np.concatenate([codes, np.full(size - len(codes), PAD, np.int16)])
    starts = starts_of(len(raw)) if starts is None else starts
    return np.lib.stride_tricks.sliding_window_view(codes, size)[starts]


def pooled(chunks: np.ndarray, net: dict, where: bool = False):
    """Max-pooled filter values (chunks, FILTERS), and with where=True the windows that gave them."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    at = np.empty((len(chunks), FILTERS), np.int64) if where else None
    for i in range(0, len(chunks), 32):
        e = net["embed"][chunks[i : i + 32]]  # (b, size, EMBED)
        b, size, d = e.shape
        w = np.lib.stride_tricks.as_strided(e, (b, CHUNK, WIDTH * d), (e.strides[0], e.strides[1], e.strides[2]))
        z = (np.ascontiguousarray(w).reshape(b * CHUNK, WIDTH * d) @ net["filters"]).reshape(b, CHUNK, FILTERS)
        if where:
            at[i : i + b] = z.argmax(1)
        out[i : i + b] = z.max(1)
    return np.tanh(out + net["bias"]), at


def _document(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p.max(0), p.mean(0), p.min(0)])


def _head(x: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ net["w1"] + net["b1"])
    return h, 1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -30, 30)))


def score_texts(texts: list[str], net: dict | None) -> np.ndarray:
    """One probability for each text."""
    if net is None:
        return np.full(len(texts), 0.5)
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        # one text at a time, so that its score never depends on its company by a rounding
        out[i] = _head(_document(pooled(chunks_of(t.encode()), net)[0])[None], net)[1][0]
    return out


def _snippet(raw: bytes, rng: np.random.Generator) -> bytes:
    """A few neighbouring words of a text."""
    words = raw.split(b" ")
    n = int(rng.integers(1, 30))
    at = int(rng.integers(0, max(1, len(words) - n)))
    return b" ".join(words[at : at + n])


def train(rows: list[tuple[str, int]], seed: int = 5) -> dict | None:
    """Fit the network to (text, label) rows by Adam on the cross-entropy."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    net = {
        "embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
        "filters": rng.normal(0, 0.4, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.full(FILTERS, -1.0, np.float32),
        "w1": rng.normal(0, 0.15, (3 * FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        "b2": np.zeros(1, np.float32),
    }
    net["embed"][PAD] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    raws, labels, step = [t.encode() for t, _ in rows], np.array([y for _, y in rows], np.float32), 0
    epochs = EPOCHS if len(rows) >= 1500 else min(120, EPOCHS * 1500 // len(rows))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 24):
            some = order[lo : lo + 24]
            parts = []
            for i in some:
                if rng.random() < SNIPPETS:
                    parts.append(chunks_of(_snippet(raws[i], rng)[:CHUNK]))
                    continue
                starts = starts_of(len(raws[i]))
                if len(starts) > TRAIN_CHUNKS:
                    starts = np.sort(rng.choice(starts, TRAIN_CHUNKS, replace=False))
                parts.append(chunks_of(raws[i], starts))
            ends = np.cumsum([len(p) for p in parts])
            chunks = np.concatenate(parts)
            p, at = pooled(chunks, net, True)
            x = np.stack([_document(p[a:b]) for a, b in zip(ends - [len(q) for q in parts], ends)])
            h, y = _head(x, net)
            grad = {k: np.zeros_like(v) for k, v in net.items()}
            dy = (y - labels[some]) / len(some)
            grad["w2"], grad["b2"] = (h.T @ dy).astype(np.float32), np.array([dy.sum()], np.float32)
            dh = np.outer(dy, net["w2"]) * (1 - h * h)
            grad["w1"], grad["b1"] = x.T @ dh, dh.sum(0)
            dx = dh @ net["w1"].T
            dp = np.zeros_like(p)
            a = 0
            for k, b in enumerate(ends):
                own, cols = p[a:b], np.arange(FILTERS)
                dp[a:b] += dx[k, FILTERS : 2 * FILTERS] / (b - a)
                dp[a + own.argmax(0), cols] += dx[k, :FILTERS]
                dp[a + own.argmin(0), cols] += dx[k, 2 * FILTERS :]
                a = b
            dz = dp * (1 - p * p)  # (chunks, FILTERS)
            grad["bias"] = dz.sum(0)
            codes = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # (chunks, FILTERS, WIDTH)
            seen = net["embed"][codes].reshape(len(chunks), FILTERS, WIDTH * EMBED)
            grad["filters"] = np.einsum("cf,cfk->kf", dz, seen, optimize=True)
            back = np.einsum("cf,kf->cfk", dz, net["filters"], optimize=True).reshape(-1, EMBED)
            np.add.at(grad["embed"], codes.reshape(-1), back)
            grad["embed"][PAD] = 0
            step += 1
            rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                decay = 1e-4 * net[k] if k in ("w1", "filters") else 0
                net[k] -= (rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay)).astype(np.float32)
    return net


def fold(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def _pieces(text):
    """The whole text, or TRAIN_PIECES evenly spaced pieces of one longer than TRAIN_TEXT."""
    size = TRAIN_TEXT // TRAIN_PIECES
    n = F.length(text)
    cut = [F.substring(text, (F.lit(1) + F.floor((n - size) * F.lit(i) / F.lit(TRAIN_PIECES - 1))).cast("int"), F.lit(size)) for i in range(TRAIN_PIECES)]
    return F.when(n <= TRAIN_TEXT, text).otherwise(F.concat(*cut))


def sample(docs: DataFrame, labels: DataFrame, text: str = "text") -> list[tuple[str, int]]:
    """(text, label) of the training rows, in the order of their ids' hashes. A row that the bytes left don't hold is passed over."""
    known = labels.select("doc_id", F.col("quality").alias("_label")).filter("doc_id is not null and _label is not null").filter(fold() != HELD_OUT)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", text_or_empty(text).alias("_text")).join(F.broadcast(known), "doc_id")
    rows = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("_text").alias("tie"), F.col("_label").cast("int").alias("_label"), _pieces(F.col("_text")).alias("_text"))
    with scratch():
        rows = staged(rows.withColumn("bytes", F.octet_length("_text")), "labelled")
        order = ["h", "doc_id", "tie", "_label"]
        sizes = rows.select(*order, "bytes").distinct().orderBy(*order).limit(TRAIN_ROWS).collect()
        chosen, size = set(), 0
        for r in sizes:
            if size + r["bytes"] <= TRAIN_BYTES:
                size += r["bytes"]
                chosen.add((r["doc_id"], r["tie"], r["_label"]))
        if not chosen:
            return []
        wanted = docs.sparkSession.createDataFrame(sorted(chosen), rows.select("doc_id", "tie", "_label").schema)
        found = {}
        for r in rows.join(F.broadcast(wanted), ["doc_id", "tie", "_label"], "left_semi").toLocalIterator():
            found[r["h"], r["doc_id"], r["tie"], r["_label"]] = r["_text"]
    return [(found[k], int(k[3] > 0)) for k in sorted(found)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> dict | None:
    """The network for docs, fitted to the labelled rows outside the held-out fold."""
    return train(sample(docs, labels, text))


def score(docs: DataFrame, net: dict | None, text: str = "text") -> DataFrame:
    """docs with score (double) and predicted (int)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(list(texts), net))

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*keep, F.pandas_udf(run, "double")(text_or_empty(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", "predicted")
