"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word's embedding is the sum of one row for the word and one for its first four bytes.
Filters of widths 1, 2 and 3 slide over the words of a text; each filter's maximum feeds
a logistic output.  One embedding dimension starts from the smoothed class log-odds of the
bucket.  A text's language is guessed from its own words, so only the text enters a score.
Scores are shifted so that 0.5 is the calibrated threshold of the guessed language.

Every labelled row is learned from, whole.  Rows are dealt by a hash of doc_id into shards
of about ``SHARD`` bytes of text; each shard is trained by plain Adam in numpy from the same
start (up to ``EPOCHS`` epochs, fewer from ``PASSES`` rows on), and the changes of the shards
are averaged: a row of the embeddings over the shards that changed it.  Log-odds and word
counts of the languages are those of all rows.  A fifth of the documents, by another hash,
is held back; the thresholds make the fewest errors on all labelled rows of these, counted
by logits rounded to 1 / ``STEPS``.  So a model depends on the rows alone, not on their
partitions (but for the rounding of sums).

Defined cases: null and empty texts get the score of an all-empty text; with no labelled
rows of both classes every score is 0; labels that are null are ignored, repeated labels
of a document count as often as they occur; every input row gets one output row; input
columns named like outputs are replaced (``names`` gives others); an empty table gives an
empty result; labels that are of one class without those held back are learned from in whole.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..storage import kept
from .textops import Words, crc_mod, map_text, read, segment_max, segment_sum, slices

WORD_BITS, PREFIX_BITS = 15, 14
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
#: bytes of text and words of a shard (a larger one is trained in parts), most words of a step, epochs, rows from which there are fewer, shards added at a time
SHARD, PIECE, STEP, EPOCHS, PASSES, FAN = 64 << 20, 8 << 20, 1 << 18, 6, 24_000, 16
#: thresholds are sought among logits within +-LIMIT in steps of 1 / STEPS
LIMIT, STEPS = 64, 256
_models: dict = {}


def word_ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    a = (w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.uint16)
    b = (w.prefix_hash(4) >> np.uint64(64 - PREFIX_BITS)).astype(np.uint16)
    return a, b


def forward(p: dict, a: np.ndarray, b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Pooled filter outputs, one row for each text."""
    x = p["E"][a]
    x += p["P"][b]
    pooled = []
    for k in WIDTHS:
        y = x @ p[f"W{k}"][0]
        for j in range(1, k):
            z = x @ p[f"W{k}"][j]
            # a window does not reach over the end of its text
            y[:-j] += z[j:]
        if k > 1:
            for j in range(1, k):
                cut = off[1:] - j
                y[cut[(cut >= off[:-1]) & (off[1:] > off[:-1])]] = -1e3
        pooled.append(np.maximum(segment_max(y, off, -1e3) + p[f"b{k}"], 0))
    return np.concatenate(pooled, axis=1)


def logits(p: dict, a, b, off) -> np.ndarray:
    return forward(p, a, b, off) @ p["o"] + p["c"]


def guess(p: dict, a, off) -> np.ndarray:
    return segment_sum(p["L"][a], off).argmax(axis=1) if p["L"].shape[1] else np.zeros(len(off) - 1, int)


def start(seed: int = 7) -> dict:
    """The parameters from which every shard is trained, but for the log-odds."""
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.05, (1 << WORD_BITS, DIM)).astype(np.float32), "P": rng.normal(0, 0.05, (1 << PREFIX_BITS, DIM)).astype(np.float32), "c": np.float32(-1)}
    for k in WIDTHS:
        p[f"W{k}"] = rng.normal(0, 0.25, (k, DIM, FILTERS)).astype(np.float32)
        p[f"W{k}"][:, 0, : FILTERS // 2] = np.abs(p[f"W{k}"][:, 0, : FILTERS // 2]) + 0.5
        p[f"b{k}"] = np.full(FILTERS, -0.5, np.float32)
    p["o"] = rng.normal(0.1, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
    return p


def _with_odds(p: dict, got: dict) -> dict:
    """``p`` with the log-odds of the counts of rows of each class that hold a word (or prefix)."""
    neg, pos = (max(1.0, float(x)) for x in got["rows"])
    for k in ("E", "P"):
        n = got[f"in {k}"].reshape(2, -1)
        p[k][:, 0] = 0.5 * np.log((n[1] / pos * neg + 2) / (n[0] + 2))
    return p


def learned(data: list[tuple], seed: int = 7, batch: int = 32, rate: float = 0.01) -> dict[str, np.ndarray]:
    """What a shard adds to the sums of which ``merged`` makes a model; data: (y, n, lang, word ids, prefix ids), n equal rows each."""
    y, n = np.array([d[0] for d in data], np.float32), np.array([d[1] for d in data], np.int64)
    A, B = ([np.frombuffer(d[i], np.uint16) for d in data] for i in (3, 4))
    out = {"rows": np.array([n[y == 0].sum(), n[y == 1].sum()], float)}
    for k, ids, bits in (("E", A, WORD_BITS), ("P", B, PREFIX_BITS)):
        has = out[f"in {k}"] = np.zeros(2 << bits)
        for i, x in enumerate(ids):
            has[(int(y[i]) << bits) + np.unique(x)] += n[i]
    for i, d in enumerate(data):
        own = out.setdefault(f"lang {d[2]}", np.zeros(1 << WORD_BITS))
        np.add.at(own, A[i], n[i])
    if not out["rows"].all():
        return out
    p = _with_odds(start(seed), out)
    was = {k: v.copy() for k, v in p.items()}
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    rows = np.repeat(np.arange(len(data)), n)
    pos_weight = float(np.clip(out["rows"][0] / out["rows"][1], 0.2, 5))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(max(1, min(EPOCHS, math.ceil(PASSES / len(rows))))):
        order = rng.permutation(rows)
        ends = np.cumsum([len(A[i]) for i in order])
        at = 0
        while at < len(order):
            # a step has few words, or one row
            to = max(at + 1, min(at + batch, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right"))))
            own, at = order[at:to], to
            step += 1
            grads, touched = _gradients(p, [A[i] for i in own], [B[i] for i in own], y[own], pos_weight)
            for k, g in grads.items():
                where = touched.get(k, ...)
                m1, m2 = m[k]
                if k == "c":
                    m1 = m[k][0] = np.float32(0.9 * m1 + 0.1 * g)
                    m2 = m[k][1] = np.float32(0.999 * m2 + 0.001 * g * g)
                    p[k] = np.float32(p[k] - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-6))
                    continue
                m1[where] = 0.9 * m1[where] + 0.1 * g
                m2[where] = 0.999 * m2[where] + 0.001 * g * g
                p[k][where] -= rate * (m1[where] / (1 - 0.9**step)) / (np.sqrt(m2[where] / (1 - 0.999**step)) + 1e-6)
    for k, v in p.items():
        d = out[f"by {k}"] = (v - was[k]).astype(float).ravel()
        out[f"of {k}"] = (d.reshape(-1, DIM) != 0).any(1).astype(float) if k in "EP" else np.ones(1)
    return out


def added(to: dict, more: dict) -> dict:
    for k, v in more.items():
        to[k] = to[k] + v if k in to else v
    return to


def merged(got: dict, seed: int = 7) -> dict | None:
    """The model of the sums of all shards, without thresholds; None without rows of both classes."""
    if "rows" not in got or not got["rows"].all():
        return None
    p = _with_odds(start(seed), got)
    for k in list(p):
        if f"by {k}" in got:
            by = got[f"by {k}"].reshape(np.shape(p[k])) / (np.maximum(got[f"of {k}"], 1)[:, None] if k in "EP" else got[f"of {k}"][0])
            p[k] = (p[k] + by).astype(np.float32) if np.ndim(p[k]) else np.float32(p[k] + by)
    langs = sorted(k for k in got if k.startswith("lang "))
    counts = np.stack([got[k] for k in langs], 1) + 0.1
    p["L"] = np.log(counts / counts.sum(0)).astype(np.float32)
    return p


def fit(data: list[tuple], seed: int = 7) -> dict | None:
    """The model of rows (id, y, lang, word ids, prefix ids) at hand, as one shard."""
    y = np.array([d[1] for d in data], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    hold = np.random.default_rng(seed).random(len(y)) < 0.2
    if len(set(y[~hold])) < 2:
        hold[:] = False
    p = merged(learned([(d[1], 1, *d[2:]) for d, h in zip(data, hold, strict=True) if not h], seed), seed)
    p["t"] = _thresholds(p, [np.frombuffer(d[3], np.uint16) for d in data], [np.frombuffer(d[4], np.uint16) for d in data], y, np.flatnonzero(hold))
    return p


def _gradients(p, A, B, y, pos_weight):
    lens = np.array([len(a) for a in A])
    off = np.concatenate([[0], np.cumsum(lens)])
    a, b = np.concatenate(A).astype(np.int64), np.concatenate(B).astype(np.int64)
    x = p["E"][a] + p["P"][b]
    best, feats, masks = [], [], []
    for k in WIDTHS:
        f, at = np.zeros((len(y), FILTERS), np.float32), np.full((len(y), FILTERS), -1, np.int64)
        for i in range(len(y)):
            s, e = off[i], off[i + 1]
            if e - s < k:
                continue
            r = sum(x[s + j : e - k + 1 + j] @ p[f"W{k}"][j] for j in range(k)) + p[f"b{k}"]
            at[i] = r.argmax(0) + s
            f[i] = r.max(0)
        best.append(at)
        masks.append((f > 0) & (at >= 0))
        feats.append(np.maximum(f, 0))
    h = np.concatenate(feats, axis=1)
    z = h @ p["o"] + p["c"]
    d = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, pos_weight, 1) / len(y)
    g = {"o": (d @ h).astype(np.float32), "c": np.float32(d.sum())}
    dh = (d[:, None] * p["o"][None]).astype(np.float32)
    ids, grads = [], []
    for n, k in enumerate(WIDTHS):
        dk = np.where(masks[n], dh[:, n * FILTERS : (n + 1) * FILTERS], 0)
        g[f"b{k}"] = dk.sum(0)
        gw = np.zeros_like(p[f"W{k}"])
        r, f = np.nonzero(dk)
        pos, val = best[n][r, f], dk[r, f]
        for j in range(k):
            np.add.at(gw[j].T, f, val[:, None] * x[pos + j])
            ids.append(pos + j)
            grads.append(val[:, None] * p[f"W{k}"][j].T[f])
        g[f"W{k}"] = gw
    touched = {}
    if ids and sum(map(len, ids)):
        at, gx = np.concatenate(ids), np.concatenate(grads)
        for name, table in (("E", a), ("P", b)):
            u, inv = np.unique(table[at], return_inverse=True)
            s = np.zeros((len(u), DIM), np.float32)
            np.add.at(s, inv, gx)
            g[name], touched[name] = s, u
    return g, touched


def _thresholds(p, A, B, y, rows) -> np.ndarray:
    """``thresholds`` of the rows named."""
    z, g = np.zeros(len(rows)), np.zeros(len(rows), int)
    for i, r in enumerate(rows):
        off = np.array([0, len(A[r])])
        z[i], g[i] = logits(p, A[r], B[r], off)[0], guess(p, A[r], off)[0]
    return thresholds(p["L"].shape[1], g, z, 1 - y[rows], y[rows])


def thresholds(langs: int, g: np.ndarray, z: np.ndarray, neg: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each guessed language g the logit z that makes the fewest errors on rows held back (neg and pos of each class), shrunk to the common one."""

    def cut(own):
        if not pos[own].sum() or not neg[own].sum():
            return None
        zs, at = np.unique(z[own], return_inverse=True)
        p, n = np.bincount(at, pos[own]), np.bincount(at, neg[own])
        errors = np.concatenate([[0], np.cumsum(p)]) + np.concatenate([np.cumsum(n[::-1])[::-1], [0]])
        best = np.flatnonzero(errors == errors.min())
        at = best[len(best) // 2]
        lo, hi = (zs[at - 1] if at else zs[0] - 1), (zs[at] if at < len(zs) else zs[-1] + 1)
        return (lo + hi) / 2

    common = cut(np.ones(len(z), bool))
    common = 0.0 if common is None else common
    out = np.full(langs, common, np.float32)
    for j in range(langs):
        c = cut(g == j)
        if c is not None:
            k = neg[g == j].sum() + pos[g == j].sum()
            out[j] = (k * c + 50 * common) / (k + 50)
    return out


def _shards(docs: DataFrame, lab: DataFrame, held) -> DataFrame:
    """name, v: the sums of ``learned`` of the shards of each task; labels and word ids of a document meet by one shuffle."""

    def ids(texts):
        out = []
        for _, data, off in slices(texts):
            w = Words(data, off)
            a, b = word_ids(w)
            out += [a[w.rows[i] : w.rows[i + 1]].tobytes() + b[w.rows[i] : w.rows[i + 1]].tobytes() for i in range(len(off) - 1)]
        return [out]

    docs, lab = docs.where(~held), lab.where(~held)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = map_text(docs, ids, {"v": pa.binary()}, ["doc_id", "lang"])
    rows = lab.select("doc_id", "n0", "n1", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("v"))
    rows = rows.unionByName(words.select("doc_id", F.lit(None).cast("long").alias("n0"), F.lit(None).cast("long").alias("n1"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "v"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.ceil(size / SHARD)))))

    def run(batches):
        total, data, n, shard, doc, label = {}, [], 0, None, None, (0, 0)
        for b in batches:
            for s, d, n0, n1, lang, v in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if s != shard or n > PIECE:
                    if data:
                        total = added(total, learned(data))
                    shard, data, n = s, [], 0
                if d != doc:
                    doc, label = d, (0, 0)
                if v is None:  # a document's labels come before its texts
                    label = n0, n1
                    continue
                for y in (0, 1):
                    if label[y]:
                        data.append((y, label[y], lang, v[: len(v) // 2], v[len(v) // 2 :]))
                        n += len(v) // 4
        if data:
            total = added(total, learned(data))
        if total:
            yield _sums(total)

    return kept(rows.repartition("shard").sortWithinPartitions("shard", "doc_id", F.col("v").isNotNull(), "lang", "v").select("shard", "doc_id", "n0", "n1", "lang", "v").mapInArrow(run, "name string, v binary"))


def _sums(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["name", "v"])


def _total(sums: DataFrame) -> dict:
    """The sums of all tasks, added ``FAN`` tasks at a time."""

    def add(batches):
        total = {}
        for b in batches:
            for k, v in zip(*[x.to_pylist() for x in b.columns], strict=True):
                total = added(total, {k: np.frombuffer(v)})
        if total:
            yield _sums(total)

    ship(sums.sparkSession)
    while (n := sums.rdd.getNumPartitions()) > 1:
        sums = kept(sums.coalesce(math.ceil(n / FAN)).mapInArrow(add, "name string, v binary"))
    return {r["name"]: np.frombuffer(r["v"]) for r in sums.collect()}  # one model


def train(docs: DataFrame, labels: DataFrame, rows=lambda doc_id: F.lit(True)) -> dict | None:
    """The model, learned from all labelled rows for which ``rows(doc_id)`` holds, and from no others."""
    own = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & rows(F.col("doc_id")))
    lab = labels.where("toxic is not null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), (F.col("toxic") > 0).alias("y"))
    lab = lab.where(F.col("doc_id").isNotNull() & rows(F.col("doc_id"))).groupBy("doc_id").agg(F.count_if(~F.col("y")).alias("n0"), F.count_if("y").alias("n1"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    model = merged(_total(_shards(own, lab, held)))
    if model is None:
        model = merged(_total(_shards(own, lab, F.lit(False))))
        if model:
            model["t"] = np.zeros(model["L"].shape[1], np.float32)
        return model
    got = _logits(own.where(held), model, ["doc_id"]).join(lab, "doc_id").groupBy("g", "z").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most 2 * LIMIT * STEPS rows a language
    g, z, n0, n1 = (got[c].to_numpy() for c in ("g", "z", "n0", "n1"))
    model["t"] = thresholds(model["L"].shape[1], g, z / STEPS, n0.astype(float), n1.astype(float))
    return model


def _logits(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``docs[keep]`` with the guessed language g and the rounded logit z, in steps of 1 / ``STEPS``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        g, z = [], []
        for _, data, off in slices(texts):
            w = Words(data, off)
            a, b = word_ids(w)
            g.append(guess(sent.value, a, w.rows))
            z.append(np.rint(np.clip(logits(sent.value, a, b, w.rows), -LIMIT, LIMIT) * STEPS).astype(np.int64))
        return [np.concatenate(x) if x else [] for x in (g, z)]

    return map_text(docs, run, {"g": pa.int64(), "z": pa.int64()}, keep)


def score(docs: DataFrame, model: dict | None, keep: list[str], names: tuple = ("score", "predicted")) -> DataFrame:
    """``docs[keep]`` with score (0 to 1) and predicted (1 from 0.5), under the names given."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(texts):
        if key not in _models:
            _models.clear()
            _models[key] = sent.value
        p = _models[key]
        if p is None:
            return [np.zeros(len(texts)), np.zeros(len(texts), np.int32)]
        out = []
        for _, data, off in slices(texts):
            w = Words(data, off)
            a, b = word_ids(w)
            z = logits(p, a, b, w.rows) - p["t"][guess(p, a, w.rows)]
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        s = np.concatenate(out) if out else np.zeros(0)
        return [s, (s >= 0.5).astype(np.int32)]

    return map_text(docs, run, dict(zip(names, (pa.float64(), pa.int32()), strict=True)), keep)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), rows=lambda i: crc_mod(i, 5) != 0)
    return score(docs, model, ["doc_id"]).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
