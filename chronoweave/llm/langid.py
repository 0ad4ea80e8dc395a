"""Language ID as multilingual mixture inference.

Each word has a log-likelihood under every language: the sum of its hashed byte-trigram
log-probabilities.  For every document expectation-maximisation estimates the language
proportions over words; language sets are then compared by log-likelihood less half a
logarithm of the number of words for each language (a BIC penalty), and the best set's
proportions are returned; of equal values the smaller set wins.  By default the sets are
nested: the n languages of largest proportion for every n, where sizes end for a text once
the languages beyond hold no more than ``REST`` of it together, as a further one then gains
less than its penalty on any but very long texts.  ``every`` compares all subsets instead
(at most 12 languages); tests hold both against each other.

The tables are learned from a bounded sample: about ``per_lang`` rows for each language,
chosen by a hash of doc_id.  Their size is ``2**BITS`` numbers a language.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is all
when nothing can be learned; every input row gets one output row; ties go to the
language first in sorted order; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from .textops import NORMAL, Words, crc_mod, large, map_text, read, segment_sum, slices

BITS, REST = 16, 0.002
LETTER = re.compile(r"[^\W\d_]")
_NORMAL = np.frombuffer(NORMAL, np.uint8)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_tables: dict = {}


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that ends at each byte."""
    x = _NORMAL[data].astype(np.uint32)
    g = x.copy()
    g[1:] |= x[:-1] << 8
    g[2:] |= x[:-2] << 16
    g[0:1] |= 0x202000
    if len(g) > 1:
        g[1] = (g[1] & 0xFFFF) | 0x200000
    return (g * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def learn(docs: DataFrame, rows=lambda doc_id: F.lit(True), per_lang: int = 1500) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, from rows for which ``rows(doc_id)`` holds and lang is known."""
    known = docs.where("lang is not null and doc_id is not null").where(rows(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for l in langs for x in (l, min(1.0, per_lang / counts[l]))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    part = known.select("lang", "text").where(u < share[F.col("lang")]).repartition(8)
    ship(docs.sparkSession)
    index = {l: i for i, l in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(index), 1 << BITS), np.int64)
        for b in batches:
            names = b.column(0).to_pylist()
            for first, data, off in slices(large(b.column(1))):
                g = buckets(data)
                for i in range(len(off) - 1):
                    if off[i + 1] > off[i]:
                        total[index[names[first + i]]] += np.bincount(g[off[i] : off[i + 1]], minlength=1 << BITS)
        for i in range(len(index)):
            k = np.flatnonzero(total[i])
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i, np.int32)), pa.array(k.astype(np.int32)), pa.array(total[i][k])], names=["l", "k", "n"])

    t = part.mapInArrow(count, "l int, k int, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow()  # at most languages * 2**BITS rows
    n = np.full((1 << BITS, len(langs)), 0.0)
    n[t["k"].to_numpy(), t["l"].to_numpy()] = t["n"].to_numpy()
    back = n.sum(1, keepdims=True) + 0.5
    back /= back.sum()
    n += 200 * back  # smoothed towards the common distribution
    return langs, np.log(n / n.sum(0)).astype(np.float32)


def likelihoods(table: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word under each language, less its largest, and the rows' ranges of words."""
    w = Words(data, off)
    n_lang = table.shape[1]
    lp = table[buckets(data)]
    # the trigrams that end inside a word or at the byte after it
    ends = np.minimum(w.ends + 1, len(data))
    cuts = np.empty(2 * len(w.starts), np.int64)
    cuts[0::2], cuts[1::2] = w.starts, ends
    if len(cuts) and cuts[-1] >= len(data):
        lp = np.concatenate([lp, np.zeros((1, n_lang), np.float32)])
    ll = np.add.reduceat(lp, cuts, axis=0)[0::2] if len(cuts) else np.zeros((0, n_lang), np.float32)
    if len(ll):
        ll -= ll.max(axis=1, keepdims=True)
    return ll, w.rows


def infer(table: np.ndarray, data: np.ndarray, off: np.ndarray, rounds: int = 10, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Proportions under the selected language set, and the set, for each row of a slice."""
    ll, words = likelihoods(table, data, off)
    n_rows, n_lang = len(off) - 1, table.shape[1]
    n = np.diff(words)
    pi, like = _em(np.exp(ll), words, np.full((n_rows, n_lang), 1 / n_lang, np.float32), rounds)
    full, keep = pi, np.ones((n_rows, n_lang), bool)
    if n_lang == 1 or not n.any():
        return pi, keep
    rows_of = np.repeat(np.arange(n_rows), n)
    penalty = 0.5 * np.log(np.maximum(n, 2))
    best = like - n_lang * penalty
    order = np.argsort(-pi, axis=1, kind="stable")
    sets = [m for m in range((1 << n_lang) - 2, 0, -1)] if every else range(n_lang - 1, 0, -1)
    for s in sorted(sets, key=int.bit_count, reverse=True) if every else sets:  # the largest first, so equal values leave the smaller set
        if every:
            mask = np.tile((s >> np.arange(n_lang) & 1).astype(np.float32), (n_rows, 1))
            size = s.bit_count()
            rest = np.arange(n_rows)
        else:
            size, mask = s, np.zeros((n_rows, n_lang), np.float32)
            np.put_along_axis(mask, order[:, :size], 1, axis=1)
            rest = np.flatnonzero(1 - np.take_along_axis(full, order[:, : size - 1], 1).sum(1) > REST) if size > 1 else np.arange(n_rows)
        if not len(rest):
            continue
        got, one = mask.copy(), np.full(n_rows, -np.inf)
        if size == 1:
            one = segment_sum((ll * mask[rows_of]).sum(1, dtype=np.float64), words)
        else:
            sel = np.isin(rows_of, rest)
            sub = np.concatenate([[0], np.cumsum(n[rest])])
            start = (full[rest] + 1e-3) * mask[rest]
            start /= start.sum(1, keepdims=True)
            got[rest], one[rest] = _em(np.exp(ll[sel]), sub, start, rounds)
        value = one - size * penalty
        better = value >= best
        best = np.where(better, value, best)
        pi = np.where(better[:, None], got, pi).astype(np.float32)
        keep[better] = mask[better] > 0
    return pi, keep


def _em(like, off, pi, rounds):
    n = np.maximum(np.diff(off), 1)[:, None]
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for _ in range(rounds):
        r = like * pi[rows]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        pi = (segment_sum(r, off) / n).astype(np.float32)
    return pi, segment_sum(np.log(np.maximum((like * pi[rows]).sum(1, dtype=np.float64), 1e-30)), off)


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[str]) -> DataFrame:
    """``docs[keep]`` with lang_pred, score (its proportion) and mixture (lang:percent, largest first)."""
    sent, key = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex
    names = np.array(langs, object)

    def run(texts):
        if key not in _tables:
            _tables.clear()
            _tables[key] = sent.value
        t = _tables[key]
        pred, score, mixed = [], [], []
        for first, data, off in slices(texts):
            n = len(off) - 1
            ascii_letters = segment_sum(_ASCII_LETTER[data].astype(np.int32), off)
            lettered = np.array([bool(ascii_letters[i]) or bool(LETTER.search(texts[first + i].as_py())) for i in range(n)])
            if not len(names):
                pred += ["und"] * n
                score += [0.0] * n
                mixed += [""] * n
                continue
            pi, kept = infer(t, data, off)
            top = pi.argmax(1)
            for i in range(n):
                if not lettered[i]:
                    pred.append("und")
                    score.append(0.0)
                    mixed.append("")
                    continue
                pred.append(names[top[i]])
                score.append(min(1.0, max(0.0, float(pi[i, top[i]]))))
                own = [j for j in np.argsort(-pi[i], kind="stable") if kept[i, j] and pi[i, j] >= 0.005]
                mixed.append(",".join(f"{names[j]}:{round(100 * float(pi[i, j]))}" for j in own))
        return [pred, score, mixed]

    return map_text(docs, run, {"lang_pred": pa.string(), "score": pa.float64(), "mixture": pa.string()}, keep)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    langs, table = learn(docs, rows=lambda i: crc_mod(i, 3) != 1)
    return identify(docs, langs, table, ["doc_id"]).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "mixture")
