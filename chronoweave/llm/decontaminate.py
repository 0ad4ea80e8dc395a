"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is
``n`` consecutive item words; an item of fewer, but not none, is one window.  Each
document is scanned once; a document word inside any occurrence of a window is hit.

Defined cases: null or empty texts have no words and hit nothing; an empty benchmark
hits nothing; a null item_id still marks words but is neither counted nor listed;
repeated item rows count once; repeated documents each get a row; other columns are
ignored or passed on whatever their names (``names`` gives those of the outputs).  A
benchmark of up to ``shard_chars`` characters is one automaton, scanned once.  An automaton
takes about 450 bytes a character (0.5 million characters took 225 MB), so the default is
450 MB in each Python worker; a larger benchmark is split into several, each scanning the
documents once, whose word hits are united by text.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import NORMAL, map_text, read, unused

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_built: dict = {}


def _pad(text: str) -> str:
    """Words each followed by a space, after one space, as UTF-8 bytes read as Latin-1 characters."""
    words = text.encode("utf-8", "surrogatepass").translate(NORMAL).split()
    return b" ".join([b"", *words, b""]).decode("latin-1") if words else " "


def windows(text: str, n: int) -> list[str]:
    words = _pad(text).split(" ")[1:-1]  # by spaces only: UTF-8 bytes may read as other blanks
    if not words:
        return []
    return [" " + " ".join(words[i : i + n]) + " " for i in range(max(1, len(words) - n + 1))]


def automaton(items: list[tuple], n: int):
    """items: (item_id as text or None, text)."""
    ids: dict[str, set] = {}
    for i, text in items:
        for w in windows(text or "", n):
            ids.setdefault(w, set()).add(i)
    a = ahocorasick.Automaton()
    for w, s in ids.items():
        a.add_word(w, (len(w), w.count(" ") - 1, tuple(sorted(x for x in s if x is not None))))
    if ids:
        a.make_automaton()
        return a
    return None


def scan(a, text: str) -> tuple[int, list[tuple[int, int]], set]:
    """Words, merged hit word ranges [start, end), and item ids."""
    t = _pad(text)
    n_words = max(0, t.count(" ") - 1)
    if a is None or not n_words:
        return n_words, [], set()
    ends: list[tuple[int, int]] = []
    items: set = set()
    for end, (length, words, ids) in a.iter(t):
        ends.append((end, words))
        items.update(ids)
    if not ends:
        return n_words, [], items
    gaps = np.flatnonzero(np.frombuffer(t.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(gaps, np.array([e for e, _ in ends]))  # words before the closing space
    ranges: list[list[int]] = []
    for s, e in sorted(zip((last - np.array([w for _, w in ends])).tolist(), last.tolist(), strict=True)):
        if ranges and s <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], e)
        else:
            ranges.append([s, e])
    return n_words, [tuple(r) for r in ranges], items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point ranges of word ranges in the original text."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(text.translate(_ASCII_LOWER))]
    return [(at[s][0], at[e - 1][1]) for s, e in ranges]


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


SPANS = pa.list_(pa.list_(pa.int64()))
NAMES = ("n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated")
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), SPANS, pa.bool_())


def _shards(benchmark: DataFrame, limit: int):
    """Item lists of at most ``limit`` characters each (a longer single item makes one alone)."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text")).where("text is not null").toLocalIterator():
        if part and size + len(r[1]) > limit:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    yield part


def _scanner(spark: SparkSession, items: list[tuple], n: int):
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def build():
        if key not in _built:
            _built.clear()
            _built[key] = automaton(sent.value, n)
        return _built[key]

    return build


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: list[str] | None = None, shard_chars: int = 1_000_000, names: tuple = NAMES) -> DataFrame:
    """``docs[keep]`` with n_words, n_hit, n_items, item_ids, spans (original offsets), contaminated, under the names given."""
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    shards = list_or_two(_shards(benchmark, shard_chars))
    if len(shards) == 1:
        build = _scanner(spark, shards[0], n)

        def run(texts):
            a, out = build(), []
            for t in texts:
                t = t.as_py()
                nw, ranges, items = scan(a, t)
                out.append((nw, sum(e - s for s, e in ranges), len(items), sorted(items), [list(x) for x in original_spans(t, ranges)], bool(ranges)))
            return list(zip(*out, strict=True))

        return map_text(docs, run, dict(zip(names, TYPES, strict=True)), keep)
    # a large benchmark: every shard marks words of distinct texts, and the marks are united
    fa, fb, ranges, items, pack = unused(docs, 5, *names)
    whole = F.coalesce(F.col("text"), F.lit(""))
    fp = [F.xxhash64(whole).alias(fa), F.xxhash64(whole, F.lit(1)).alias(fb)]
    base = docs.select(*fp, whole.alias("text"))
    marks = None
    for part in _shards(benchmark, shard_chars):
        build = _scanner(spark, part, n)

        def run(texts, build=build):
            a = build()
            got = [scan(a, t.as_py()) for t in texts]
            return [[[list(r) for r in g[1]] for g in got], [sorted(g[2]) for g in got]]

        one = map_text(base, run, {ranges: SPANS, items: pa.list_(pa.string())}, [fa, fb]).where(F.size(ranges) > 0).dropDuplicates([fa, fb])
        marks = one if marks is None else marks.unionByName(one)
    marks = marks.groupBy(fa, fb).agg(F.flatten(F.collect_list(ranges)).alias(ranges), F.array_distinct(F.flatten(F.collect_list(items))).alias(items))
    joined = docs.withColumns({fa: F.xxhash64(whole), fb: F.xxhash64(whole, F.lit(1))}).join(marks, [fa, fb], "left")
    packed = joined.withColumn(pack, F.to_json(F.struct(F.col("text").alias("text"), F.col(ranges).alias("ranges"), F.col(items).alias("items"))))

    def merge(rows):
        import json

        out = []
        for r in rows:
            x = json.loads(r.as_py())
            t, ranges = x.get("text") or "", []
            for s, e in sorted(map(tuple, x.get("ranges") or [])):
                if ranges and s <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(e, ranges[-1][1]))
                else:
                    ranges.append((s, e))
            ids = sorted(x.get("items") or [])
            out.append((max(0, _pad(t).count(" ") - 1), sum(e - s for s, e in ranges), len(ids), ids, [list(y) for y in original_spans(t, ranges)], bool(ranges)))
        return list(zip(*out, strict=True))

    return map_text(packed, merge, dict(zip(names, TYPES, strict=True)), keep, text=pack)


def list_or_two(shards) -> list:
    """The first shard, and the second if there is one, without holding all."""
    out = []
    for s in shards:
        out.append(s)
        if len(out) == 2:
            break
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
with b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
bi as (select item_id, w, least(len(w), 10) as n, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win from bi),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
di as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from bw) where len(w) >= n),
hit as (select distinct doc_id, i, n, item_id from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from di) join bw using (n, win)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from (select distinct doc_id, i, n from hit)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from hit where item_id is not null) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
