"""MinHash near-dedup by Order MinHash, verified by banded alignment.

The elements of a text are its shingles of five words, labelled with their occurrence
number.  One sketch takes the two labelled shingles of least hash and keeps them in text
order; ``rows`` sketches make a band, and equal bands make two texts candidates.  The
exact check aligns the two shingle sequences in order (words of 32 bits, 160 a shingle):
with m shingles aligned of a and b, the similarity is m / (a + b - m), and from ``SIM`` =
0.8 two texts are near copies.  Classes are the connected components of near copies; exact
copies (equal words) share a class from the start.  At 0.8 a pair escapes all bands with
probability under 1e-5.

Candidates of a bucket are not all paired as rows.  First each member meets its bucket's
leader, the first by one of ``LEADERS`` orders of ids, and links at 0.8 or more give
components.  Buckets in which components still differ are then compared whole inside a task,
if they have ``BLOCK`` members or fewer: shared labelled shingles bound the similarity, pairs
that reach 0.8 by that bound and differ in component are aligned, and only the links that
join components come out.  The members of larger ones that are mixed after that meet by
their rarest labelled shingles, as many of each text as make two texts at 0.8 share one (a
prefix filter, so nothing is lost), again compared whole up to ``BLOCK`` members.  Where more
members hold a key and are in different components still, those outside the largest
component meet ``TURNS`` leaders of that component and as many of their own; up to here pairs
and rows grow linearly.  Keys of more than ``BLOCK`` members that are mixed even then are
compared whole, too, by pairs of parts of ``BLOCK`` / 2 members, without pairs of parts that
are in one component, and keys with the same members once; that is the square of such a
group, over ``BLOCK``, in rows.  So nothing is missed but by the bands' 1e-5.

Defined cases: texts without words form exact classes by their characters; null or empty
texts are alone in their class; texts of fewer than five words have exact copies only;
a class is named by its least doc_id; rows that repeat a doc_id are versions of one document,
which is near to all that any version is near to, and give one row together; null ids take
no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..deploy import ship
from ..storage import kept, released
from .textops import Words, map_text, mix, read, shingles, slices

K, SIM, ELL = 5, 0.8, 2
BANDS, ROWS = 24, 2
BLOCK, LEADERS, TURNS, PART, FREQUENT = 512, 4, 2, 200_000, 100_000
#: ids that are broadcast at most
SENT = 1_000_000
#: texts of a batch that hold a shingle which is counted at all
OFTEN = 8
#: links whose components one task finds
ALONE = 2_000_000
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes with the occurrence number mixed in."""
    if len(s) < 2:
        return s
    o = np.argsort(s, kind="stable")
    x = s[o]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    if new.all():
        return s
    at = np.arange(len(s))
    n = np.empty(len(s), np.uint64)
    n[o] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(n > 0, mix(s + n * np.uint64(0x9E3779B97F4A7C15)), s)


def bands(s: np.ndarray) -> np.ndarray:
    """Band keys of a text's shingles."""
    e = labelled(s)
    if not len(e):
        return np.zeros(0, np.int64)
    rows = np.arange(len(_SEEDS))
    if len(e) == 1:
        sketch = mix(_SEEDS * e[0])
    else:
        best = None
        step = 1 << 16
        for at in range(0, len(e), step):
            part = e[at : at + step]
            h = part[None] * _SEEDS[:, None]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            got = []
            for _ in range(min(ELL, len(part))):
                i = h.argmin(1)
                got.append((h[rows, i].copy(), i + at))
                h[rows, i] = np.iinfo(np.uint64).max
            v, i = np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)
            if best is not None:
                v, i = np.concatenate([best[0], v], 1), np.concatenate([best[1], i], 1)
            o = np.argsort(v, axis=1, kind="stable")[:, :ELL]
            best = np.take_along_axis(v, o, 1), np.take_along_axis(i, o, 1)
        order = np.sort(best[1], axis=1)
        sketch = mix(e[order[:, 0]] * np.uint64(3) + mix(e[order[:, 1]]))
    b = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        b = mix(b + sketch.reshape(BANDS, ROWS)[:, r])
    return mix(b + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Similarity of two shingle sequences by an alignment within the band that ``least`` allows; 0 if surely under."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    d = int((n + m) * (1 - least) / (1 + least) + 1e-9)  # insertions and deletions that are left
    if abs(n - m) > d:
        return 0.0
    k = min(n, m)
    diff = np.flatnonzero(a[:k] != b[:k])
    pre = int(diff[0]) if len(diff) else k
    tail = np.flatnonzero(a[n - k + pre :][::-1] != b[m - k + pre :][::-1]) if k > pre else np.zeros(0, int)
    post = (int(tail[0]) if len(tail) else k - pre) if k > pre else 0
    x, y = a[pre : n - post].tolist(), b[pre : m - post].tolist()
    most = pre + post + ((Counter(x) & Counter(y)).total() if x and y else 0)
    if most < least * (n + m - most):
        return 0.0
    common = pre + post + _lcs(x, y, d)
    return common / (n + m - common)


def _lcs(x: list, y: list, band: int) -> int:
    """Longest common subsequence by bit-parallel rows; matches further than ``band`` off the diagonal are masked."""
    if not x or not y:
        return 0
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | (1 << j)
    full = (1 << len(y)) - 1
    strip = (1 << (2 * band + 1)) - 1
    v = full
    for i, c in enumerate(x):
        hit = where.get(c)
        if hit is None:
            continue
        hit &= strip << (i - band) if i >= band else strip >> (band - i)
        u = v & hit
        v = ((v + u) | (v - u)) & full
    return len(y) - v.bit_count()


def sketches(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, f1, f2 (print of the words, null without text), b (band keys)."""

    def run(texts):
        f1, f2, out = [], [], []
        for first, data, off in slices(texts):
            w = Words(data, off)
            for i in range(len(off) - 1):
                h = w.hashes[w.rows[i] : w.rows[i + 1]]
                if len(h):
                    x = np.bitwise_xor.reduce(mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    y = np.add.reduce(mix(mix(h) + np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))
                elif off[i + 1] > off[i]:
                    raw = data[off[i] : off[i + 1]].astype(np.uint64)
                    x = np.bitwise_xor.reduce(mix(raw + np.arange(1, len(raw) + 1, dtype=np.uint64) * np.uint64(512)))
                    y = np.add.reduce(mix(raw * np.uint64(7) + np.arange(1, len(raw) + 1, dtype=np.uint64) * np.uint64(4096)))
                else:
                    f1.append(None)
                    f2.append(None)
                    out.append([])
                    continue
                f1.append(int(np.uint64(x).view(np.int64)))
                f2.append(int(np.uint64(y).view(np.int64)))
                out.append(bands(shingles(h, K)))
        return [f1, f2, out]

    return map_text(docs.where("doc_id is not null"), run, {"f1": pa.int64(), "f2": pa.int64(), "b": pa.list_(pa.int64())}, ["doc_id"])


def word_bytes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, w: the words, 32 bits each, of the documents named by ``ids`` (doc_id); one row a version.

    Up to ``SENT`` ids are broadcast, so that no text moves; for more, all texts do.
    """
    ids = kept(ids.distinct())
    ids = F.broadcast(ids) if ids.count() <= SENT else ids

    def cut(texts):
        out = []
        for _, data, off in slices(texts):
            w = Words(data, off)
            h = (w.hashes >> np.uint64(32)).astype(np.uint32)
            out += [h[w.rows[i] : w.rows[i + 1]].tobytes() for i in range(len(off) - 1)]
        return [out]

    return map_text(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), cut, {"w": pa.binary()}, ["doc_id"])


def word_shingles(w: bytes) -> np.ndarray:
    return shingles(np.frombuffer(w, np.uint32).astype(np.uint64), K)


def near_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of which any versions reach SIM."""
    pairs = kept(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b")))
    own = word_bytes(docs, ids)
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("w").alias("wa")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("w").alias("wb")), "b")

    def run(batches):
        for t in batches:
            ok = [aligned(word_shingles(x), word_shingles(y), SIM) >= SIM for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long").distinct()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of the links (a, b) and the least id of the component of each: roots hook to smaller ones, half of them at least in each round."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    up = np.arange(len(ids))
    while True:
        x, y = up[x], up[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        if not len(x):
            return ids, ids[up]
        np.minimum.at(up, y, x)
        while not np.array_equal(more := up[up], up):
            up = more


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """id, comp: the least id of each connected component of (a, b).

    Up to ``alone`` links are one task's work (two jobs, so the driver keeps few plans and
    tasks); more take minimum labels with pointer jumps.  Tables are kept in as many partitions
    as their rows need (``PART`` rows each), so that few links do not become many small files.
    """
    links = kept(edges.select("a", "b").distinct())
    n = links.count()
    if n <= alone:
        ship(edges.sparkSession)

        def run(batches):
            got = [b for b in batches if b.num_rows]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in roots(*(np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1)))], names=["id", "comp"])

        return kept(links.coalesce(1).mapInArrow(run, "id long, comp long"))
    both = kept(links.union(links.select("b", "a")).distinct())
    parts = max(1, min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * n // PART)))
    both = both.coalesce(parts)
    comp = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), parts)
    while True:
        near = both.join(comp.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = comp.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("c"))
        jump = comp.select(F.col("id").alias("c"), F.col("comp").alias("up"))
        new = kept(step.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("up", "c")).alias("comp")), parts)
        changed = new.where("was <> comp").limit(1).count()
        comp = new.select("id", "comp")
        if not changed:
            return comp


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """id, comp after further links (a, b): components of the components that these join, so the work is that of the new links."""
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    all_ = kept(comp.unionByName(ends.join(comp, "id", "left_anti").select("id", F.col("id").alias("comp"))))
    side = lambda who: all_.select(F.col("id").alias(who), F.col("comp").alias(f"c{who}"))
    joins = links.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    up = components(kept(joins)).select(F.col("id").alias("comp"), F.col("comp").alias("up"))
    return kept(all_.join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")))


def bucket_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b: links between different components inside each bucket; rows: bk, id, comp, a task holds one bucket."""
    own = word_bytes(docs, rows.select(F.col("id").alias("doc_id"))).withColumnRenamed("doc_id", "id")

    def link(t: pa.Table) -> pa.Table:
        ids, comp = t["id"].to_pylist(), t["comp"].to_pylist()
        texts = [word_shingles(x) for x in t["w"].to_pylist()]
        marks = [labelled(x) for x in texts]
        sizes = np.array([len(x) for x in marks])
        up = {c: c for c in comp}

        def root(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        flat, who = np.concatenate(marks), np.repeat(np.arange(len(marks)), sizes)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[code] > 1
        code, who = code[shared], who[shared]
        out_a, out_b = [], []
        if len(code):
            common = np.zeros((len(marks), len(marks)), np.float32)
            _, code = np.unique(code, return_inverse=True)
            order = np.argsort(code, kind="stable")
            code, who = code[order], who[order]
            for at in range(0, int(code[-1]) + 1, 2048):
                s = slice(int(np.searchsorted(code, at)), int(np.searchsorted(code, at + 2048)))
                m = np.zeros((len(marks), 2048), np.float32)
                m[who[s], code[s] - at] = 1
                common += m @ m.T
            bound = common / np.maximum(sizes[:, None] + sizes[None] - common, 1)
            for x, y in zip(*np.nonzero(np.triu(bound >= SIM - 1e-6, 1)), strict=True):
                rx, ry = root(comp[x]), root(comp[y])
                if rx == ry:
                    continue
                if aligned(texts[x], texts[y], SIM) >= SIM:
                    up[rx] = ry
                    out_a.append(min(ids[x], ids[y]))
                    out_b.append(max(ids[x], ids[y]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.join(own, "id").groupBy("bk").applyInArrow(link, "a long, b long").distinct()


def star(rows: DataFrame) -> DataFrame:
    """a, b: each member of a bucket with its leader, the first by one of ``LEADERS`` orders of ids, so that a large group meets a few leaders, not one for each band."""
    lead = rows.groupBy("bk").agg(F.min_by("id", F.xxhash64("id", F.pmod("bk", F.lit(LEADERS)))).alias("lead"))
    return rows.join(lead, "bk").where("id <> lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()


def mixed(rows: DataFrame) -> DataFrame:
    """bk, n of buckets in which components differ and not all have met their leader; rows: bk, id, comp."""
    return rows.groupBy("bk").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("n > 2 and lo <> hi").select("bk", "n")


def mixed_once(rows: DataFrame) -> DataFrame:
    """bk, id, comp, n: the rows of buckets in which components differ, one bucket of those with the same members; rows: bk, id, comp."""
    ids = [F.bit_xor(F.xxhash64("id")).alias("p"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("q")]
    own = rows.groupBy("bk").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *ids).where("lo <> hi")
    return rows.join(own.groupBy("n", "p", "q").agg(F.min("bk").alias("bk")).select("bk", "n"), "bk")


def mixed_keys(rows: DataFrame) -> DataFrame:
    """id, comp, bk: the rows of keys that texts of different components hold, each once; rows: id, comp, bk.

    Most keys are of one text or component, so all rows move once, 24 bytes each, and a task
    streams over its sorted keys; it holds one key's rows.
    """

    def of_whole(x):
        new = np.concatenate([[True], x[2, 1:] != x[2, :-1]])
        first = np.flatnonzero(new)
        keep = (np.minimum.reduceat(x[1], first) != np.maximum.reduceat(x[1], first))[np.cumsum(new) - 1]
        keep[1:] &= (x[:, 1:] != x[:, :-1]).any(0)
        return pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in x], names=["id", "comp", "bk"])

    def run(batches):
        held = [np.zeros((3, 0), np.int64)]
        for b in batches:
            x = np.stack([b.column(i).to_numpy() for i in range(3)])
            if not x.shape[1]:
                continue
            cut = int((x[2] == x[2, -1]).argmax())  # where the last key begins
            if held[0].shape[1] and held[0][2, 0] == x[2, -1]:
                held.append(x)
                continue
            if (whole := np.concatenate([*held, x[:, :cut]], axis=1)).shape[1]:
                yield of_whole(whole)
            held = [x[:, cut:]]
        if held[0].shape[1]:
            yield of_whole(np.concatenate(held, axis=1))

    ship(rows.sparkSession)
    return rows.select("id", "comp", "bk").repartition("bk").sortWithinPartitions("bk", "id", "comp").mapInArrow(run, "id long, comp long, bk long")


def _with_comp(df: DataFrame, comp: DataFrame, who: str, out: str) -> DataFrame:
    """The component of a text, itself where it has no link."""
    return df.join(comp.select(F.col("id").alias(who), F.col("comp").alias(out)), who, "left").withColumn(out, F.coalesce(out, who))


def rare_keys(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, comp, bk: the first labelled shingles of each text in one order for all, as many as make it share one with every text at SIM (prefix filter: n - ceil(SIM n) + 1 of n).

    Frequent shingles come last.  The filter is exact in any order, so it is enough to know
    ``FREQUENT`` of those that stand out in some batch of texts, which are broadcast; nothing is joined
    to the keys, and components (ids: id, comp) go along with the texts.
    """
    own = kept(word_bytes(docs, ids.select(F.col("id").alias("doc_id"))).withColumnRenamed("doc_id", "id").join(ids, "id").select("id", "w", "comp"))

    def count(batches):
        for b in batches:
            if b.num_rows:
                k, n = np.unique(np.concatenate([labelled(word_shingles(w)) for w in b.column(1).to_pylist()]), return_counts=True)
                k, n = k[n >= OFTEN], n[n >= OFTEN]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["bk", "n"])

    often = own.mapInArrow(count, "bk long, n long").groupBy("bk").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK // 2)
    often = often.orderBy(F.desc("n"), "bk").limit(FREQUENT).select("bk").toArrow()["bk"].to_numpy()  # FREQUENT rows at most
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(often))

    def keys(batches):
        for b in batches:
            if not b.num_rows:
                continue
            who, comp, out = [], [], []
            for i, w, c in zip(*[x.to_pylist() for x in b.columns], strict=True):
                x = labelled(word_shingles(w)).view(np.int64)
                n = len(x) - int(np.ceil(SIM * len(x) - 1e-9)) + 1 if len(x) else 0
                out.append(x[np.lexsort((x, np.isin(x, sent.value)))[:n]])
                who.append(np.full(len(out[-1]), i, np.int64))
                comp.append(np.full(len(out[-1]), c, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (who, comp, out)], names=["id", "comp", "bk"])

    return own.mapInArrow(keys, "id long, comp long, bk long")


def led(rows: DataFrame, turn: int) -> DataFrame:
    """a, b: in each bucket the members outside its largest component with a leader of that component, and with one of their own.  Leaders change with the turn and the bucket."""
    order = F.xxhash64("id", "bk", F.lit(turn))
    comps = rows.groupBy("bk", "comp").agg(F.count("*").alias("n"), F.min_by("id", order).alias("lead"))
    top = comps.groupBy("bk").agg(F.max(F.struct("n", "comp", "lead")).alias("top"))
    rest = rows.join(top, "bk").where(F.col("comp") != F.col("top.comp"))
    own = rest.groupBy("bk").agg(F.min_by(F.struct("id", "comp"), order).alias("own"))
    pair = lambda df, lead: df.select(F.least(lead, "id").alias("a"), F.greatest(lead, "id").alias("b"))
    return pair(rest, F.col("top.lead")).unionByName(pair(rest.join(own, "bk").where(F.col("comp") != F.col("own.comp")), F.col("own.id"))).distinct()


def in_parts(rows: DataFrame, block: int) -> DataFrame:
    """bk, id, comp: buckets of any size as buckets of up to ``block`` members in which any two members of different components meet; rows: bk, id, comp.

    The members, by component, are cut into parts of half a block, and each two parts that are
    not in one component make a bucket.  Of buckets with the same members one is cut.
    """
    at = F.row_number().over(Window.partitionBy("bk").orderBy("comp", "id")) - 1
    cut = kept(mixed_once(rows).withColumn("part", F.floor(at / max(1, block // 2))))
    parts = cut.groupBy("bk", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    other = parts.select("bk", F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    two = parts.join(other, "bk").where("part <= part2 and least(lo, lo2) <> greatest(hi, hi2)")
    two = two.select("bk", F.xxhash64("bk", "part", "part2").alias("own"), F.explode(F.array_distinct(F.array("part", "part2"))).alias("part"))
    return two.join(cut, ["bk", "part"]).select(F.col("own").alias("bk"), "id", "comp")


def near_classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (least doc_id of the class)."""
    sk = kept(sketches(docs).select("doc_id", "f1", "f2", "b"))
    exact = kept(sk.where("f1 is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    reps = sk.select("doc_id", "b").where("size(b) > 0").join(exact.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    keys = reps.select(F.col("doc_id").alias("id"), F.explode("b").alias("bk")).distinct()
    shared = keys.groupBy("bk").agg(F.count("*").alias("n")).where("n > 1").select("bk")
    rows = kept(keys.join(shared, "bk"))
    # the versions of a document belong together
    named = sk.where("f1 is not null").select("doc_id", "f1", "f2").distinct().join(exact, ["f1", "f2"]).select("doc_id", "rep").distinct()
    many = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    versions = many.join(named, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    first = kept(near_pairs(docs, star(rows)).unionByName(versions).distinct())
    released(docs.sparkSession)
    final = components(first)
    open_ = _with_comp(rows, final, "id", "comp").select("bk", "id", "comp")
    small = open_.join(mixed(open_).where(F.col("n") <= block).select("bk"), "bk")
    final = merged(final, kept(bucket_links(docs, small)))
    released(docs.sparkSession)
    open_ = _with_comp(rows, final, "id", "comp").select("bk", "id", "comp")
    hot = kept(open_.join(mixed(open_).where(F.col("n") > block).select("bk"), "bk").select("id", "comp").distinct())
    if hot.limit(1).count():  # members of large buckets that are mixed still meet by rare shingles
        rare = kept(mixed_once(kept(mixed_keys(rare_keys(docs, hot)))))
        final = merged(final, kept(bucket_links(docs, rare.where(F.col("n") <= block).select("bk", "id", "comp"))))
        released(docs.sparkSession)
        own = _with_comp(rare.where(F.col("n") > block).select("bk", "id"), final, "id", "comp").select("bk", "id", "comp")
        own = kept(own.join(mixed(own).select("bk"), "bk"))
        if own.limit(1).count():  # what no key splits
            pairs = led(own, 1)
            for turn in range(2, TURNS + 1):
                pairs = pairs.unionByName(led(own, turn))
            final = merged(final, kept(near_pairs(docs, kept(pairs.distinct()))))
            left = _with_comp(own.select("bk", "id"), final, "id", "comp").select("bk", "id", "comp")
            left = kept(in_parts(left, block))
            if left.limit(1).count():  # nor any leader
                final = merged(final, kept(bucket_links(docs, left)))
        released(docs.sparkSession)
    named = kept(exact.join(final.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("f1", "f2", F.coalesce("comp", "rep").alias("class_id")))
    out = sk.where("f1 is not null").select("doc_id", "f1", "f2").join(named, ["f1", "f2"]).select("doc_id", "class_id")
    alone = sk.where("f1 is null").select("doc_id").distinct().join(out.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"))
    return out.distinct().unionByName(alone)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
