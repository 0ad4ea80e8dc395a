"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; and brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

pytest.importorskip("chronoweave.llm")
from chronoweave.llm import decontaminate, langid, licenses, linededup, mixing, ordermh, passages, permindex, pii, toxicity  # noqa: E402
from chronoweave.llm.textops import Words, large  # noqa: E402

import pyarrow as pa  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, n_words long, t1 long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return WORD.findall(lower(t))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 30_000)
    texts = [None, "", "\n\n", "!!!", "Été à 7 h", "x", long, long, prose(2, 80), prose(2, 80), prose(2, 79) + " other"]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", len(t or ""), 9.0, "clash", -1, 5) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "null id text", "en", "s", 3, 1.0, "c", 2, 1)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_words_of_a_slice():
    t = pa.array(["Ab c", "", "Ünï x1", "tail"])
    from chronoweave.llm.textops import slices

    ((_, data, off),) = slices(large(t))
    w = Words(data, off)
    assert np.diff(w.rows).tolist() == [2, 0, 2, 1]
    ((_, d2, o2),) = slices(large(pa.array(["aB C"])))
    assert Words(d2, o2).hashes.tolist() == w.hashes[:2].tolist()


def test_odd_rows_do_not_crash(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (4, 0), (8, 1), (9, None), (10, 0), (None, 1), (8, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([("b", prose(2, 30)), ("b", prose(2, 30)), (None, "x"), ("n", None), ("e", "")], "item_id string, text string")
    for docs, n in ((odd, 13), (none, 0)):
        langs, table = langid.learn(docs)
        assert langid.identify(docs, langs, table, ["doc_id"]).count() == n
        assert toxicity.score(docs, toxicity.train(docs, labels), ["doc_id", "score", "lang"]).count() == n
        assert pii.find(docs, pii.train(docs), ["doc_id"]).count() == n
        assert decontaminate.decontaminate(docs, bench, keep=docs.columns).count() == n
        assert linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, 2)).count() == n
        assert mixing.mix(docs).count() == n
        assert licenses.scan(docs.selectExpr("doc_id as key", "text as path", "text")).count() == n
        ordermh.near_classes(docs).count()
        passages.repeated_passages(docs).count()
    for table in (bench, bench.limit(0)):
        assert decontaminate.decontaminate(odd, table).count() == 13


def test_language_needs_a_letter(spark):
    d = spark.createDataFrame([(1, "the house and the tree and the sea", "en"), (2, "la maison et le chat et la mer", "fr"), (3, None, None), (4, "12 + 3 …", "en"), (5, "the tree", None)], "doc_id long, text string, lang string")
    langs, table = langid.learn(d)
    got = {r["doc_id"]: r for r in langid.identify(d, langs, table, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "fr", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_languages_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = langid.op2_language_mixture(spark, sf).join(docs, "doc_id").where("held_out").selectExpr("avg(int(lang = lang_pred)) a").first()[0]
    assert r > 0.97
    sf = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.op5_toxicity(spark, sf).join(lab, "doc_id").where("held_out").selectExpr("avg(int(toxic = predicted)) a", "avg(if(toxic = 1, predicted, null)) b", "min(score) c", "max(score) d").first()
    assert r["a"] > 0.97 and r["b"] > 0.85 and 0 <= r["c"] <= r["d"] <= 1


def test_language_sets_by_brute_force():
    """All subsets, EM to convergence, in plain loops; and the mixture of a text of known parts."""
    rng = np.random.default_rng(2)
    alphabets = ["abcde", "fghij", "cdfgk", "lmnop", "aflpq"]
    table = np.full((1 << langid.BITS, 5), np.log(1e-7), np.float32)

    def text(lang, n):
        return " ".join("".join(rng.choice(list(alphabets[lang]), 5)) for _ in range(n))

    def view(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return raw, np.array([0, len(raw)])

    for lang in range(5):
        k, n = np.unique(langid.buckets(view(text(lang, 20_000))[0]), return_counts=True)
        table[k, lang] = np.log(n / n.sum())
    for parts in ([(0, 40)], [(0, 30), (3, 30)], [(1, 50), (2, 10)], [(0, 20), (1, 20), (3, 20)], [(0, 15), (1, 15), (3, 15), (4, 15)], [(4, 6)]):
        data, off = view(" ".join(text(l, n) for l, n in parts))
        ll, _ = langid.likelihoods(table, data, off)
        like, n = np.exp(ll.astype(float)), len(ll)
        values = {}
        for size in range(1, 6):
            for own in itertools.combinations(range(5), size):
                pi = np.zeros(5)
                pi[list(own)] = 1 / size
                for _ in range(3000):
                    r = like * pi
                    pi = (r / np.maximum(r.sum(1, keepdims=True), 1e-300)).mean(0)
                values[own] = (np.log(np.maximum(like @ pi, 1e-300)).sum() - 0.5 * size * np.log(n), pi)
        want = max(values, key=lambda k: values[k][0])
        assert set(want) == {l for l, _ in parts}
        for every in (False, True):
            pi, keep = langid.infer(table, data, off, rounds=200, every=every)
            assert tuple(np.flatnonzero(keep[0])) == want and np.abs(pi[0] - values[want][1]).max() < 0.02
        assert all(abs(pi[0, l] - m / n) < 0.1 for l, m in parts)


def test_classifier_by_naive_loops():
    """The pooled convolutions, and the gradients by finite differences."""
    rng = np.random.default_rng(0)
    p = {"E": rng.normal(0, 0.5, (1 << toxicity.WORD_BITS, toxicity.DIM)), "P": rng.normal(0, 0.5, (1 << toxicity.PREFIX_BITS, toxicity.DIM)), "c": 0.3, "o": rng.normal(0, 1, toxicity.FILTERS * 3)}
    for k in toxicity.WIDTHS:
        p[f"W{k}"], p[f"b{k}"] = rng.normal(0, 0.5, (k, toxicity.DIM, toxicity.FILTERS)), rng.normal(0, 0.2, toxicity.FILTERS)
    lens = [0, 1, 2, 7, 30]
    A, B = [rng.integers(0, 50, n).astype(np.uint16) for n in lens], [rng.integers(0, 50, n).astype(np.uint16) for n in lens]
    off = np.concatenate([[0], np.cumsum(lens)])
    got = toxicity.forward(p, np.concatenate(A), np.concatenate(B), off)
    for i, n in enumerate(lens):
        x = p["E"][A[i]] + p["P"][B[i]]
        want = []
        for k in toxicity.WIDTHS:
            r = [sum(x[s + j] @ p[f"W{k}"][j] for j in range(k)) + p[f"b{k}"] for s in range(n - k + 1)]
            want.append(np.maximum(np.max(r, axis=0), 0) if r else np.zeros(toxicity.FILTERS))
        assert np.allclose(got[i], np.concatenate(want))
    y, weight = np.array([0, 1, 0, 1, 1.0]), 2.0
    loss = lambda: float((np.where(y > 0, weight, 1) * (np.logaddexp(0, z := toxicity.logits(p, np.concatenate(A), np.concatenate(B), off)) - y * z)).mean())
    g, touched = toxicity._gradients(p, A, B, y, weight)
    for k in ("o", "W1", "W2", "W3", "b2", "E", "P"):
        own = p[k]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in (g[k].shape))
            where = (touched[k][at[0]], *at[1:]) if k in touched else at
            was, h = own[where], 1e-5
            own[where] = was + h
            up = loss()
            own[where] = was - h
            down = loss()
            own[where] = was
            assert abs((up - down) / (2 * h) - g[k][at]) < 1e-4, (k, at)


def test_thresholds_by_language():
    """Two languages with their own cut: the calibrated thresholds lie between the classes of each, near the common one for few rows."""
    n = 400
    word = lambda lang, y, i: np.array([10 + lang, 20 + lang, 100 + lang * 2 + y], np.uint16)
    data = [(i, (y := i % 3 == 0) * 1, "ab"[i % 2], word(i % 2, int(y), i).tobytes(), word(i % 2, int(y), i).tobytes()) for i in range(n)]
    m = toxicity.fit(data)
    for lang in range(2):
        z = [toxicity.logits(m, word(lang, y, 0), word(lang, y, 0), np.array([0, 3]))[0] for y in (0, 1)]
        assert toxicity.guess(m, word(lang, 0, 0), np.array([0, 3]))[0] == lang and z[0] < m["t"][lang] < z[1]
    assert toxicity.fit([d for d in data if d[1]]) is None


def test_decontamination_by_brute_force(spark):
    base = [prose(i, 40) for i in range(6)]
    items = [("a", base[0]), ("b", "One two three"), ("c", base[1]), ("a2", base[0]), ("d", "il va à la mer à pied où l’été est Ã… là")]
    texts = [base[2] + ", " + base[0][5:120] + "; " + base[3], "so ONE two-three four", base[4], None, base[1].upper(), "et il va À il va à la mer à pied où l’été est Ã… là!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for limit in (10**6, 30):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, shard_chars=limit).collect()}
        for i, t in enumerate(texts):
            w, hit, ids = words(t), set(), set()
            for k, x in items:
                x = words(x)
                n = min(10, len(x))
                for s in range(len(x) - n + 1):
                    for p in range(len(w) - n + 1):
                        if w[p : p + n] == x[s : s + n]:
                            hit |= set(range(p, p + n))
                            ids.add(k)
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(ids))
            marked = {j for s, e in r["spans"] for j, m in enumerate(WORD.finditer(lower(t))) if s <= m.start() and m.end() <= e}
            assert marked == hit


def test_line_dedup_keep_first(spark):
    docs = spark.createDataFrame([(1, "A\n b\nA"), (2, "a\nc"), (3, None), (2, "a\nc"), (None, "c"), (None, "C \nz")], "doc_id long, text string")
    one = docs.where("text <> 'C \\nz' or text is null")
    out = linededup.apply_bitmaps(one, linededup.keep_bitmaps(one, 2, keep_first=True))
    got = sorted((str(r["doc_id"]), r["kept"], r["n_dropped"]) for r in out.collect())
    assert got == [("1", "A\n b", 1), ("2", "", 2), ("2", "", 2), ("3", "", 0), ("None", "c", 0)]
    # versions of one document and null ids count once
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, 3))
    assert sorted((str(r["doc_id"]), r["kept"]) for r in out.collect()) == [("1", "A\n b\nA"), ("2", "a\nc"), ("2", "a\nc"), ("3", ""), ("None", "C \nz"), ("None", "c")]
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, 2))
    assert sorted((str(r["doc_id"]), r["kept"], r["n_lines"]) for r in out.collect()) == [("1", " b", 3), ("2", "", 2), ("2", "", 2), ("3", "", 1), ("None", "", 1), ("None", "z", 2)]
    assert linededup.apply_bitmaps(docs.limit(0), linededup.keep_bitmaps(docs.limit(0), 2)).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    """100,000 lines that stay and go in turn, among ten short documents."""
    import time

    long = "\n".join(f"own {i}" if i % 2 else f"common {i % 500}" for i in range(100_000))
    common = "\n".join(f"Common {i}" for i in range(0, 500, 2))
    docs = spark.createDataFrame([(0, long)] + [(i, common) for i in range(1, 11)], "doc_id long, text string")
    at = time.time()
    got = {r["doc_id"]: r for r in linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, 10)).collect()}
    assert time.time() - at < 60
    assert got[0]["n_dropped"] == 50_000 and got[0]["kept"] == "\n".join(f"own {i}" for i in range(1, 100_000, 2)) and got[3]["kept"] == "" and got[3]["n_dropped"] == 250


def test_line_dedup_passes_any_column_on(spark):
    names = ["keep", "t", "doc", "kept", "n_dropped", "n_lines", "__x0", "__X1", "pos", "h1", "ls"]
    docs = spark.createDataFrame([(1, "a\nb", *names), (2, "a", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, 2), "o1", "o2", "o3").orderBy("doc_id").collect()
    assert [r["o3"] for r in got] == ["b", ""] and all(r[n] == n for r in got for n in names)


def test_personal_data_by_brute_force(spark):
    r = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0142", "+", "+44 20 7946 0958", "word", "7", "00", ".", "é", "\n"]
    for _ in range(300):
        t = "".join(r.choice(parts) + r.choice(["", " ", "-"]) for _ in range(r.randint(0, 12)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
                want.append((m.start(), 2, m.end()))
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert pii.base_spans(t) == sorted(want)


@pytest.fixture(scope="module")
def field():
    r = random.Random(3)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(150):
        own = [f"{prose(i, 1)}.{d(2)}@mail{d(1)}.example.com", f"+1 ({d(3)}) 555-{d(4)}", f"4{d(2)}.{r.randint(1, 250)}.{r.randint(1, 250)}.7", "4111 1111 1111 1111".replace(" ", r.choice(["", " ", "-"])), f"{d(4)} of {d(2)}", d(r.randint(1, 9))]
        texts.append(" ".join(prose(100 * i + j, 6) + " " + x for j, x in enumerate(r.sample(own, 3))) + " " + prose(i, 20))
    return pii.learn(texts)


def test_skip_chain_finds_repeats(field):
    """Repeats that no pattern matches take the label of what they repeat; the same shapes alone stay unlabelled."""
    more = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.added_spans(t, pii.base_spans(t), field, 0.9)]
    assert more("write to bob.smith7@corp.example.com now, and then bob.smith7@corp again, in 19 of 20") == [("email", "bob.smith7@corp")]
    assert ("phone", "988-555-2485") in more("call us at +1 (988) 555-2485 or, as said before, at 988-555-2485 if you can") and more("if you can call us at 988-555-2485 or so") == []
    assert more("the card 4111 1111 1111 1111 was written 4111.1111.1111.1111 as well") == [("card", "4111.1111.1111.1111")]
    assert more("nothing here in 1999 of 20") == [] and pii.added_spans("", [], field, 0.9) == [] and pii.added_spans("a@b 7", [], None, 0.9) == []


def test_propagation_by_enumeration():
    rng = np.random.default_rng(1)

    def exact(u, a, b, kind, pair):
        n, out = len(u), np.zeros_like(u)
        for y in itertools.product(range(5), repeat=n):
            w = np.exp(sum(u[i, y[i]] for i in range(n)) + sum(pair[k, y[i], y[j]] for i, j, k in zip(a, b, kind, strict=True)))
            out[np.arange(n), list(y)] += w
        return out / out.sum(1, keepdims=True)

    trees = [([0, 1, 2], [1, 2, 3], [0, 0, 0]), ([0, 0, 0, 3], [1, 2, 3, 4], [1, 0, 1, 0])]
    for a, b, kind in trees:
        u, pair = rng.normal(0, 2, (max(b) + 1, 5)), rng.normal(0, 1, (2, 5, 5))
        got = pii.propagate(u, np.array(a), np.array(b), np.array(kind), pair, 300)
        assert np.allclose(got, exact(u, a, b, kind, pair), atol=1e-6)
    for _ in range(5):  # a loop: two neighbours repeated further on
        u, pair = rng.normal(0, 2, (4, 5)), rng.normal(0, 0.5, (2, 5, 5))
        a, b, kind = [0, 2, 0, 1], [1, 3, 2, 3], [0, 0, 1, 1]
        assert np.abs(pii.propagate(u, np.array(a), np.array(b), np.array(kind), pair, 300) - exact(u, a, b, kind, pair)).max() < 0.05


def test_spans_of_documents(spark, field):
    """The DataFrame operator by the functions it is made of, text by text; base spans are all kept."""
    texts = [None, "", "a@b.cd then a@b.cd", "call +1 (988) 555-2485 or 988-555-2485", "x " * 60_000 + "joe12@here.org and joe12@here", "7 7 7"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(docs, field, ["doc_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"]] or ""
        base = pii.base_spans(t)
        assert r["base_sha256"] == hashlib.sha256(pii.spans_text(base).encode()).hexdigest()
        assert r["spans"] == pii.spans_text(sorted({*base, *pii.added_spans(t, base, field, 0.9)}))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
    by = {r["doc_id"]: r["spans"] for r in got}
    assert by[0] == by[1] == by[5] == "" and by[2].count("email") == 2 and by[3] == "phone:5:22,phone:26:38" and by[4].count("email") == 2


def test_near_classes_by_brute_force(spark):
    r = random.Random(9)
    base = [prose(100 + i, 120).split() for i in range(6)]
    texts = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(99))
            texts.append(" ".join(w))
    texts += [texts[0].upper(), "one two", "One, two!", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sh = [np.array([hash(tuple(w[j : j + 5])) for j in range(len(w) - 4)], dtype=np.int64) for w in map(words, texts)]

    def lcs(x, y):
        d = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in itertools.product(range(len(x)), range(len(y))):
            d[i + 1, j + 1] = d[i, j] + 1 if x[i] == y[j] else max(d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    for a, b in itertools.combinations(range(len(texts)), 2):
        if words(texts[a]) and words(texts[a]) == words(texts[b]):
            up[root(b)] = root(a)
        elif len(sh[a]) and len(sh[b]) and len(set(sh[a]) & set(sh[b])) > 20:
            c = lcs(sh[a], sh[b])
            if c >= 0.8 * (len(sh[a]) + len(sh[b]) - c):
                up[root(b)] = root(a)
    want = {}
    for i in range(len(texts)):
        want.setdefault(root(i), []).append(i)
    for block in (512, 1):
        got = {}
        for x in ordermh.near_classes(docs, block=block).collect():
            got.setdefault(x["class_id"], []).append(x["doc_id"])
        assert sorted(map(sorted, got.values())) == sorted(want.values())


def test_near_classes_lose_no_link_of_large_buckets(spark):
    """Pairs at 0.80 among texts that are all at 0.79: they meet in large buckets, and their own shingles are held by two."""
    common = prose(300, 265)
    texts = [(2 * p + k, f"{common} {prose(400 + p, 3)} {prose(1000 + 2 * p + k, 32)}") for p in range(40) for k in (0, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (1, 512):
        got = {x["doc_id"]: x["class_id"] for x in ordermh.near_classes(docs, block=block).collect()}
        assert got == {i: i - i % 2 for i in range(80)}


def test_parts_of_buckets_hold_every_mixed_pair(spark):
    rows = [(bk, i, i // 3 if i < 12 else 99) for bk in (1, 2) for i in range(40)] + [(3, i, i) for i in range(4, 15)]
    got = ordermh.in_parts(spark.createDataFrame(rows, "bk long, id long, comp long"), 6).collect()
    held = {}
    for x in got:
        held.setdefault(x["bk"], []).append((x["id"], x["comp"]))
    assert all(len(v) <= 6 and len({c for _, c in v}) > 1 for v in held.values())
    pairs = {frozenset((x, y)) for v in held.values() for (x, c), (y, d) in itertools.combinations(v, 2) if c != d}
    want = [(i, j) for bk in (1, 3) for (b, i, c), (e, j, d) in itertools.combinations(rows, 2) if b == e == bk and c != d]
    assert {frozenset(p) for p in want} <= pairs


def test_components_alone_and_by_rounds(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges if e[0] != e[1]], "a long, b long")
    one, many = (sorted(tuple(x) for x in ordermh.components(df, alone=n).collect()) for n in (1000, 0))
    assert one == many and dict(one)[60] == 0
    assert ordermh.components(df.limit(0)).count() == 0


def test_versions_of_a_document_do_not_depend_on_partitions(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (2, a + " tail"), (2, b), (3, b), (4, None), (4, ""), (5, None), (5, "x y"), (6, "X, y"), (None, a), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 3, 4):
        got = sorted(tuple(r) for r in ordermh.near_classes(docs.repartition(n)).collect())
        assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)]
    assert ordermh.near_classes(docs.limit(0)).count() == 0


def test_aligned_is_exact():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(0, 6, 30), r.integers(0, 6, 28)
        b[:20] = a[:20]
        d = np.zeros((31, 29), int)
        for i, j in itertools.product(range(30), range(28)):
            d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        want = d[-1, -1] / (58 - d[-1, -1])
        assert ordermh.aligned(a, b) == want
        got = ordermh.aligned(a, b, 0.5)
        assert got == want or (want < 0.5 and got <= want)


def test_passages_across_documents(spark):
    p, q = prose(50, 70), prose(51, 60)
    w = p.split()
    w[30] = "changed"
    texts = [prose(60, 90) + " " + p + " " + prose(61, 40), prose(62, 20) + " " + " ".join(w) + " " + prose(63, 90), prose(64, 200), q, q + " " + prose(65, 10), prose(66, 30) + " " + p[: len(p) // 3]]
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["class_id"]))
    assert set(got) == {0, 1, 3, 4}
    assert got[3] == [(0, 60, 3)] and got[4] == [(0, 60, 3)]
    assert got[0][0][0] <= 95 and got[0][0][1] >= 155 and got[1][0][2] == 0


def test_compact_windows_cover_all_subsequences():
    rng = np.random.default_rng(3)
    h = np.concatenate([rng.permutation(40), rng.integers(1, 9, 30), rng.permutation(5)]).astype(np.uint64) + np.uint64(1)
    off = np.array([0, 40, 70, 75])
    nodes = list(zip(*(x.tolist() for x in passages.compact_windows(h, off, 8)), strict=True))
    for lo, hi in zip(off[:-1], off[1:], strict=True):
        for i in range(lo, hi):
            for j in range(i + 7, hi):
                c = i + int(h[i : j + 1].argmin())
                assert sum(l <= i and j <= r and at == c for l, at, r in nodes) == 1
    assert all(r - l >= 7 and (r < 40 or l >= 40) for l, _, r in nodes)


def test_passages_lose_no_link_to_sharers_of_parts(spark):
    """Two documents share 60 words of which others quote 10, 24, 30 or 45; only the two (and the quotes of 50) are found."""
    w = prose(7, 60).split()
    texts = {10: prose(11, 80) + " " + " ".join(w) + " " + prose(12, 80), 90: prose(13, 30) + " " + " ".join(w) + " " + prose(14, 100)}
    k = 11
    for n in (10, 24, 30, 45):
        for at in range(0, 60 - n + 1, 3):
            texts[k] = prose(100 + k, 70) + " " + " ".join(w[at : at + n]) + " " + prose(300 + k, 70)
            k += 1 if k != 89 else 2
    got = passages.repeated_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["class_id"]) for r in got) == [(10, 80, 140, 10), (90, 30, 90, 10)]


def test_passages_lose_no_near_copy_beside_a_frequent_run(spark):
    """Pairs at 0.81 whose only run of 20 shingles, 30 words, stands in 300 other texts; the rest of each is 22 words after an edit."""
    run = prose(20, 30)
    texts = {n: f"{prose(2000 + n, 60)} {run} {prose(3000 + n, 60)}" for n in range(300)}
    pairs = [(7 + 30 * i, 21 + 30 * i) for i in range(8)]
    for i, both in enumerate(pairs):
        for d in both:
            texts[d] = f"{prose(4000 + d, 60)} {run} edit{d} {prose(5000 + i, 22)} {prose(6000 + d, 60)}"
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = sorted(tuple(r) for r in passages.repeated_passages(docs).collect())
    assert got == sorted((d, 60, 113, a, 1) for a, b in pairs for d in (a, b))


def test_parts_of_a_group_lose_no_pair(spark, monkeypatch):
    """A group cut into parts by its size: all members of the parts are looked at again."""
    monkeypatch.setattr(passages, "GROUP", 1)
    monkeypatch.setattr(passages, "BLOCK", 4)
    test_passages_lose_no_near_copy_beside_a_frequent_run(spark)


def test_recall_of_passages(spark):
    """Exact and once or twice edited repeats in pairs; all that reach 0.8 by shingles in order are found."""
    r, texts, want = random.Random(5), [], set()
    for i in range(120):
        n = r.choice([50, 52, 55, 60, 80, 120])
        a = prose(5000 + i, n).split()
        b = list(a)
        for _ in range(0 if i % 3 == 0 else n // 50):
            at = r.randrange(n)
            if r.random() < 0.5:
                b[at] = f"new{at}"
            else:
                b.insert(at, f"more{at}")
        x = [tuple(a[j : j + 5]) for j in range(len(a) - 4)]
        y = [tuple(b[j : j + 5]) for j in range(len(b) - 4)]
        both = set(x) & set(y)  # a passage begins and ends with a common shingle
        px, py = ([j for j, v in enumerate(z) if v in both] for z in (x, y))
        x, y, m = x[px[0] : px[-1] + 1], y[py[0] : py[-1] + 1], len(both)
        texts += [prose(6000 + i, 40 + i % 7) + " " + " ".join(a) + " " + prose(6500 + i, 20), prose(9000 + i, i % 30) + " " + " ".join(b) + " " + prose(9500 + i, 60)]
        if min(len(x), len(y)) >= 46 and m / (len(x) + len(y) - m) >= 0.8:
            want |= {2 * i, 2 * i + 1}
    got = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(want) > 150 and want <= got


def test_copies_of_passages(spark):
    """Copies are one text: a class as a whole; versions of one doc_id, nulls and repeated rows are defined."""
    p = prose(40, 70)
    rows = [(1, p), (2, p.upper()), (2, p.upper()), (3, "x " + p + " y"), (4, None), (5, ""), (6, prose(41, 49)), (7, prose(41, 49)), (None, p), (3, prose(42, 60))]
    got = sorted(tuple(r) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 70, 1, 2), (2, 0, 70, 1, 2), (3, 1, 71, 1, 1)]
    assert passages.repeated_passages(spark.createDataFrame(rows[4:6], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("table", ["sf0.1", "check_h"])
def test_recall_of_the_permutation_index(spark, table):
    """Recall by score against brute force on 2,000 vectors, and on 10,256 of which many are equal."""
    sf = f"/root/testdata/{table}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    got = {}
    for r in permindex.op3_permutation_index(spark, sf).collect():
        got.setdefault(r["query_id"], []).append(r)
    t = rows.toArrow()
    ids = t["vec_id"].to_numpy()
    x = permindex.unit(np.array(t["embedding"].to_pylist(), float))
    hit = total = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        least = np.sort(s)[-5]
        hit += sum(r["score"] >= least - 1e-12 for r in found)
        total += 5
        assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        assert all(abs(s[ids == r["vec_id"]][0] - r["score"]) < 1e-12 for r in found)
    assert len(got) == sum(ids % 50 == 0) and hit / total >= 0.9


def test_neighbours_do_not_depend_on_partitions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 700")
    ask = lambda df, **o: sorted(map(tuple, permindex.search(df, rows.where("vec_id % 50 = 0"), **o).collect()))
    one = ask(rows.coalesce(1))
    assert one == ask(rows.repartition(7)) == ask(rows, query_block=4)


def test_vectors_that_take_no_part(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in permindex.search(df, df.where("vec_id = 0")).collect())
    assert got == [(1, 1, 1.0), (2, 1, 1.0), (3, 7, 0.707107)]
    assert permindex.search(df.limit(0), df.limit(0)).count() == 0


def test_raking_meets_the_margins(spark):
    cells = [("a", "en", "x", 60), ("a", "fr", "y", 10), ("b", "en", "y", 20), ("b", "fr", "x", 10)]
    goal = [{"a": 0.5, "b": 0.5}, {"en": 0.6, "fr": 0.4}, {"x": 0.5, "y": 0.5}]
    w = mixing.rake(cells, goal, 400)
    for d in range(3):
        for k, v in goal[d].items():
            assert abs(sum(x * c[3] for x, c in zip(w, cells, strict=True) if c[d] == k) - 100 * v) < 1e-6
    docs = spark.createDataFrame([(i, "w " * (c[3] - 1) + "w", c[1], c[0], c[2]) for i, c in enumerate(cells)], "doc_id long, text string, lang string, source string, topic string")
    from pyspark.sql import functions as F

    near = mixing.weights(docs, topic=F.col("topic"), rounds=5).orderBy("source", "lang").collect()
    far = mixing.weights(docs, topic=F.col("topic"), rounds=5, max_cells=1).orderBy("source", "lang").collect()
    assert np.allclose([r["weight"] for r in near], [r["weight"] for r in far])
    assert mixing.misfit(cells, goal, w) < 1e-8 < mixing.misfit(cells, goal, np.ones(4))


def test_mixing_of_odd_rows(spark):
    names = ["topic", "tokens", "weight", "keep_prob", "sampled", "n", "__x0"]
    rows = [(1, None, None, None, *names), (1, None, None, None, *names), (2, "", "en", None, *names), (3, "a b\nc", "en", "s", *names), (None, "1 2 3", "fr", "s", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(docs, out=("o1", "o2", "o3", "o4", "o5")).collect()
    assert len(got) == 5 and all(r[n] == n for r in got for n in names)
    assert sorted((r["o1"], r["o2"]) for r in got) == [("brief", 3), ("none", 1), ("none", 1), ("none", 1), ("numeric", 3)]
    assert max(r["o4"] for r in got) == 1 and all(r["o5"] for r in got if r["o4"] == 1) and len({r["o5"] for r in got if r["doc_id"] == 1}) == 1
    assert mixing.mix(docs).columns[4:] == ["n", "__x0", "topic", "tokens", "weight", "keep_prob", "sampled"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_license_inheritance(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/f.py", "code"), (3, "a/b/c/g.py", "# Licensed under the Apache License, Version 2.0."), (4, "z/f.py", None), (5, "a/b/COPYING", "nothing"), (6, None, "x"), (7, "f", "")]
    got = {r["key"]: (r["license"], r["via"], r["from_dir"]) for r in licenses.scan(spark.createDataFrame(files, "key long, path string, text string")).collect()}
    assert got[1][:2] == ("MIT", "own") and got[2] == ("MIT", "inherited", "a") and got[3][:2] == ("Apache-2.0", "own")
    assert got[4] == got[6] == got[7] == (None, "none", None) and got[5] == ("MIT", "inherited", "a")


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, seen = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == cols, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] == seen[2]
    assert ordermh.near_classes(docs).where("doc_id <> class_id").count() == 0
    assert decontaminate.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    want = sorted(r[0] for r in mixing.mix(docs).where("sampled").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in cp.run(spark, sf).collect()) == want


CLASH = ["keep", "t", "t1", "doc", "score", "predicted", "n_dropped", "n_lines", "kept", "n_words", "item_ids", "contaminated", "topic", "tokens", "weight", "class_id", "w", "b", "__x0", "a.b"]


@pytest.fixture(scope="module")
def mixed_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, versions, and extra columns that clash."""
    line = "one line of all documents"
    own = [prose(900 + i, 60) for i in range(8)]
    long = prose(77, 20_000)
    texts = [(1, own[0] + "\n" + line), (2, own[0].upper() + "\n" + line), (3, None), (3, None), (4, ""), (5, own[1]), (5, own[1]), (5, own[2]), (None, own[3]), (None, own[3]), (6, long), (7, long + " end"), (8, BENCH + " " + own[4]), (9, "! ?")]
    texts += [(20 + i, prose(500 + i, 40) + "\n" + line) for i in range(10)]
    rows = [(i, t, None if (i or 0) % 3 else "en", None if (i or 0) % 2 else "s", len(t or ""), *CLASH) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


BENCH = " ".join(f"question{i}" for i in range(12))


@pytest.fixture(scope="module")
def side_tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("side"))
    spark.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(at + "/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None), (3, "")], "item_id long, text string").write.parquet(at + "/benchmark.parquet")
    return at


def rows_of(df):
    return sorted(([str(r["doc_id"]), r["text"] or str(r["text"])] for r in df.select("doc_id", "text").collect()))


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_tables(spark, mixed_docs, side_tables, at):
    import corpus_pipeline as cp

    name, stage = cp.STAGES[at]
    docs = mixed_docs
    got = stage(spark, docs, side_tables)
    assert all(tuple(r[c] for c in CLASH) == tuple(CLASH) for r in got.collect())
    assert stage(spark, docs.limit(0), side_tables).count() == 0
    before = rows_of(docs)
    if name == "toxicity":  # one class only: nothing goes
        assert rows_of(got) == before
    if name == "line_dedup":
        line = "\none line of all documents"
        assert rows_of(got) == sorted([i, t.replace(line, "")] for i, t in before) and got.columns == docs.columns
        assert got.where("text is not null and n_chars <> char_length(text)").count() == 0
    if name == "near_dedup":
        left = [r["doc_id"] for r in got.collect()]
        assert sorted(str(i) for i in left) == sorted(["1", "3", "4", "5", "5", "None", "6", "8", "9", *[str(20 + i) for i in range(10)]])
    if name == "decontamination":
        assert rows_of(got) == [r for r in before if "question3" not in r[1]]
    if name == "mixing":
        assert got.columns == [*docs.columns, "mix_topic", "mix_tokens", "mix_weight", "keep_prob"]


def test_passages_made_of_frequent_lines(spark):
    """Two texts share a passage whose lines stand, in other company, in many texts that sort before and between them."""
    lines = [prose(7000 + i, 10) for i in range(7)]
    texts = {}
    for n in range(400):  # each two lines that follow each other, between words of its own
        texts[n] = " ".join(prose(8000 + 10 * n + i, 25) + " " + lines[i] + " " + lines[i + 1] for i in random.Random(n).sample(range(6), 6))
    for d in (150, 350):
        texts[d] = prose(90 + d, 60) + " " + " ".join(lines) + " " + prose(91 + d, 60)
    got = passages.repeated_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["class_id"]) for r in got) == [(150, 60, 130, 150), (350, 60, 130, 150)]


def test_whole_license_files(spark):
    """Real license files, alone, in a directory and as the comment at the head of a source file."""
    import pathlib

    import pyspark

    at = pathlib.Path(pyspark.__file__).parent / "licenses"
    mit, bsd = (at / "LICENSE-mustache.txt").read_text(), (at / "LICENSE-py4j.txt").read_text()
    apache = (pathlib.Path(licenses.__file__).parent / "licence_texts/Apache-2.0.txt").read_text().split("APPENDIX")[0]
    head = "".join(f"# {x}\n" for x in mit[mit.index("Permission") :].split("\n"))
    texts = licenses.text_templates(spark)
    assert len(texts) == 9 and min(sum(t.values()) for t in texts.values()) > 100
    files = [(1, "a/LICENSE", mit), (2, "a/x.py", "code"), (3, "b/LICENSE", bsd), (4, "c/LICENSE", apache), (5, "d/x.py", head + "\nimport os\n" + "x = call(y)\n" * 500), (6, "e/x.txt", "No license here. " + prose(5, 400)), (7, "c/y", None)]
    got = {r["key"]: (r["license"], r["via"]) for r in licenses.scan(spark.createDataFrame(files, "key long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("BSD-3-Clause", "own"), 4: ("Apache-2.0", "own"), 5: ("MIT", "own"), 6: (None, "none"), 7: ("Apache-2.0", "inherited")}


def test_mixing_without_text_reads_texts_once(spark):
    rows = [(i, None if i % 7 == 0 else "a b\nc " * (i % 5) + str(i), "en" if i % 3 else None, "s" if i % 2 else "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    short = mixing.mix(docs, keep=["doc_id"])
    assert "xxhash64" not in (plan := short._jdf.queryExecution().optimizedPlan().toString()) and "md5" not in plan and "translate" not in plan
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, mixing.mix(docs).select(short.columns).collect()))


def test_components_of_a_long_path_take_few_jobs(spark):
    """The driver keeps the plans, stages and tasks of past jobs, so their number must not follow the rounds."""
    sc = spark.sparkContext
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").localCheckpoint()
    sc.setJobGroup("path", "")
    ordermh.components(df)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("path")) <= 8


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows of a class than a sample would hold, in several shards, and texts of any length."""
    seen = []
    merged = toxicity.merged
    monkeypatch.setattr(toxicity, "merged", lambda got: seen.append(got) or merged(got))
    monkeypatch.setattr(toxicity, "SHARD", 20_000)
    rows = [(i, f"word{i % 7} vile" if i % 8 else f"word{i % 7} kind", "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(4000)] + [(1, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    held = docs.where("pmod(xxhash64(doc_id, 'held'), 5) = 0")
    once = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"])
    got = {r["doc_id"]: r for r in once.collect()}
    assert seen[0]["rows"].sum() == 4001 - held.count() - held.where("doc_id = 1").count() and seen[0]["of c"][0] > 1
    assert all(r["predicted"] == int(i % 8 > 0) for i, r in got.items())
    again = toxicity.score(docs, toxicity.train(docs.repartition(7), labels.repartition(3)), ["doc_id"])
    assert all(abs(r["score"] - got[r["doc_id"]]["score"]) < 1e-4 for r in again.collect())
    long = docs.where("doc_id < 16").selectExpr("doc_id", "concat(repeat('so ', 30001), text) as text", "lang")
    assert toxicity.train(long, labels) is not None


def test_pairs_of_no_licence_have_their_own_frequency(spark):
    """Scores of whole texts against TF-IDF by hand, foreign pairs included."""
    import math
    import pathlib
    from collections import Counter

    mit = (pathlib.Path(licenses.__file__).parent / "licence_texts/MIT.txt").read_text()
    common = "our shared words " * 60
    files = [(1, "a", mit + common), (2, "b", "warrant " + common), (3, "c", "warrant " + prose(3, 50)), (4, "d", mit), (5, "e", "none " + common)]
    base = licenses.prepared(spark.createDataFrame(files, "key long, path string, text string"))
    rows = {r["key"]: Counter(r["pairs"]) for r in base.collect()}
    assert not rows[5]
    n, df = 4, Counter(w for c in rows.values() for w in c)
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1
    texts = licenses.text_templates(spark)
    norm = lambda c: math.sqrt(sum((x * idf(w)) ** 2 for w, x in c.items()))
    want = {}
    for i, c in rows.items():
        score, name = max((round(sum(x * t.get(w, 0) * idf(w) ** 2 for w, x in c.items()) / (norm(c) * norm(t)), 6) if c else 0, k) for k, t in texts.items())
        if score >= 0.01:
            want[i] = name, score
    names = {r["id"]: r["key"] for r in base.collect()}
    got = {names[r["id"]]: (r["license"], r["score"]) for r in licenses.whole_texts(base, texts, n, 0.01).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-5 for i in want) and 1 in got


def test_kept_rows_lie_in_few_files(spark):
    from chronoweave import storage

    most = storage.FILES * max(4, spark.sparkContext.defaultParallelism)
    d = storage.kept(spark.range(1000).repartition(most + 100))
    assert d.rdd.getNumPartitions() == most and d.distinct().count() == 1000
    assert storage.kept(spark.range(10).repartition(5), 2).rdd.getNumPartitions() == 2


def test_anchors_of_said_over_words_are_few(spark):
    """A word said 40 times gives two anchors, not one for each place; lone places with the same words around are one class."""
    texts = [prose(1, 120) + " " + " ".join(["ha"] * 40) + " " + prose(2, 120), (prose(3, 31) + " ") * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = {r["doc_id"]: r["t"] for r in passages.document_texts(docs).collect()}
    rows = [(1, t[0], at, 5 if at < 130 else at, at >= 130) for at in range(120, 137)] + [(2, t[1], at, at, True) for at in range(124, 800, 31)]
    members = spark.createDataFrame(rows, "g long, t long, at long, comp long, alone boolean")
    got = passages.anchors(passages.word_table(docs), members).collect()
    assert sorted((r["at"], r["alone"], r["s"], r["n"]) for r in got if r["g"] == 1) == [(at, alone, 120, 36) for at in (120, 155) for alone in (False, True)]
    assert len({r["comp"] for r in got if r["g"] == 1}) == 2 and len({r["comp"] for r in got if r["g"] == 2}) == 1


def test_long_runs_of_a_word_are_covered(spark):
    """Links between runs of one shingle cover each whole run that is alone, in one class."""
    runs = {(1, 10, 200): {(1, True)}, (2, 0, 60): {(2, True)}, (3, 5, 46): {(3, True)}, (4, 0, 45): {(4, True)}, (1, 500, 70): {(5, True)}}
    top = {i: i for i in range(1, 6)}

    def join(classes):
        old = {top[c] for c in classes}
        top.update({c: min(old) for c in top if top[c] in old})

    out = passages.run_links(runs, lambda classes: len({top[c] for c in classes}) < 2, join, 46)
    assert top == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1} and all(x[0] != x[3] and x[2] - x[1] == x[5] - x[4] >= 50 for x in out)
    for t, s, n in [(1, 10, 200), (2, 0, 60), (3, 5, 46), (1, 500, 70)]:
        covered = {w for x in out for who, lo, hi in (x[:3], x[3:6]) if who == t for w in range(lo, hi)}
        assert set(range(s, s + n + 4)) <= covered


def test_part_at_an_anchor_is_that_of_all_parts():
    r, hits = np.random.default_rng(0), 0
    for k in range(2000):
        n = int(r.integers(50, 205))
        x = (np.arange(n) % (37 if k % 3 == 0 else 1000) // (9 if k % 3 == 1 else 1)).astype(np.uint64)
        y, c = x.copy(), int(r.integers(0, n))
        y[r.random(n) < r.choice([0.02, 0.05, 0.1, 0.2])] = 999
        y = np.concatenate([r.integers(300, 400, int(r.integers(0, 20))).astype(np.uint64), y])
        for j in np.flatnonzero(y == x[c])[:2].tolist():
            want = next((p for p in passages.similar_parts(x, y, 46) if p[0] <= c < p[1] and p[2] <= j < p[3]), None)
            assert passages.part_at(x, y, x.tolist(), y.tolist(), c, j, 46) == want
            hits += want is not None
    assert hits > 500
    assert ordermh.aligned(np.arange(50), np.arange(40), 0.8) == 0.8  # the band is not a rounding too narrow


def test_texts_move_only_for_many_ids(spark, monkeypatch):
    """The words of a few documents are read without a move of all texts; of more, by a join of both sides: the same rows."""
    docs = spark.createDataFrame([(i, prose(i, 8)) for i in range(30)] + [(3, "another version")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in (3, 3, 7, 99)], "doc_id long")
    got = ordermh.word_bytes(docs, ids)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ordermh, "SENT", 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ordermh.word_bytes(docs, ids).collect())) and got.count() == 3


def test_mixed_keys_do_not_depend_on_batches(spark):
    rows = [(i, i % 5 if k % 3 else 7, k) for k in range(40) for i in range(k % 7 + 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = ordermh.mixed_keys(spark.createDataFrame(rows + rows[:50], "id long, comp long, bk long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(x for x in rows if len({c for _, c, k in rows if k == x[2]}) > 1)
