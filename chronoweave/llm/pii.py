"""Personal data: exact patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) follow fixed patterns.  The field labels candidate
tokens: space-separated tokens with a digit, '@' or '+'.  Every other token is fixed to
"none", which is exact for the model, since its potentials forbid any other label.  A
token has a unary potential from its shape and context; neighbours share a chain potential;
similar tokens anywhere in the document share a skip potential: those at the end of number
runs with the same last seven digits (however spaced or punctuated), and those with the same
mailbox name (with or without its domain).  Loopy sum-product messages pass along both kinds
of edges, so a mention that no pattern matches (a number broken by a neighbour, a mailbox
without its domain, other separators) takes the label of the mention it repeats.  Tokens
whose label is sure (``sure``) become spans, neighbours of one label one span, unless they
touch a base span, whose tokens are fixed to their label.  Each occurrence is linked to the
one before it and to the first, so edges grow linearly.

Weights of all three potentials are learned together by pseudo-likelihood, without hand
labels: base matches in a bounded sample of documents (``sample_docs`` rows in the order of
a hash, of less than ``max_chars`` characters each; both are parameters, and longer texts
are searched whole all the same) label their tokens.  As the patterns find every intact
mention, repeats that they miss are made: in the sample's texts some matches are repeated in
broken form and labelled alike, and as many broken mentions without a partner are labelled
none, so a broken shape alone proves nothing and the skip potential has to decide.  Matches
that the patterns drop for their digits are left out of the likelihood.

Defined cases: null and empty texts have no spans; every row gets a row; ties of equal
starts follow the order of the kinds; other columns are ignored; without any base match in
the sample the field adds nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import map_text, read

KINDS = ("email", "ip", "card", "phone")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[^\s]*[0-9@+][^\s]*")
NOT_DIGIT = re.compile(r"[^0-9]")
EDGE = re.compile(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$")
N_LABELS = 5
_models: dict = {}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _part_ok(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 3 or (len(p) == 3 and p <= "255")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    prev, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > prev and t[s - 1] in LOCAL_SET:
            s -= 1
        m = DOMAIN.match(t, at + 1) if s < at else None
        if m:
            out.append((s, 0, m.end()))
            prev = m.end()
        at = t.find("@", max(at + 1, prev))
    for m in IP.finditer(t):
        if all(_part_ok(p) for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 12:
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    at = t.find("+")
    while at >= 0:
        m = PHONE.match(t, at)
        if m and 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((at, 3, m.end()))
        at = t.find("+", m.end() if m else at + 1)
    return sorted(out)


def unsure_spans(t: str) -> list[tuple[int, int]]:
    """Matches that the patterns drop for their digits: they may hold data that a neighbour spoils, so nothing is learned from them."""
    out = [m.span() for m in CARD.finditer(t) if m.end() - m.start() >= 12]
    return sorted(out + [m.span() for m in PHONE.finditer(t)])


def tokens(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(t)]


NAMES = ["bias", "at", "plus", "dots3", "dot", "alldigit", "long", "mid", "short", "letters", "paren", "hyphen", "near", "eq", "hex", "mail", "few", "sum", "bytes"]


def features(t: str, spans: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(spans), len(NAMES)))
    for i, (s, e) in enumerate(spans):
        w = EDGE.sub("", t[s:e])
        d = sum(c.isdigit() for c in w)
        alpha = sum(c.isalpha() for c in w)
        x[i] = (
            1, "@" in w, w.startswith("+"), w.count(".") == 3 and alpha == 0, "." in w, d > 0 and d == len(w), d >= 12, 7 <= d < 12, d < 4, alpha > 0, "(" in w,
            "-" in w and alpha == 0, (i > 0 and s - spans[i - 1][1] == 1) or (i + 1 < len(spans) and spans[i + 1][0] - e == 1), "=" in w, alpha > 0 and d > 3, "@" in w and "." in w[w.find("@") + 1 :],
            4 <= d < 7, 12 <= d <= 19 and alpha == 0 and luhn(NOT_DIGIT.sub("", w)), w.count(".") == 3 and alpha == 0 and all(p and _part_ok(p) for p in w.split(".")),
        )
    return x


def skip_keys(t: str, spans) -> list[str]:
    """What makes tokens similar: the last seven digits of the number run that ends here, or the mailbox name; '' for none."""
    out, run = [], ""
    for i, (s, e) in enumerate(spans):
        w = EDGE.sub("", t[s:e])
        at = w.find("@")
        digits = NOT_DIGIT.sub("", w)
        if at > 2 or (at < 0 and digits and any(c.isalpha() for c in w)):
            out.append("@" + (w[:at] if at > 2 else w).lower())
            run = ""
            continue
        run += digits
        if i + 1 < len(spans) and spans[i + 1][0] - e <= 1 and t[spans[i + 1][0]] != "+" and len(digits) < 12:
            out.append("")  # the run goes on
            continue
        out.append(run[-7:] if len(run) >= 7 else "")
        run = ""
    return out


def edges(t: str, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of each edge, and whether it is a skip edge."""
    a, b, kind = [], [], []
    for i in range(1, len(spans)):
        if spans[i][0] - spans[i - 1][1] <= 1:
            a.append(i - 1)
            b.append(i)
            kind.append(0)
    first, last = {}, {}
    for i, k in enumerate(skip_keys(t, spans)):
        if not k:
            continue
        if k in last:
            a.append(last[k])
            b.append(i)
            kind.append(1)
            if first[k] != last[k]:
                a.append(first[k])
                b.append(i)
                kind.append(1)
        first.setdefault(k, i)
        last[k] = i
    return np.array(a, int), np.array(b, int), np.array(kind, int)


def token_labels(spans, base) -> np.ndarray:
    out = np.zeros(len(spans), int)
    for i, (s, e) in enumerate(spans):
        for bs, k, be in base:
            if bs < e and s < be:
                out[i] = k + 1
                break
            if bs >= e:
                break
    return out


def propagate(unary: np.ndarray, a, b, kind, pair: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Marginals by damped loopy sum-product; pair: log potentials (edge kind, label, label)."""
    if not len(a):
        z = unary - unary.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    pot = np.exp(np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)]))
    msg = np.zeros((len(src), N_LABELS))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        out -= out.max(1, keepdims=True)
        new = np.log(np.einsum("ei,eij->ej", np.exp(out), pot) + 1e-300)
        new -= new.max(1, keepdims=True)
        done = np.abs(new - msg).max() < 1e-6
        msg = 0.3 * msg + 0.7 * new
        if done:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


def broken(kind: int, w: str, r: random.Random) -> str:
    """A mention of the same data that its pattern does not match."""
    if kind == 0:
        local, domain = w.split("@", 1)
        return r.choice([f"{local}@{domain.split('.')[0]}", local, f"{local}@"])
    d = NOT_DIGIT.sub("", w)
    if kind == 1:
        return w.replace(".", r.choice(["-", "/", ","]))
    if kind == 2:
        sep = r.choice([".", "/", "_"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    return r.choice([f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-7:-4]}-{d[-4:]}", d[-10:]])


def other(w: str, r: random.Random) -> str:
    """The same shape with other letters and digits."""
    return "".join(r.choice("0123456789") if c.isdigit() else r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in w)


def with_repeats(t: str, base, r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with a broken mention of each match, or of nothing, at word gaps; and the spans (start, kind, end) to learn."""
    gaps = [m.start() for m in re.finditer(r"\s", t)]
    free = [g for g in gaps if not any(s - 2 <= g <= e + 1 for s, _, e in base)]
    if not free:
        return t, list(base)
    put = []
    for s, k, e in base:
        w = broken(k, t[s:e], r)
        put.append((r.choice(free), w, k))
        put.append((r.choice(free), other(w, r), None))
    out, spans, at, moved = [], [], 0, []
    for g, w, k in sorted(put, key=lambda x: x[0]):
        out.append(t[at:g] + " x " + w + " x")  # apart from its neighbours
        n = sum(map(len, out))
        if k is not None:
            spans.append((n - 2 - len(w), k, n - 2))
        moved.append((g, len(w) + 5))
        at = g
    text = "".join(out) + t[at:]
    shift = lambda x: x + sum(n for g, n in moved if g < x)
    return text, sorted(spans + [(shift(s), k, shift(e)) for s, k, e in base])


def learn(texts: list[str], rounds: int = 300, rate: float = 0.1) -> dict | None:
    """Weights of the unary, chain and skip potentials, by pseudo-likelihood (Adam on the whole sample); None without a match."""
    r = random.Random(7)
    xs, ys, ends, n = [], [], [], 0
    for t in texts:
        base = base_spans(t)
        for text, spans in ((t, base), with_repeats(t, base, r)) if base else ((t, base),):
            sp = tokens(text)
            if not sp:
                continue
            y = token_labels(sp, spans)
            sure = (y > 0) | (token_labels(sp, [(s, 0, e) for s, e in unsure_spans(text)]) == 0)
            a, b, kind = edges(text, sp)
            both = sure[a] & sure[b]
            at = np.cumsum(sure) - 1 + n
            xs.append(features(text, sp)[sure])
            ys.append(y[sure])
            ends.append((at[a[both]], at[b[both]], kind[both]))
            n += int(sure.sum())
    if not xs or not any(y.any() for y in ys):
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    a, b, kind = (np.concatenate([e[i] for e in ends]).astype(int) for i in range(3))
    goal = np.eye(N_LABELS)[y]
    p = {"w": np.zeros((len(NAMES), N_LABELS)), "pair": np.zeros((2, N_LABELS, N_LABELS))}
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    for step in range(1, rounds + 1):
        z = x @ p["w"]
        np.add.at(z, b, p["pair"][kind, y[a]])  # what each neighbour's label says
        np.add.at(z, a, p["pair"].transpose(0, 2, 1)[kind, y[b]])
        d = np.exp(z - z.max(1, keepdims=True))
        d = (d / d.sum(1, keepdims=True) - goal) / len(x)
        g = {"w": x.T @ d + 1e-4 * p["w"], "pair": 1e-4 * p["pair"]}
        np.add.at(g["pair"], (kind, y[a]), d[b])
        np.add.at(g["pair"].transpose(0, 2, 1), (kind, y[b]), d[a])
        for k in p:
            m[k][0] = 0.9 * m[k][0] + 0.1 * g[k]
            m[k][1] = 0.999 * m[k][1] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-9)
    return p


def added_spans(t: str, base, model: dict | None, sure: float) -> list[tuple[int, int, int]]:
    """The field's spans beside the base ones; tokens of one label with one blank between them make one span."""
    sp = tokens(t) if model else []
    if not sp:
        return []
    a, b, kind = edges(t, sp)
    unary = features(t, sp) @ model["w"]
    known = token_labels(sp, base)
    unary[known > 0] = -50
    unary[np.flatnonzero(known > 0), known[known > 0]] = 0
    p = propagate(unary, a, b, kind, model["pair"])
    best = p.argmax(1)
    out, before = [], -2
    for i in np.flatnonzero((known == 0) & (best > 0) & (p[np.arange(len(p)), best] >= sure)).tolist():
        s, e = sp[i]
        w = EDGE.sub("", t[s:e])
        if not w:
            continue
        s = t.find(w, s, e)
        e, k = s + len(w), int(best[i]) - 1
        if before == i - 1 and out[-1][1] == k and s - out[-1][2] <= 2 and not any(out[-1][2] <= x < s for x, _, _ in base):
            out[-1] = (out[-1][0], k, e)
        else:
            out.append((s, k, e))
        before = i
    return [x for x in out if len(NOT_DIGIT.sub("", t[x[0] : x[2]])) >= 4 or x[1] == 0]


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def train(docs: DataFrame, sample_docs: int = 2000, max_chars: int = 50_000) -> dict | None:
    """The field's weights, from ``sample_docs`` different texts under ``max_chars`` that hold a digit or '@'."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") < max_chars)).select("text", F.xxhash64("text").alias("h"))
    near = some.select("h").distinct().orderBy("h").limit(sample_docs)
    got = some.join(F.broadcast(near), "h").groupBy("h").agg(F.min("text").alias("text"))  # sample_docs rows at most
    return learn(sorted(got.select("text").toArrow()["text"].to_pylist()))


def find(docs: DataFrame, model: dict | None, keep: list[str], sure: float = 0.9) -> DataFrame:
    """``docs[keep]`` with counts of base spans, base and spans (kind:start:end, comma-joined)."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(texts):
        if key not in _models:
            _models.clear()
            _models[key] = sent.value
        m = _models[key]
        out = []
        for x in texts:
            t = x.as_py()
            base = base_spans(t)
            more = added_spans(t, base, m, sure)
            n = [0, 0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            b = spans_text(base)
            out.append((*n, b, hashlib.sha256(b.encode()).hexdigest(), spans_text(sorted({*base, *more})) if more else b))
        return list(zip(*out, strict=True))

    names = [f"n_{k}" for k in KINDS]
    return map_text(docs, run, dict.fromkeys(names, pa.int64()) | {"base": pa.string(), "base_sha256": pa.string(), "spans": pa.string()}, keep)


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find(docs, train(docs), ["doc_id"]).drop("base")
