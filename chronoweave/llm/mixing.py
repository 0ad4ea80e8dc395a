"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Token counts of (source, lang, topic) cells are raked so that the weighted tokens meet
target shares by source, by language and by topic; a document is then kept with its
cell's calibrated probability, the cell's weight over the largest weight (so the
largest is kept whole).  The draw is a hash of the document's id and text with a seed,
so it is repeatable and repeated rows share it.

Targets default to tempered shares: the share of tokens to the power ``temper``.  Topics
are a Column of the caller's; without one, ``topic_of`` sorts texts by their form (none,
numeric, markup, list, brief, prose), which needs no model and no sample.

Raking ends when a round changes no weight by more than ``EXACT`` of itself, or after
``rounds`` rounds (margins that contradict each other, such as a target for a language that
no source with weight has, never settle); ``misfit`` tells how far margins are off.

Defined cases: null source, lang or topic form the value '(none)'; a document without
words weighs one token; targets that name no present value are ignored and the rest are
rescaled; an empty table gives an empty result; other columns are passed on whatever their
names; output columns replace columns of their names.

Scale: one partial aggregation by cell.  Up to ``max_cells`` cells (counted first) the
raking runs in numpy on the driver and the weights are broadcast, so texts never move;
beyond, the margins are joined as DataFrames, kept after each round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept
from .textops import quoted, read, unused

DIMS = ("source", "lang", "topic")
ROUNDS, TEMPER, EXACT = 30, 0.7, 1e-13
OUT = ("topic", "tokens", "weight", "keep_prob", "sampled")
#: characters of numbers, of code and mark-up
DIGITS, MARKS = "0123456789", "{}<>=;$|"


def topic_of(text):
    """The form of a text: none (blank), numeric (a tenth digits), markup (a fiftieth marks), list (4 lines or more of 40 characters or fewer on average), brief (under 400 characters) or prose; the first that holds."""
    t = F.coalesce(text, F.lit(""))
    n, lines = F.length(t), F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    digits, marks = n - F.length(F.translate(t, DIGITS, "")), n - F.length(F.translate(t, MARKS, ""))
    return F.when(F.trim(t) == "", "none").when(digits * 10 >= n, "numeric").when(marks * 50 >= n, "markup").when((lines >= 4) & (n <= lines * 40), "list").when(n < 400, "brief").otherwise("prose")


def tokens_of(text):
    """Space-separated pieces, one at least: the spaces of the text and one."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.replace(F.replace(t, F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))) + 1).cast("long")


def draw(doc_id, text, seed: int = 1):
    """Uniform number of [0, 1) from the id and the text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def rake(cells: list[tuple], targets: list[dict], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells (source, lang, topic, tokens) whose weighted tokens meet the target shares."""
    n = np.array([c[3] for c in cells], float)
    w, total = np.ones(len(cells)), n.sum()
    codes = []
    for d in range(3):
        names = sorted({c[d] for c in cells})
        t = np.array([targets[d].get(x, 0.0) for x in names])
        at = {x: i for i, x in enumerate(names)}
        codes.append((np.array([at[c[d]] for c in cells]), t / t.sum() * total if t.sum() else None, len(names)))
    for _ in range(rounds):
        was = w.copy()
        for code, t, k in codes:
            if t is None:
                continue
            now = np.bincount(code, w * n, k)
            w *= np.where(now > 0, t / np.where(now > 0, now, 1), 0)[code]
        if (np.abs(w - was) <= EXACT * np.abs(was)).all():
            break
    return w


def misfit(cells: list[tuple], targets: list[dict], w: np.ndarray) -> float:
    """The largest difference between a margin's share of weighted tokens and its target share."""
    n, worst = np.array([c[3] for c in cells], float) * w, 0.0
    for d in range(3):
        goal = {x: targets[d].get(x, 0.0) for x in {c[d] for c in cells}}
        total = sum(goal.values())
        for x, g in goal.items():
            if total:
                worst = max(worst, abs(n[[c[d] == x for c in cells]].sum() / n.sum() - g / total))
    return worst


def cell_columns(topic=None) -> list:
    """source, lang, topic and tokens of a document."""
    none = F.lit("(none)")
    made = [F.col("source").cast("string"), F.col("lang").cast("string"), topic_of(F.col("text")) if topic is None else topic.cast("string")]
    return [*[F.coalesce(c, none) for c in made], tokens_of(F.col("text"))]


def weights(docs: DataFrame, targets: dict | None = None, topic=None, temper: float = TEMPER, rounds: int = ROUNDS, max_cells: int = 200_000) -> DataFrame:
    """One row a cell: source, lang, topic, cell_tokens, weight, keep_prob."""
    cells = docs.select(*[c.alias(n) for c, n in zip(cell_columns(topic), [*DIMS, "tokens"], strict=True)])
    return weights_of(cells.groupBy(*DIMS).agg(F.sum("tokens").alias("n")), targets, temper, rounds, max_cells)


def weights_of(cells: DataFrame, targets: dict | None = None, temper: float = TEMPER, rounds: int = ROUNDS, max_cells: int = 200_000) -> DataFrame:
    """``weights`` of counted cells: source, lang, topic, n."""
    spark = cells.sparkSession
    got = cells.limit(max_cells + 1).collect()
    schema = "source string, lang string, topic string, cell_tokens long, weight double, keep_prob double"
    if len(got) <= max_cells:
        rows = sorted(tuple(r) for r in got)
        w = rake(rows, [_targets(rows, d, targets, temper) for d in range(3)], rounds)
        top = w.max() if len(w) else 1.0
        return F.broadcast(spark.createDataFrame([(*r, float(x), float(x / top) if top else 0.0) for r, x in zip(rows, w, strict=True)], schema))  # max_cells rows at most
    return _rake_distributed(cells, targets, temper, rounds)


def _targets(rows, d, targets, temper) -> dict:
    if targets and DIMS[d] in targets:
        return targets[DIMS[d]]
    n: dict = {}
    for r in rows:
        n[r[d]] = n.get(r[d], 0) + r[3]
    return {k: float(v) ** temper for k, v in n.items()}


def _rake_distributed(cells: DataFrame, targets, temper, rounds) -> DataFrame:
    spark = cells.sparkSession
    cells = kept(cells.withColumn("w", F.lit(1.0)))
    total = cells.agg(F.sum("n")).first()[0]
    goals = []
    for d in DIMS:
        by = cells.groupBy(d).agg(F.sum("n").cast("double").alias("g"))
        if targets and d in targets:
            t = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, g double")
            by = by.select(d).join(t, d, "left").fillna(0.0)
        else:
            by = by.withColumn("g", F.pow("g", F.lit(temper)))
        s = by.agg(F.sum("g")).first()[0]
        goals.append(kept(by.withColumn("g", F.col("g") / s * total)) if s else None)
    for _ in range(rounds):
        cells = cells.withColumn("was", F.col("w"))
        for d, goal in zip(DIMS, goals, strict=True):
            if goal is not None:
                now = cells.groupBy(d).agg(F.sum(F.col("w") * F.col("n")).alias("s")).join(goal, d)
                cells = cells.join(now, d).withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col("g") / F.col("s")).otherwise(0.0)).select(*DIMS, "n", "w", "was")
        cells = kept(cells)
        if not cells.where(F.abs(F.col("w") - F.col("was")) > EXACT * F.abs("was")).limit(1).count():
            break
    top = cells.agg(F.max("w")).first()[0]
    return cells.select(*DIMS, F.col("n").alias("cell_tokens"), F.col("w").alias("weight"), (F.col("w") / top).alias("keep_prob"))


def mix(docs: DataFrame, targets: dict | None = None, topic=None, temper: float = TEMPER, seed: int = 1, max_cells: int = 200_000, out: tuple = OUT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, by default all) with topic, tokens, weight, keep_prob and sampled, under the names ``out`` (which replace columns of that name).

    Where ``keep`` leaves the text out, texts are read once and what is computed of them is kept.
    """
    names = docs.columns if keep is None else keep
    made = unused(docs, 10, *out)
    keys, tokens, own, chance = made[:3], made[3], made[4:7], made[9]
    d = docs.withColumns(dict(zip([*keys, tokens, chance], [*cell_columns(topic), draw(F.col("doc_id"), F.col("text"), seed)], strict=True)))
    if "text" in names:
        w = weights(docs, targets, topic, temper, max_cells=max_cells)
    else:
        d = kept(d.select(*[quoted(c) for c in names], *keys, tokens, chance))
        w = weights_of(d.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, DIMS, strict=True)]).agg(F.sum(tokens).alias("n")), targets, temper, max_cells=max_cells)
    w = w.select(*[F.col(x).alias(k) for x, k in zip(DIMS, own, strict=True)], F.col("weight").alias(made[7]), F.col("keep_prob").alias(made[8]))
    j = d.join(w, [d[k] == w[o] for k, o in zip(keys, own, strict=True)], "left")
    sampled = F.col(chance) < F.col(made[8])
    new = [F.col(keys[2]), F.col(tokens), F.col(made[7]), F.col(made[8]), sampled]
    return j.select(*[quoted(c) for c in names if c not in out], *[c.alias(n) for c, n in zip(new, out, strict=True)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, keep=["doc_id"]).select("doc_id", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("keep_prob", 6).alias("keep_prob"), "sampled")


def _oracle() -> str:
    parts = [
        f"""d as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
  case when trim(t) = '' then 'none' when (n - length(translate(t, '{DIGITS}', ''))) * 10 >= n then 'numeric' when (n - length(translate(t, '{MARKS}', ''))) * 50 >= n then 'markup'
    when lines >= 4 and n <= lines * 40 then 'list' when n < 400 then 'brief' else 'prose' end as topic,
  (n - length(translate(t, ' ' || chr(10), '')) + 1)::bigint as tokens,
  ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 8))::bigint / 4294967296.0 as u
  from (select *, length(t) as n, length(t) - length(replace(t, chr(10), '')) + 1 as lines from (select *, coalesce(text, '') as t from documents)))""",
        "c0 as materialized (select source, lang, topic, sum(tokens)::double as n, 1.0::double as w from d group by all)",
    ]
    for x in DIMS:
        parts.append(f"g_{x} as materialized (select {x}, pow(sum(n), {TEMPER}) / (select sum(p) from (select pow(sum(n), {TEMPER}) as p from c0 group by {x})) * (select sum(n) from c0) as g from c0 group by {x})")
    k = 0
    for _ in range(ROUNDS):
        for x in DIMS:
            parts.append(f"c{k + 1} as materialized (select c.source, c.lang, c.topic, c.n, c.w * g.g / sum(c.w * c.n) over (partition by c.{x}) as w from c{k} c join g_{x} g using ({x}))")
            k += 1
    parts.append(f"e as (select source, lang, topic, w, w / max(w) over () as p from c{k})")
    return "with " + ",\n".join(parts) + "\nselect d.doc_id, d.topic, d.tokens, round(e.w, 6) as weight, round(e.p, 6) as keep_prob, d.u < e.p as sampled from d join e using (source, lang, topic)"


ORACLE = _oracle()
