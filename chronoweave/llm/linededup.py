"""Line dedup, DataFrame functions only: hashes of lines are range-partitioned with a secondary
sort by document and position, first occurrences are streamed, and each document gets a
compressed keep bitmap.

A text (null: empty) is split at ``\\n``; a line's key is the line stripped of
``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased.  A key of at least ``min_chars``
code points found in at least ``min_docs`` documents loses all its lines
(``keep_first=False``) or all but the first by (doc_id, text hash, position)
(``keep_first=True``).

Defined cases: documents are told apart by doc_id, and all null ids are one document; a
null or empty text is one empty line; empty keys are never dropped; a key repeated within
one document counts once for it; rows that repeat a doc_id each get a row, but their
versions are one document for the count; equal rows share a bitmap; an empty table gives an
empty result; other columns are passed on by ``apply_bitmaps`` whatever their names.

Scale: texts are split twice, once for the hashes and once to be rebuilt.  The hashed lines
(128 bits, id, text hash, position) are kept in shared storage, so the sampling of the range
partitioner does not split them again.  Ranges are cut by (hash, document), so a hot key
lies in many partitions, each of which sends one row to its count.  The join of counted keys
with the lines is salted by document.  A document's dropped positions become runs by one
sorted window; nothing is quadratic in the lines of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import kept
from .textops import quoted, read, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIM = " \t\n\x0b\x0c\r"
DOC = ["doc", "t"]


def text_print(text):
    """Hash of a text, null as empty; with the doc_id it names a version of a document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_array(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line):
    return F.translate(F.btrim(line, F.lit(TRIM)), UPPER, LOWER)


def lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """Rows (h1, h2, doc, t, pos): the lines whose keys may be dropped."""
    d = docs.select(F.col("doc_id").alias("doc"), text_print(F.col("text")).alias("t"), F.posexplode(line_array(F.col("text"))).alias("pos", "line"))
    d = d.select("doc", "t", "pos", key_of(F.col("line")).alias("k")).where(F.char_length("k") >= max(1, min_chars))
    return d.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"), "doc", "t", "pos")


def repeated_keys(rows: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, n, first: keys found in at least ``min_docs`` documents, with their number and the first (doc, t, pos).

    The rows are range-partitioned by (hash, document) and sorted by position within; both
    first occurrences, of a document and of a partition, stream over the runs, and one row
    for each key and partition is merged by hash.
    """
    runs = rows.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "t", "pos")
    by_doc = runs.groupBy("h1", "h2", "doc").agg(F.min(F.struct("t", "pos")).alias("at"))  # no exchange: the ranges hold whole (hash, document) runs
    got = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at.t", "at.pos")).alias("first"))
    return got.where(F.col("n") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, salts: int = 16) -> DataFrame:
    """One row for each version of a document that loses lines: doc, t, n_dropped and ``keep``, the run-length
    encoded bitmap (lengths of kept and dropped runs in turn, the last kept run left open)."""
    rows = kept(lines(docs, min_chars))
    again = repeated_keys(rows, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "t"), F.lit(salts)).cast("int")).join(again, ["h1", "h2", "salt"])
    if keep_first:
        hits = hits.where(~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.t") == F.col("t")) & (F.col("first.pos") == F.col("pos"))))
    w = Window.partitionBy(*DOC).orderBy("pos")
    # equal rows give equal positions, which rank alike and fall together
    runs = hits.select(*DOC, "pos", (F.col("pos") - F.dense_rank().over(w)).alias("island")).groupBy(*DOC, "island").agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("z"))
    r = Window.partitionBy(*DOC).orderBy("a")
    runs = runs.select(*DOC, "a", (F.col("a") - F.coalesce(F.lag("z").over(r), F.lit(0))).alias("stay"), (F.col("z") - F.col("a")).alias("go"))
    per = runs.groupBy(*DOC).agg(F.sum("go").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("a", "stay", "go"))).alias("runs"))
    return per.select(*DOC, "n_dropped", F.flatten(F.transform("runs", lambda x: F.array(x["stay"], x["go"]))).alias("keep"))


def kept_text(ls, keep):
    """Kept lines joined by ``\\n``; each line meets its own flag, so the cost is linear."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    rest = F.filter(F.arrays_zip(ls.alias("line"), flags.alias("stay")), lambda x: F.coalesce(x["stay"], F.lit(True)))
    return F.array_join(F.transform(rest, lambda x: x["line"]), "\n")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped", text: str = "kept") -> DataFrame:
    """``docs`` with the number of lines, of dropped lines, and the remaining text, under the names given (which replace columns of that name)."""
    out = (n_lines, n_dropped, text)
    ls, doc, t, gone, keep = unused(docs, 5, *out)
    b = bitmaps.toDF(doc, t, gone, keep)
    d = docs.withColumn(ls, text_print(F.col("text")))
    j = d.join(b, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(ls) == F.col(t)), "left").withColumn(ls, line_array(F.col("text")))
    whole = F.coalesce(F.col("text"), F.lit(""))
    made = [F.size(ls).cast("long").alias(n_lines), F.coalesce(gone, F.lit(0)).cast("long").alias(n_dropped), F.when(F.col(keep).isNull(), whole).otherwise(kept_text(F.col(ls), F.col(keep))).alias(text)]
    return j.select(*[quoted(c) for c in docs.columns if c not in out], *made)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
with r as (select row_number() over () as rid, doc_id, text from documents),
l as (
  select rid, doc_id, u.i as pos, u.line as line, translate(regexp_replace(u.line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select rid, doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'i': i})) as u from r)
), f as (select k from l where length(k) >= 1 group by k having count(distinct coalesce(doc_id::varchar, '')) >= 10)
select any_value(l.doc_id) as doc_id, count(*)::bigint as n_lines, (count(*) filter (where f.k is not null))::bigint as n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where f.k is null), '')) as kept_sha256
from l left join f on l.k = f.k group by l.rid
"""
