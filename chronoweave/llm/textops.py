"""Vectorised text primitives over Arrow string buffers, and the Arrow map helper.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII bytes after lower-casing
A-Z.  Null text has no words.  All functions work on whole texts and bound their
memory by handling a batch in slices of about ``SLICE`` bytes (a longer single
text makes one slice of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..deploy import ship

SLICE = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
#: lower-cases, and turns every byte outside words into a space
NORMAL = bytes(int(LOWER[i]) if IS_WORD[i] else 32 for i in range(256))

_B = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, SLICE + 1)
        both = []
        for base in (_B, pow(_B, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _pow[:] = both
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public splitmix constants)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))


def large(a: pa.Array) -> pa.Array:
    """The texts as large_string without nulls."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    a = a.cast(pa.large_string())
    return a.fill_null("") if a.null_count else a


def slices(a: pa.Array, limit: int = SLICE):
    """(first row, byte array, offsets) for runs of rows of about ``limit`` bytes; offsets start at 0."""
    n = len(a)
    if not n:
        return
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and off[-1] > off[0] else np.zeros(int(off[-1]), np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of one slice: byte starts and ends, 64-bit hashes, and each row's range of words."""

    __slots__ = ("starts", "ends", "hashes", "rows", "cum", "data")

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        w = IS_WORD[data]
        edge = np.zeros(n + 1, bool)
        edge[off[off <= n]] = True
        start, end = w.copy(), w.copy()
        if n:
            start[1:] &= ~w[:-1] | edge[1:n]
            end[:-1] &= ~w[1:] | edge[1:n]
        self.data = data
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.rows = np.searchsorted(self.starts, off)
        p, inv = _powers(n + 1)
        self.cum = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[data]] * p[:n], dtype=np.uint64, out=self.cum[1:])
        self.hashes = self.span_hash(self.starts, self.ends)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inv = _powers(len(self.data) + 1)
        return mix((self.cum[ends] - self.cum[starts]) * inv[starts])

    def prefix_hash(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word, told apart from whole words."""
        return mix(self.span_hash(self.starts, np.minimum(self.starts + k, self.ends)) ^ np.uint64(k))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of every k consecutive word hashes of one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(_B) + h[i : i + n]
    return mix(out)


def segment_sum(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x[off[i]:off[i+1]] along axis 0; empty ranges give 0."""
    out = np.zeros((len(off) - 1, *x.shape[1:]), x.dtype)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.add.reduceat(x, off[:-1][full], axis=0)
    return out


def segment_max(x: np.ndarray, off: np.ndarray, empty: float) -> np.ndarray:
    out = np.full((len(off) - 1, *x.shape[1:]), empty, x.dtype)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(x, off[:-1][full], axis=0)
    return out


def quoted(name: str):
    """The column of exactly this name, dots and backticks included."""
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")


def map_text(df, fn, columns: dict[str, pa.DataType], keep: list[str], text: str = "text"):
    """``df[keep]`` with new columns that ``fn(large string array) -> list of arrays`` makes from the text.

    A kept column with the name of a new one is dropped.  One narrow Arrow pass,
    no shuffle.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_type

    ship(df.sparkSession)
    keep = [c for c in dict.fromkeys(keep) if c not in columns]
    src = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))  # plain names, as the map quotes none
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, from_arrow_type(t)) for c, t in columns.items())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            new = fn(large(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x, t) for x, t in zip(new, columns.values(), strict=True)]], names=[*keep, *columns])

    return src.mapInArrow(run, schema)


def unused(df, n: int, *taken: str) -> list[str]:
    """n column names that neither ``df`` nor ``taken`` has, whatever their case."""
    have = {c.lower() for c in (*df.columns, *taken)}
    return [x for x in (f"__x{i}" for i in range(len(have) + n)) if x not in have][:n]


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(col, n: int):
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n
