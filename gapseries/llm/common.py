"""What the corpus operators share: the shared folder, row keys, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass looks at; arrays of eight bytes a character stay in the cache.
BLOCK_BYTES = 1 << 19
NO_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="gapseries-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of working tables under the shared one. Writing a table cuts its lineage, so a lost executor costs a re-run of
    tasks; clear() when nothing that is still to be computed reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch. Texts may be long, and by Spark's own settings a batch of them may be of any size.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has settings of its own."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


#: What operators keep in a worker from task to task, by operator.
KEPT: dict[str, dict] = {}


def _drop_others(keep: str | None) -> None:
    for name, held in KEPT.items():
        if name != keep:
            held.clear()


def _give_back() -> None:
    """Freed memory back to the system: Arrow's, and the C library's where it has a call for that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], keep: str | None = None) -> Callable[[Iterator], Iterator]:
    """run as a task that leaves little in its worker, which Spark uses again: it drops what other operators than keep have
    kept there, and at its end hands freed memory back."""

    def task(batches):
        _drop_others(keep)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def broadcast_if(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast hint only where the counted rows are under the bound; else Spark shuffles (and AQE splits hot keys)."""
    return F.broadcast(df) if rows <= bound else df.hint("merge")


def doc_keys(id_col: str, text_col: str) -> list[Column]:
    """_d, _k: a document's identity, never null. Repeated rows (same id, same text) are one document."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"),
        F.xxhash64(F.col(text_col)).alias("_k"),
    ]


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The whole row as struct _row beside working columns, so that no column of the caller's can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *columns)


def unpacked(df: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of like out of _row, those in new replaced."""
    return df.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in like.columns])


#: Keys (two longs) of documents to drop that may be broadcast; more are joined by shuffle.
BROADCAST_KEYS = 200_000


#: A key with more than one in so many of a table's rows is hot; there are fewer such keys than that.
HOT_PARTS = 1000


def join_counted(rows: DataFrame, by_key: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows (total of them) joined with by_key, a materialized row for each key with c, how many of rows have it.

    Hot keys are broadcast, so their rows stay where they are; the others, a thousandth of the rows each at most, are dealt out.
    """
    hot = F.col("c") * HOT_PARTS > total
    few = F.broadcast(by_key.filter(hot))
    rest = rows.join(F.broadcast(by_key.filter(hot).select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(by_key.filter(~hot), on))


def without(docs: DataFrame, bad: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of docs, columns unchanged, whose _d, _k are not in bad (which is counted, so pass a materialized one)."""
    marked = packed(docs, *keys)
    return unpacked(marked.join(broadcast_if(bad, bad.count(), BROADCAST_KEYS), ["_d", "_k"], "left_anti"), docs)


#: Bits of the lookup that tells tasks which keys may matter; a fuller one lets more through, never less.
FILTER_BITS = 1 << 27


def key_filter(keys: DataFrame, key: Column, n: int):
    """Broadcast bit set (at most 16 MB) of a long column's values modulo its size, put together by Spark."""
    bits = min(FILTER_BITS, 1 << max(16, (8 * max(n, 1)).bit_length()))
    v = F.pmod(key, F.lit(bits))
    rows = keys.select((v + 1).alias("v")).groupBy(F.expr("bitmap_bucket_number(v)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("m")).collect()
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for b, m in rows:  # these functions count from 1
        at = (b - 1) * 4096
        out[at : at + len(m)] = np.frombuffer(bytes(m), np.uint8)
    return keys.sparkSession.sparkContext.broadcast((bits, out))


def may_hold(lookup, keys: np.ndarray) -> np.ndarray:
    """Of each long whether it may be in a broadcast key_filter."""
    bits, m = lookup.value
    v = keys.astype(np.int64) & np.int64(bits - 1)
    return (m[v >> 3] >> (v & 7).astype(np.uint8)) & 1 == 1


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
BYTE_CASED = _random(256, 1)
_BYTE = BYTE_CASED.copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
GRAM = _random(64, 2)
GRAM2 = _random(64, 3)

WORD_BYTES = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
WORD_BYTES[[32, 9, 10, 11, 12, 13]] = False
ALNUM_BYTES = np.ones(256, bool)  # words of digits, letters and everything beyond ASCII
ALNUM_BYTES[:128] = False
ALNUM_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size, inverse = max(n, BLOCK_BYTES + 1), pow(_BASE, -1, 1 << 64)
        for i, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POW[i] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


class Words:
    """Words of consecutive texts: hash, doc (index into the block), start and end byte in the block. Where breaks says so, a byte
    that is of a word begins a new one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, breaks: np.ndarray | None = None, values: np.ndarray = _BYTE):
        n = len(data)
        self.docs = len(offsets) - 1
        m = kind[data]
        first = m.copy()
        first[1:] &= ~m[:-1]
        at = offsets[:-1][offsets[:-1] < n]
        first[at] = m[at]
        last = m.copy()
        last[:-1] &= ~m[1:]
        inner = at[at > 0] - 1
        last[inner] = m[inner]
        if breaks is not None:
            new = np.flatnonzero(breaks & m)
            first[new] = True
            new = new[new > 0] - 1
            last[new] = m[new]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            p = np.zeros(n + 1, np.uint64)
            np.cumsum(values[data] * up[:n], out=p[1:])
            self.hash = mix((p[self.end] - p[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.docs)
        self.first = np.concatenate(([0], np.cumsum(self.count)))[:-1]

    def grams(self, k: int, by: np.ndarray = GRAM, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the k words from each position (or those in at) on; callers see to it that they lie in one text."""
        n = len(self.hash) - k + 1
        if at is None:
            at = slice(0, max(n, 0))
            if n <= 0:
                return np.zeros(0, np.uint64)
            with np.errstate(over="ignore"):
                g = self.hash[:n] * by[0]
                for j in range(1, k):
                    g += self.hash[j : n + j] * by[j]
            return mix(g + np.uint64(k))
        with np.errstate(over="ignore"):
            g = np.zeros(len(at), np.uint64)
            for j in range(k):
                g += self.hash[at + j] * by[j]
        return mix(g + np.uint64(k))

    def whole(self, k: int) -> np.ndarray:
        """Positions from which k words lie in one text."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, o, d = column.buffers()
    off = np.frombuffer(o, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return off, np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES):
    """(first row, offsets from 0, bytes) of runs of rows of about size bytes each; a longer text is a run of its own."""
    off, data = string_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]]
        lo = hi


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))
