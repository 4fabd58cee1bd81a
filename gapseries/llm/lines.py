"""Line dedup: lines found in many documents go. Line hashes are counted in levelled sorted runs, batch by batch."""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Batches that a whole table is added in; by a document's hash, so they are of like size at any number of documents.
BATCHES = 4
#: Runs of one level that are merged into one of the next.
FAN = 2
#: Keys of lines to drop that are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_LINES = 500_000

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_A, _B = common._BYTE, common._random(256, 4)
_B[65:91] = _B[97:123]  # A-Z hash as a-z


class Lines(NamedTuple):
    """Lines of consecutive texts: index of the text, first byte and the byte after the last (in the block), two hashes of the key, and
    its code points."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    g: np.ndarray
    chars: np.ndarray


def lines(data: np.ndarray, off: np.ndarray) -> Lines:
    """Split at \\n; the key is the line without ASCII space at its ends, A-Z lower-cased. An empty text is one empty line."""
    n, docs = len(data), len(off) - 1
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(off, breaks, side="right") - 1
    doc = np.repeat(np.arange(docs), 1 + np.bincount(of, minlength=docs))
    start, end = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    after = np.arange(len(breaks)) + of + 1
    first = np.arange(docs) + np.searchsorted(breaks, off[:-1])
    start[first], start[after] = off[:-1], breaks + 1
    end[np.append(first[1:], len(doc))[:docs] - 1], end[after - 1] = off[1:], breaks
    solid = ~SPACE[data]
    place, rank = np.flatnonzero(solid), np.concatenate(([0], np.cumsum(solid)))
    a, b = rank[start], rank[end]
    full = a < b
    lo = np.where(full, np.append(place, 0)[a], 0)
    hi = np.where(full, np.append(place, 0)[b - 1] + 1, 0)
    up, down = common.powers(n + 1)
    made = []
    with np.errstate(over="ignore"):
        for values in (_A, _B):
            p = np.zeros(n + 1, np.uint64)
            np.cumsum(values[data] * up[:n], out=p[1:])
            made.append(common.mix((p[hi] - p[lo]) * down[lo] + (hi - lo).astype(np.uint64)).view(np.int64))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return Lines(doc, start, end, *made, points[hi] - points[lo])


def keep(data: np.ndarray, off: np.ndarray, at: Lines, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of the lines that are not gone, joined by \\n."""
    whole = np.zeros(len(data) + 1, np.int64)  # a line with the break behind it, where there is one
    last = np.append(at.doc[1:] != at.doc[:-1], True)[: len(at.doc)]
    stop = at.end + ~last
    left = ~gone
    np.add.at(whole, at.start[left], 1)
    np.add.at(whole, stop[left], -1)
    mask = np.cumsum(whole[:-1]) > 0
    rows = np.flatnonzero(left)
    final = rows[np.append(at.doc[rows][1:] != at.doc[rows][:-1], True)[: len(rows)]]
    final = final[~last[final]]
    mask[at.end[final]] = False  # the break behind the last line kept
    return data[mask], np.concatenate(([0], np.cumsum(mask)))[off]


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """_d, _k, h, g, b: the distinct keys of each row, its document and that one's batch."""

    def run(parts):
        for part in parts:
            d, k = (part.column(i).to_numpy() for i in (0, 1))
            for lo, off, data in common.text_blocks(part.column(2)):
                at = lines(data, off)
                rows = np.flatnonzero(at.chars >= min_chars)
                rows = rows[np.lexsort((at.g[rows], at.h[rows], at.doc[rows]))]
                new = np.ones(len(rows), bool)
                new[1:] = False
                for x in (at.doc, at.h, at.g):
                    new[1:] |= x[rows][1:] != x[rows][:-1]
                rows = rows[new]
                i = at.doc[rows] + lo
                b = common.mix((d[i] ^ k[i]).view(np.uint64)) % np.uint64(batches)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[i], k[i], at.h[rows], at.g[rows], b.astype(np.int32))], names=["_d", "_k", "h", "g", "b"])

    texts = docs.select(*common.doc_keys(id_col, text_col), F.col(text_col).alias("_t"))
    return texts.mapInArrow(common.lean(run), "_d long, _k long, h long, g long, b int")


class Runs:
    """Levelled sorted runs of line keys: h, g and n, in how many documents of the run's batches. Every run is a table bucketed by key
    and sorted in each bucket, so batches are joined with runs and runs with each other by merging, and nothing is dealt out again.

    A key that one run has in `enough` documents is settled: batches that come later leave it out.
    """

    def __init__(self, scratch: common.Scratch, enough: int, fan: int = FAN):
        self.scratch, self.spark, self.enough, self.fan = scratch, scratch.spark, enough, fan
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        w = counts.select("h", "g", "n").write.bucketBy(self.buckets, "h", "g").sortBy("h", "g")
        w.option("path", f"{self.scratch.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay until the scratch folder is cleared

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(full))
            self._drop(full)
            self._put(merged, level + 1)

    def _merged(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "m").hint("merge")
            out = out.join(other, ["h", "g"], "full_outer").select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def add(self, keys: DataFrame) -> None:
        """keys: h, g for each document and key of a batch of documents that no batch before had."""
        counts = keys.groupBy("h", "g").agg(F.count("*").alias("n"))
        for name in (x for level in self.levels for x in level):
            settled = self.spark.table(name).filter(F.col("n") >= self.enough).select("h", "g")
            counts = counts.join(settled.hint("merge"), ["h", "g"], "left_anti")
        self._put(self._write(counts), 0)

    def often(self) -> DataFrame:
        """h, g, n of the keys in enough documents; n leaves out what came after a key was settled."""
        names = [x for level in self.levels for x in level]
        return self._merged(names).filter(F.col("n") >= self.enough) if names else self.spark.createDataFrame([], "h long, g long, n long")

    def close(self) -> None:
        self._drop([x for level in self.levels for x in level])
        self.levels = []


def _documents_once(keys: DataFrame, docs: DataFrame, scratch: common.Scratch, id_col: str, text_col: str) -> DataFrame:
    """keys, with those of rows repeated with id and text only once for all of them."""
    again = scratch.keep(docs.select(*common.doc_keys(id_col, text_col)).groupBy("_d", "_k").count().filter("count > 1").select("_d", "_k"), "again")
    n = again.count()
    if not n:
        return keys
    few = common.broadcast_if(again, n, common.BROADCAST_KEYS)
    return keys.join(few, ["_d", "_k"], "left_anti").unionByName(keys.join(few, ["_d", "_k"], "left_semi").distinct())


def frequent(docs: DataFrame, scratch: common.Scratch, min_docs: int, min_chars: int, id_col: str, text_col: str, batches: int) -> tuple[DataFrame, DataFrame]:
    """(keys of lines with h, g, n; the keys of each row), both materialized."""
    spark, path = docs.sparkSession, f"{scratch.path}/keys"
    line_keys(docs, id_col, text_col, min_chars, batches).write.partitionBy("b").parquet(path)
    keys = spark.read.schema("_d long, _k long, h long, g long, b int").parquet(path)
    runs = Runs(scratch, min_docs)
    once = _documents_once(keys, docs, scratch, id_col, text_col)
    for b in range(batches):
        runs.add(once.filter(F.col("b") == b))
    found = scratch.keep(runs.often(), "often")
    runs.close()
    return found, keys


STATS = "text string, n_lines long, n_dropped long"


def _result(texts: pa.Array, gone_of) -> pa.Array:
    """Struct of what is left, lines and dropped lines for each text. gone_of(first row, lines) says which lines go."""
    made, n_lines, n_dropped = [], [], []
    for lo, off, data in common.text_blocks(texts):
        at = lines(data, off)
        gone = gone_of(lo, at)
        left, ends = keep(data, off, at, gone)
        made.append(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(left)).cast(pa.string()))
        n_lines.append(np.bincount(at.doc, minlength=len(off) - 1))
        n_dropped.append(np.bincount(at.doc[gone], minlength=len(off) - 1))
    text = pa.concat_arrays(made) if made else pa.array([], pa.string())
    counts = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n_lines, n_dropped)]
    return pa.StructArray.from_arrays([text, *counts], names=["text", "n_lines", "n_dropped"])


def _known(spark: SparkSession, found: DataFrame):
    """Broadcast of the keys' two hashes, ordered by the first."""
    t = found.select("h", "g").toArrow()
    h, g = (t.column(c).to_numpy() for c in ("h", "g"))
    order = np.lexsort((g, h))
    return spark.sparkContext.broadcast((h[order], g[order]))


def _is_known(h: np.ndarray, g: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs are among the known ones, which are sorted; of one first hash there may be several."""
    a, b = known
    at, out = np.searchsorted(a, h), np.zeros(len(h), bool)
    open_ = np.arange(len(h))
    while len(open_):
        open_ = open_[at[open_] < len(a)]
        open_ = open_[a[at[open_]] == h[open_]]
        out[open_] |= b[at[open_]] == g[open_]
        at[open_] += 1
    return out


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs as _row with text (what is left), n_lines and n_dropped: lines whose key, of min_chars code points or more, is in min_docs
    documents or more go, in every document.

    The key is the line without ASCII space at its ends and with A-Z lower-cased; keys are compared by 128 bits of hash. Null and
    empty texts are one empty line. Rows repeated with id and text are one document and are treated alike; rows with one id and other
    texts are documents of their own. An empty table gives no rows; extra columns pass through in _row.

    Counting: distinct keys of each row are written once, then added batch by batch to levelled sorted runs (see Runs), counted within
    tasks before they are dealt out. The keys to drop are broadcast if at most BROADCAST_LINES, counted, and else joined with the rows'
    keys, hot ones apart, and by document with the texts.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    scratch = common.Scratch(spark, "lines")
    found, keys = frequent(docs, scratch, min_docs, min_chars, id_col, text_col, batches)
    text = F.col(f"_row.`{text_col}`")
    if found.count() <= BROADCAST_LINES:
        known = _known(spark, found)

        @F.arrow_udf(STATS)
        def cut(texts: pa.Array) -> pa.Array:
            return _result(texts, lambda lo, at: (at.chars >= min_chars) & _is_known(at.h, at.g, known.value))

        return common.packed(docs).withColumn("_cut", cut(text)).select("_row", "_cut.*")
    total = keys.count()
    by_row = common.join_counted(keys.select("_d", "_k", "h", "g"), found.withColumnRenamed("n", "c"), ["h", "g"], total)
    gone = by_row.groupBy("_d", "_k").agg(F.sort_array(F.collect_set(F.struct("h", "g"))).alias("_gone"))

    @F.arrow_udf(STATS)
    def cut_listed(texts: pa.Array, h: pa.Array, g: pa.Array) -> pa.Array:
        none = np.zeros(0, np.int64)
        known = [(none, none) if not x.is_valid else (x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(h, g, strict=True)]

        def gone_of(lo: int, at: Lines) -> np.ndarray:
            out, edge = np.zeros(len(at.doc), bool), np.searchsorted(at.doc, np.arange(at.doc[-1] + 2))
            for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                out[a:b] = _is_known(at.h[a:b], at.g[a:b], known[lo + i])
            return out & (at.chars >= min_chars)

        return _result(texts, gone_of)

    marked = common.packed(docs, *common.doc_keys(id_col, text_col)).join(gone.hint("merge"), ["_d", "_k"], "left")
    return marked.withColumn("_cut", cut_listed(text, F.col("_gone.h"), F.col("_gone.g"))).select("_row", "_cut.*")


def remove_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, columns unchanged, without the lines that dedup drops; texts that lose none, null ones too, stay as they are."""
    out = dedup(docs, min_docs, min_chars, id_col, text_col)
    return common.unpacked(out, docs, **{text_col: F.when(F.col("n_dropped") == 0, F.col(f"_row.`{text_col}`")).otherwise(F.col("text"))})
