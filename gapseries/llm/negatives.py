"""Hard-negative mining: blocks of anchors against all rows by dense matrix products, exact in whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Anchors of one broadcast block, and numbers in their vectors (8 bytes each).
BLOCK_ANCHORS, BLOCK_NUMBERS = 16_384, 4 << 20
#: Rows that meet anchors at once: few at first, so that the ranks' floors are soon known, then more.
FIRST_ROWS, MOST_ROWS = 64, 4_096
#: Scores that are looked at at once.
TILE = 1 << 20
#: Below the first, sums in float64 are exact; below the second, whole numbers of 64 bits hold a hundred times a score.
EXACT, MOST = 2.0**53, 2.0**56
_LEAST = np.iinfo(np.int64).min


def quantised(ids: pa.Array, labels: pa.Array, vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and floor(scale * x) of the rows that take part; shorter vectors are continued by zeros."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    size = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    x = vectors.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(size)))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    good = (bad[start[1:]] == bad[start[:-1]]) & np.array(vectors.is_valid()) & np.array(ids.is_valid()) & np.array(labels.is_valid())
    rows = np.flatnonzero(good)
    width = int(size[rows].max(initial=0))
    if len(rows) == len(size) and (size == width).all():
        m = np.floor(scale * x).reshape(len(rows), width)
    else:
        m = np.zeros((len(rows), width))
        for k, r in enumerate(rows):
            m[k, : size[r]] = np.floor(scale * x[start[r] : start[r + 1]])
    return ids.fill_null(0).to_numpy()[rows], labels.fill_null(0).to_numpy()[rows], m


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact: no partial sum is over the product of the norms."""
    d = min(a.shape[1], b.shape[1])
    most = np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0)) * (1 + 1e-9)
    if most < EXACT:
        return (a[:, :d] @ b[:, :d].T).astype(np.int64)
    if most < MOST:
        return a[:, :d].astype(np.int64) @ b[:, :d].astype(np.int64).T
    raise ValueError("vectors too long: scores of 2^56 and more are not supported")


class Best:
    """The first k by score (high first), then id, for each of n keys, out of parts that come in any order. An id and score that come
    again for a key count once. What comes is gathered, and ranked with what was kept when it has outgrown that."""

    def __init__(self, n: int, k: int):
        self.k, self.kept = k, [np.zeros(0, np.int64)] * 3
        self.floor = np.full(n, _LEAST)
        self.new: list[tuple] = []
        self.size, self.room = 0, max(4 * n, 1 << 14)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((key, score, ids))
        self.size += len(key)
        if self.size > self.room:
            self.rank()

    def rank(self) -> list[np.ndarray]:
        key, score, ids = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        key, score, ids = key[new], score[new], ids[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        at = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        full = at == self.k - 1
        self.floor[key[full]] = score[full]
        self.kept, self.new, self.size = [x[at < self.k] for x in (key, score, ids)], [], 0
        return self.kept


def chunks(batches, scale: float):
    """(ids, labels, matrix) of rows put together to FIRST_ROWS, then twice as many each time up to MOST_ROWS."""
    held, n, want = [], 0, FIRST_ROWS
    for b in batches:
        ids, labels, m = quantised(b.column(0), b.column(1), b.column(2), scale)
        at = 0
        while at < len(ids):
            take = min(want - n, len(ids) - at)
            held.append((ids[at : at + take], labels[at : at + take], m[at : at + take]))
            n, at = n + take, at + take
            if n == want:
                yield _joined(held)
                held, n, want = [], 0, min(2 * want, MOST_ROWS)
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(m.shape[1] for _, _, m in held)
    padded = [m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, _, m in held]
    return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate(padded)


def _tiles(n: int, rows: int):
    step = max(1, TILE // max(rows, 1))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


PART = "a long, j int, id long, score long"


def _batch(a, j, ids, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(j, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["a", "j", "id", "score"])


def _first(parts: DataFrame, k: int) -> DataFrame:
    """Of the tasks' ranks those of all rows: a, j, id, score, rank; Spark keeps the first k of each task before it deals them out."""
    w = Window.partitionBy("a", "j").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k).distinct()


def positives(rows: DataFrame, block, k: int, scale: float) -> DataFrame:
    """a, id, score, rank: of each anchor of the block its first k rows of the same label and another id."""

    def run(batches):
        ids, labels, m = block.value[:3]  # anchors by label
        best = Best(len(ids), k)
        for cid, clabel, c in chunks(batches, scale):
            order = np.argsort(clabel, kind="stable")
            cid, clabel, c = cid[order], clabel[order], c[order]
            kinds, first = np.unique(clabel, return_index=True)
            for kind, lo, hi in zip(kinds, first, np.append(first[1:], len(clabel)), strict=True):
                x, y = np.searchsorted(labels, [kind, kind + 1])
                for t in _tiles(y - x, hi - lo):
                    t = slice(t.start + x, t.stop + x)
                    s = products(m[t], c[lo:hi])
                    r, at = np.nonzero(s >= best.floor[t, None])
                    r, at, score = r + t.start, at + lo, s[r, at]
                    use = cid[at] != ids[r]
                    best.add(r[use], score[use], cid[at][use])
        r, score, got = best.rank()
        yield _batch(r, np.zeros(len(r), np.int32), got, score)

    return _first(rows.mapInArrow(common.lean(run), PART), k).drop("j")


def negatives(rows: DataFrame, block, k: int, low: int, high: int, scale: float) -> DataFrame:
    """a, j, id, score, rank: for each anchor and its j-th positive the first k rows of other labels with a score of low to high
    hundredths of the positive's. block holds for each anchor the least and greatest such score by positive (least above greatest:
    none)."""

    def run(batches):
        _, labels, m, least, most = block.value
        n, p = least.shape
        best = Best(n * p, k)
        for cid, clabel, c in chunks(batches, scale):
            for t in _tiles(n, len(cid)):
                s = products(m[t], c)
                lo = np.maximum(least[t], best.floor.reshape(n, p)[t])
                hi = most[t]
                open_ = lo <= hi
                from_ = np.where(open_, lo, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                to = np.where(open_, hi, _LEAST).max(1, initial=_LEAST)
                r, at = np.nonzero((s >= from_[:, None]) & (s <= to[:, None]) & (labels[t, None] != clabel))
                score = s[r, at]
                for j in range(p):
                    use = (score >= lo[r, j]) & (score <= hi[r, j])
                    best.add((r[use] + t.start) * p + j, score[use], cid[at[use]])
        key, score, got = best.rank()
        yield _batch(key // max(p, 1), key % max(p, 1), got, score)

    return _first(rows.mapInArrow(common.lean(run), PART), k)


def mine(rows: DataFrame, anchor: Column, k_positives: int = 5, k_negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows where the condition holds) and
    each of its first k_positives rows of the same label, the first k_negatives rows of other labels that satisfy
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, ties by smaller id.

    Components become floor(scale * x), and scores are exact inner products; vectors so long that one could reach 2^56 raise an error.
    Rows with a null id, label or vector, or a null or infinite component or NaN, take no part. Shorter vectors count as continued by
    zeros, so an empty one scores 0 with all. Rows of one id and one score count once for an anchor; so do rows repeated whole, as
    anchors too. Rows of one id with other vectors are rows of their own, but never an anchor's own positives. No rows, or no anchors,
    give no rows. Extra columns are not read.

    Anchors are dealt into blocks of bounded size. For each block two passes over all rows: a task multiplies the broadcast block with
    its rows, chunk by chunk, and hands on its first ranks for each anchor; those of all tasks are then ranked. So what is shuffled
    does not depend on labels or on how many rows are alike. Blocks follow each other; each one's results are written to the shared
    folder, so a lost executor costs tasks only.
    """
    spark = rows.sparkSession
    common.bound_batches(spark)
    scratch = common.Scratch(spark, "negatives")
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), anchor.alias("anchor"))
    every = plain.select("id", "label", "v")

    def whole(batches):
        for b in batches:
            ids, labels, m = quantised(b.column(0), b.column(1), b.column(2), scale)
            used = (m != 0) * np.arange(1, m.shape[1] + 1)
            width = used.max(1, initial=0)  # zeros at the end say nothing, and depend on the batch
            q = m[np.arange(m.shape[1]) < width[:, None]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), common.list_array(q, width, pa.float64())], names=["id", "label", "q"])

    anchors = scratch.keep(plain.filter("anchor").select("id", "label", "v").mapInArrow(common.lean(whole), "id long, label long, q array<double>").distinct(), "anchors")
    count, numbers = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n_blocks = max(-(-count // block_anchors), -(-numbers // BLOCK_NUMBERS))
    path = f"{scratch.path}/blocks"
    anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "q"), F.lit(n_blocks)).cast("int")).write.partitionBy("block").parquet(path)
    blocks = spark.read.schema("id long, label long, q array<double>, block int").parquet(path)
    for i in range(n_blocks):
        t = blocks.filter(F.col("block") == i).select("id", "label", "q").toArrow().combine_chunks()
        ids, labels, m = quantised(*(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in t.columns), 1.0)
        order = np.lexsort((ids, labels))
        ids, labels, m = ids[order], labels[order], m[order]
        block = spark.sparkContext.broadcast((ids, labels, m))
        first = positives(every, block, k_positives, scale).select("a", "rank", "id", "score").toArrow()  # k_positives rows an anchor
        a, j, pid, score = (first.column(c).to_numpy() for c in ("a", "rank", "id", "score"))
        block.destroy()
        least, most, p_id, p_score = (np.full((len(ids), k_positives), v, np.int64) for v in (1, 0, 0, 0))
        at = (a, j - 1)
        p_id[at], p_score[at], least[at], most[at] = pid, score, -((-low * score) // 100), (high * score) // 100
        block = spark.sparkContext.broadcast((ids, labels, m, least, most))
        found = negatives(every, block, k_negatives, low, high, scale)
        names = spark.createDataFrame(pa.table({"a": a, "j": (j - 1).astype(np.int32), "anchor_id": ids[a], "positive_id": pid, "positive_score": score}))
        out = found.join(F.broadcast(names), ["a", "j"])
        out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(f"{scratch.path}/found")
        block.destroy()
    return spark.read.parquet(f"{scratch.path}/found")
