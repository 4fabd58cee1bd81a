"""Benchmark decontamination by winnowing: shared spans are found by sampled fingerprints and then extended exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW_WORDS, GRAM_WORDS = 10, 5
#: Benchmark fingerprints up to this number are broadcast as a lookup; beyond it all fingerprints are joined by shuffle.
LOOKUP_FINGERPRINTS, BROADCAST_WINDOWS = 2_000_000, 100_000

_FOUND = "_d long, _k long, n_words long, fps array<long>, starts array<int>, sizes array<int>, h1 array<long>, h2 array<long>"


def _winnow(w: common.Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the rightmost least k-gram of every run of window words that lies in one text.

    Equal runs choose equally, so any two texts that share a run of window words share a chosen gram in it.
    """
    at = w.whole(window)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    g = w.grams(k)
    best, pos = g[at], at.copy()
    for j in range(1, window - k + 1):
        x = g[at + j]
        less = x <= best
        best = np.where(less, x, best)
        pos[less] = at[less] + j
    pos = np.unique(pos)
    return pos, g[pos]


def _windows(items: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """item, size, h1, h2 of every window of every item, and the fingerprint within it (null for items shorter than a window)."""

    def run(batches):
        for b in batches:
            for lo, off, data in common.text_blocks(b.column(1)):
                w = common.Words(data, off, common.ALNUM_BYTES)
                at = w.whole(window)
                parts = []
                if len(at):
                    g = w.grams(k)
                    fp = np.min(np.stack([g[at + j] for j in range(window - k + 1)]), axis=0)
                    parts.append((w.doc[at], np.full(len(at), window), at, fp))
                for n in range(1, window):
                    if len(short := np.flatnonzero(w.count == n)):
                        parts.append((short, np.full(len(short), n), w.first[short], np.zeros(len(short), np.uint64)))
                for doc, size, at, fp in parts:
                    n = int(size[0])
                    ids = b.column(0).take(pa.array(lo + doc))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.array(w.grams(n, at=at).view(np.int64)), pa.array(w.grams(n, common.GRAM2, at).view(np.int64)), pa.array(fp.view(np.int64), mask=size < window)], names=["item", "size", "h1", "h2", "fp"])

    return items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("_t")).mapInArrow(common.lean(run), "item long, size int, h1 long, h2 long, fp long")


def _candidates(docs: DataFrame, keys: list[Column], text_col: str, window: int, k: int, sizes: list[int], lookup) -> DataFrame:
    """A row for each text: its number of words and the windows around its fingerprints that lookup holds (all if None)."""

    def run(batches):
        known = lookup.value if lookup is not None else None
        for b in batches:
            for lo, off, data in common.text_blocks(b.column(2)):
                w = common.Words(data, off, common.ALNUM_BYTES)
                parts = []
                if window in sizes:
                    pos, fp = _winnow(w, k, window)
                    if known is not None and len(pos):
                        keep = known[0][(fp & np.uint64(len(known[0]) - 1)).astype(np.int64)]
                        pos, fp = pos[keep], fp[keep]
                        keep = known[1][np.minimum(np.searchsorted(known[1], fp), len(known[1]) - 1)] == fp
                        pos, fp = pos[keep], fp[keep]
                    if len(pos):
                        start = (pos[:, None] - np.arange(window - k, -1, -1)[None, :]).ravel()
                        of, fps = np.repeat(w.doc[pos], window - k + 1), np.repeat(fp, window - k + 1)
                        ok = (start >= w.first[of]) & (start + window <= w.first[of] + w.count[of])
                        start, fps = start[ok], fps[ok]
                        parts.append((start, np.full(len(start), window), fps))
                for n in sizes:
                    if n < window and len(at := w.whole(n)):
                        h = w.grams(n, at=at)
                        if known is not None:
                            keep = known[2][np.minimum(np.searchsorted(known[2], h), len(known[2]) - 1)] == h
                            at = at[keep]
                        parts.append((at, np.full(len(at), n), np.zeros(len(at), np.uint64)))
                start, size, fps = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
                order = np.argsort(w.doc[start], kind="stable") if len(start) else start
                start, size, fps = start[order], size[order], fps[order].astype(np.uint64)
                h1, h2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
                for n in np.unique(size):
                    i = np.flatnonzero(size == n)
                    h1[i], h2[i] = w.grams(int(n), at=start[i]), w.grams(int(n), common.GRAM2, start[i])
                counts = np.bincount(w.doc[start], minlength=w.docs) if len(start) else np.zeros(w.docs, np.int64)
                lists = [common.list_array(v, counts, t) for v, t in ((fps.view(np.int64), pa.int64()), (start - w.first[w.doc[start]] if len(start) else start, pa.int32()), (size, pa.int32()), (h1.view(np.int64), pa.int64()), (h2.view(np.int64), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, w.docs), b.column(1).slice(lo, w.docs), pa.array(w.count, pa.int64()), *lists], names=["_d", "_k", "n_words", "fps", "starts", "sizes", "h1", "h2"])

    return docs.select(*keys, F.col(text_col).alias("_t")).mapInArrow(common.lean(run), _FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, k: int = GRAM_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, covers, items): every text with its number of words, its hit spans, and the items it holds.

    Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z. An item's windows are its runs of
    window words, or all of it if it is shorter; one without words has none. Each text keeps the least k-gram of every run of
    window words; those fingerprints are joined with the benchmark's and the hits extended to whole windows, compared by 128 bits.
    documents: _d, _k (identity), n_words. covers: _d, _k, start, size. items: _d, _k, item (distinct; a null item_id counts for
    hits only). Null texts have no words. Repeated rows are one document. Empty tables give empty results.
    """
    spark = docs.sparkSession
    bench = common.materialize(_windows(benchmark, item_col, item_text_col, window, k), "bench")
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # at most window values
    prints = bench.filter("fp is not null").select("fp").distinct()
    short = bench.filter("fp is null").select(F.col("h1").alias("fp")).distinct()
    n = prints.count() + short.count()
    lookup = None
    if n <= LOOKUP_FINGERPRINTS:
        value = [np.array([r[0] for r in x.collect()] or [0], np.int64).view(np.uint64) for x in (prints, short)]
        bits = np.zeros(1 << max(16, int(4 * n).bit_length()), bool)
        bits[(value[0] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        lookup = spark.sparkContext.broadcast((bits, np.sort(value[0]), np.sort(value[1])))
    found = common.materialize(_candidates(docs, common.doc_keys(id_col, text_col), text_col, window, k, sizes, lookup), "fingerprints")
    cand = found.filter(F.size("starts") > 0).select("_d", "_k", F.explode(F.arrays_zip("fps", "starts", "sizes", "h1", "h2")).alias("c")).select("_d", "_k", "c.fps", F.col("c.starts").alias("start"), F.col("c.sizes").alias("size"), "c.h1", "c.h2")
    shared = cand.filter(F.col("size") == window).join(common.broadcast_if(prints, n, BROADCAST_WINDOWS), F.col("fps") == F.col("fp"), "left_semi").unionByName(cand.filter(F.col("size") < window)).drop("fps")
    of = bench.groupBy("size", "h1", "h2").agg(F.collect_set("item").alias("items"))
    hits = shared.join(common.broadcast_if(of, n, BROADCAST_WINDOWS), ["size", "h1", "h2"]).select("_d", "_k", "start", "size", "items")
    hits = common.materialize(hits, "hits")
    return found.select("_d", "_k", "n_words"), hits.select("_d", "_k", "start", "size").distinct(), hits.select("_d", "_k", F.explode("items").alias("item")).distinct()


def summarize(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of docs: its id, n_words, n_hit, n_items, items_sha256, contaminated."""
    base, covers, items = contamination(docs, benchmark, id_col, text_col, **options)
    before = Window.partitionBy("_d", "_k").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    hit = covers.select("_d", "_k", new.alias("new")).groupBy("_d", "_k").agg(F.sum("new").cast("long").alias("n_hit"))
    own = items.groupBy("_d", "_k").agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("_items"))
    both = hit.join(own, ["_d", "_k"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(both, ["_d", "_k"], "left").select(
        F.when(F.col("_d") != common.NO_ID, F.col("_d")).alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("_items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, columns unchanged, that hold no window of any item."""
    _, covers, _ = contamination(docs, benchmark, id_col, text_col, **options)
    return common.without(docs, covers.select("_d", "_k").distinct(), common.doc_keys(id_col, text_col))
