"""Suffix-array dedup: byte strings of a given length that start earlier elsewhere are removed.

Suffixes are sorted where it matters only: every string of `length` bytes holds an anchor (the last of its least 16-byte hashes),
equal strings the same one, so suffixes that begin at anchors show every repeat, with the bytes before them told apart by a
left context. Tasks sort their suffixes, front-code them (shared length, then the rest) and deal them out by ranges of the
alphabet; each range merges its sorted runs with a loser tree that compares shared lengths first and bytes only beyond them.
Grams too frequent for one task do not meet in one: their strings are dealt out one by one, by hash, and the first is aggregated.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM_BYTES = 100, 16
#: Suffixes that a merge aims at; the most ranges, and the sample (documents, about) that sets their bounds. A range is sliced by
#: gram where more merges are due. All of it steers the exchange only.
RANGE_SUFFIXES, RANGES, SAMPLE_DOCS = 40_000, 1024, 1000
#: Places of one gram up to which they are merged in one task.
GRAM_PLACES = 40_000
#: Bytes of a long text that one numpy pass looks at.
STRETCH = 1 << 20
#: Distinct contexts of one gram up to which pairs are compared directly.
_PAIRS = 24
_ROW = struct.Struct("<qqqIII")
_SHIFT = np.uint64(28)


def anchored(data: np.ndarray, off: np.ndarray, length: int = LENGTH, stretch: int = STRETCH):
    """(start, anchor, hash of the gram there) of all strings of length bytes within the texts, a stretch of starts at a time.
    Anchors and hashes do not depend on where stretches begin."""
    w = length - GRAM_BYTES + 1
    for lo in range(0, max(len(data) - length + 1, 0), stretch):
        part = data[lo : lo + stretch + length - 1]
        n = len(part)
        up, down = common.powers(n + 1)
        with np.errstate(over="ignore"):
            p = np.zeros(n + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=p[1:])
            h = common.mix((p[GRAM_BYTES:] - p[:-GRAM_BYTES]) * down[: n - GRAM_BYTES + 1])
        at = np.arange(len(h), dtype=np.uint64)
        v = ((h >> _SHIFT) << _SHIFT) | ((np.uint64(1) << _SHIFT) - np.uint64(1) - at)
        m, span = v, 1
        while span * 2 <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        m = np.minimum(m[: len(v) - w + 1], m[w - span : w - span + len(v) - w + 1])
        start = np.arange(lo, lo + len(m))
        inside = start + length <= off[np.searchsorted(off, start, side="right")]
        pos = ((np.uint64(1) << _SHIFT) - np.uint64(1) - (m[inside] & ((np.uint64(1) << _SHIFT) - np.uint64(1)))).astype(np.int64)
        yield start[inside], pos + lo, h[pos]


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, byte in the block, hash of the gram there) of the anchors of all strings of length bytes within the texts."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for _, pos, h in anchored(data, off, length, stretch):
        at, first = np.unique(pos, return_index=True)
        found.append((at, h[first]))
    pos, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    return np.searchsorted(off, pos, side="right") - 1, pos, np.concatenate([f[1] for f in found])[first]


def _digests(data: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Two 64-bit hashes of the length bytes from each start."""
    lo, hi = int(start[0]), int(start[-1]) + length
    part, at = data[lo:hi], start - lo
    up, down = common.powers(len(part) + 1)
    out = []
    for values in (common.BYTE_CASED, common.mix(common.BYTE_CASED)):
        with np.errstate(over="ignore"):
            p = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * up[: len(part)], out=p[1:])
            out.append(common.mix((p[at + length] - p[at]) * down[at]).view(np.int64))
    return out


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, at least at being known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    lo, hi = at, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_code(suffixes: list[tuple[bytes, int, int, int, bytes]]) -> bytes:
    """Sorted (suffix, d, k, position, left context reversed) as shared length with the one before and the rest."""
    out, last = [], b""
    for s, d, k, at, left in suffixes:
        n = shared(last, s)
        out += (_ROW.pack(d, k, at, n, len(s) - n, len(left)), s[n:], left)
        last = s
    return b"".join(out)


def unfold(run: bytes):
    """(shared length with the one before, suffix, d, k, position, left context) in order."""
    at, last = 0, b""
    while at < len(run):
        d, k, pos, n, rest, left = _ROW.unpack_from(run, at)
        at += _ROW.size
        last = last[:n] + run[at : at + rest]
        at += rest
        yield n, last, d, k, pos, run[at : at + left]
        at += left


class LoserTree:
    """Merges sorted runs. Each loser keeps how long a prefix it shares with the one that beat it, which is all that the next
    winner's way up needs: of two rivals the one that shares more with the last output is less, and bytes are read only where
    both share alike, from there on."""

    def __init__(self, runs: list[bytes]):
        self.runs = [unfold(r) for r in runs]
        size = 1
        while size < len(self.runs):
            size *= 2
        self.size = size
        self.loser: list = [None] * size  # (shared length with the winner at that match, run, item)
        entries = [self._next(i) if i < len(self.runs) else None for i in range(size)]
        level = [None if e is None else (0, i, e) for i, e in enumerate(entries)]
        node = size // 2
        while len(level) > 1:
            new = []
            for j in range(0, len(level), 2):
                win, lose = self._match(level[j], level[j + 1])
                self.loser[node + j // 2] = lose
                new.append(win)
            level, node = new, node // 2
        self.top = level[0] if level else None

    def _next(self, i: int):
        return next(self.runs[i], None)

    @staticmethod
    def _match(a, b):
        """(winner, loser); both hold shared lengths with the same last output."""
        if b is None:
            return a, b
        if a is None:
            return b, a
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        x, y = a[2], b[2]
        n = shared(x[1], y[1], a[0])
        less = (x[1][n : n + 1], x[2:5]) <= (y[1][n : n + 1], y[2:5]) if n < max(len(x[1]), len(y[1])) else x[2:5] <= y[2:5]
        win, lose = (a, b) if less else (b, a)
        return win, (n, lose[1], lose[2])

    def __iter__(self):
        """(shared length with the suffix before, suffix, d, k, position, left context) of all runs in order."""
        while self.top is not None:
            n, i, item = self.top
            yield (n, *item[1:])
            nxt = self._next(i)
            up = None if nxt is None else (nxt[0], i, nxt)
            node = (self.size + i) // 2
            while node >= 1:
                up, self.loser[node] = self._match(up, self.loser[node])
                node //= 2
            self.top = up


def repeats(group: list[tuple], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(d, k, from, to) of the bytes around each member's anchor that lie in strings with an earlier member's start.

    group: (shared length with the one before, suffix, d, k, position, left) of suffixes that share their gram, sorted.
    """
    out, first = [], {}
    for m in sorted(group, key=lambda m: m[2:5]):
        own = (m[1], m[5])
        if own in first:
            if first[own][2:5] != m[2:5] and len(m[1]) + len(m[5]) >= length:  # a repeated row sends the same place again
                out.append((m[2], m[3], m[4] - len(m[5]), m[4] + len(m[1])))
        else:
            first[own] = m
    some = list(first.values())  # by position
    if len(some) <= _PAIRS:
        for j in range(1, len(some)):
            q, lo, hi = some[j], 0, 0
            for p in some[:j]:
                r = shared(p[1], q[1])
                if r + len(q[5]) >= length and r + (left := shared(p[5], q[5])) >= length:
                    lo, hi = max(lo, left), max(hi, r)
            if hi:
                out.append((q[2], q[3], q[4] - lo, q[4] + hi))
        return out
    n = len(some)
    sides = []
    for side in (1, 5):  # places in sorted order, shared length with the one before there, own length
        order = sorted(range(n), key=lambda i: some[i][side])
        lcp = np.array([0] + [shared(some[a][side], some[b][side]) for a, b in zip(order, order[1:], strict=False)])
        sides.append((np.array(order), lcp, np.array([len(m[side]) for m in some])))
    lo, hi = np.full(n, -1), np.full(n, -1)
    for i in range(length - GRAM_BYTES + 1):
        ids, whole = [], np.ones(n, bool)
        for (order, lcp, size), need in zip(sides, (length - i, i), strict=True):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(lcp < need) if need else 0
            ids.append(c)
            whole &= size >= need
        _, at, inverse = np.unique(ids[0] * (n + 1) + ids[1], return_index=True, return_inverse=True)
        again = whole & (at[inverse] != np.arange(n))
        lo[again] = i
        hi[again & (hi < 0)] = length - i
    return out + [(some[j][2], some[j][3], some[j][4] - int(lo[j]), some[j][4] + int(hi[j])) for j in np.flatnonzero(lo >= 0)]


def _suffix_runs(docs: DataFrame, lookup, often, bounds: list[int], slices: int, length: int) -> DataFrame:
    """part, run: of each stretch of texts, the front-coded suffixes at anchors whose gram may occur again, but not often."""
    before = length - GRAM_BYTES

    def run(batches):
        for b in batches:
            parts: dict[int, list] = {}
            size = 0
            for lo, off, data in common.text_blocks(b.column(2)):
                doc, pos, h = anchors(data, off, length)
                keep = common.may_hold(lookup, h.view(np.int64))
                if often is not None:
                    keep &= ~common.may_hold(often, h.view(np.int64))
                if keep.any():
                    raw = data.tobytes()
                    ids, keys = b.column(0).slice(lo, len(off) - 1).to_pylist(), b.column(1).slice(lo, len(off) - 1).to_pylist()
                    for t, at, nth in zip(doc[keep].tolist(), pos[keep].tolist(), (h[keep] % np.uint64(slices)).tolist(), strict=True):
                        s = raw[at : min(at + length, int(off[t + 1]))]
                        part = bisect_right(bounds, int.from_bytes(s[:8], "big")) * slices + nth
                        parts.setdefault(part, []).append((s, ids[t], keys[t], at - int(off[t]), raw[max(at - before, int(off[t])) : at][::-1]))
                        size += 1
                if size > 50_000:
                    yield out(parts)
                    parts, size = {}, 0
            if parts:
                yield out(parts)

    def out(parts):
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([front_code(sorted(v)) for v in parts.values()], pa.binary())], names=["part", "run"])

    return docs.mapInArrow(common.lean(run), "part long, run binary")


def _merge(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    out, group = [], []
    for m in LoserTree(list(pdf["run"])):
        if group and m[0] < GRAM_BYTES:
            if len(group) > 1:
                out += repeats(group, length)
            group = []
        group.append(m)
    if len(group) > 1:
        out += repeats(group, length)
    return pd.DataFrame(out, columns=["_d", "_k", "start", "stop"]).astype("int64")


def _frequent(docs: DataFrame, often, length: int) -> DataFrame:
    """_d, _k, start, stop of the bytes in strings that start earlier, for the strings whose anchor's gram is frequent.

    Each string is a row of its place and 128 bits of hash; the first place of each is aggregated, within tasks first, and a string
    that is everywhere is joined by broadcast, so no task holds what shares a gram. Strings that follow each other make one span.
    """

    def run(batches):
        for b in batches:
            for lo, off, data in common.text_blocks(b.column(2)):
                for start, _, h in anchored(data, off, length):
                    start = start[common.may_hold(often, h.view(np.int64))]
                    if len(start):
                        doc = np.searchsorted(off, start, side="right") - 1
                        row = pa.array(doc + lo)
                        cols = [pa.array(x) for x in (start - off[doc], *_digests(data, start, length))]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), *cols], names=["_d", "_k", "start", "h1", "h2"])

    strings = common.materialize(docs.mapInArrow(common.lean(run), "_d long, _k long, start long, h1 long, h2 long"), "strings")
    place = F.struct("_d", "_k", "start")
    firsts = common.materialize(strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1"), "firsts")
    later = common.join_counted(strings, firsts, ["h1", "h2"], strings.count()).filter(place != F.col("first"))
    rank = F.dense_rank().over(Window.partitionBy("_d", "_k").orderBy("start"))
    stretch = later.select("_d", "_k", "start", (F.col("start") - rank).alias("g")).groupBy("_d", "_k", "g")
    return stretch.agg(F.min("start").alias("start"), (F.max("start") + length).alias("stop")).drop("g")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(copies, spans): documents whose text another with a smaller id has too, as _d, _k; and _d, _k, start, stop of bytes of the
    other documents that lie in strings of length bytes with an earlier start. Spans overlap."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)).alias("_d"), F.xxhash64(text).alias("_k"), text.alias("_t")).filter(F.octet_length("_t") >= length)
    named = common.materialize(base.select("_d", "_k", F.md5(F.col("_t").cast("binary")).alias("m")), "named")
    firsts = common.materialize(named.groupBy("m").agg(F.min("_d").alias("f"), F.count("*").alias("c")).filter("c > 1"), "firsts")
    copies = common.materialize(common.join_counted(named, firsts, ["m"], texts := named.count()).filter("_d <> f").select("_d", "_k").distinct(), "copies")
    own = base.join(common.broadcast_if(copies, n := copies.count(), common.BROADCAST_KEYS), ["_d", "_k"], "left_anti")

    def grams(batches):
        for b in batches:
            for _, off, data in common.text_blocks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data, off, length)[2].view(np.int64))], names=["h"])

    def heads(batches):
        for b in batches:
            for _, off, data in common.text_blocks(b.column(0)):
                pos = anchors(data, off, length)[1]
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(data[p : p + 7].tobytes(), "big") for p in pos.tolist()], pa.int64())], names=["h"])

    again = common.materialize(own.select("_t").mapInArrow(common.lean(grams), "h long").groupBy("h").count().filter("count > 1"), "grams")
    few = F.col("count") <= GRAM_PLACES
    kinds, total, frequent = again.agg(F.count("*"), F.coalesce(F.sum(F.when(few, F.col("count"))), F.lit(0)), F.count_if(~few)).first()
    often = common.key_filter(again.filter(~few), F.col("h"), frequent) if frequent else None
    parts, bounds = max(1, -(-total // RANGE_SUFFIXES)), []
    if parts > 1:
        n = min(parts, RANGES)
        seen = own.sample(min(1.0, SAMPLE_DOCS / max(1, texts)), seed=3).select("_t").mapInArrow(common.lean(heads), "h long")
        cuts = seen.agg(F.percentile_approx("h", [i / n for i in range(1, n)], 100 * n).alias("cuts")).first()["cuts"]
        bounds = sorted({h << 8 for h in cuts or ()})
    slices = -(-parts // (len(bounds) + 1))
    runs = _suffix_runs(own.select("_d", "_k", "_t"), common.key_filter(again, F.col("h"), kinds), often, bounds, slices, length)
    spans = runs.groupBy("part").applyInPandas(lambda pdf: _merge(pdf, length), "_d long, _k long, start long, stop long")
    if often is not None:
        spans = spans.unionByName(_frequent(own.select("_d", "_k", "_t"), often, length))
    return copies, common.materialize(spans, "spans")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row's _d with _kept (bytes that are left), n_bytes, n_removed, n_spans (maximal removed runs).

    Texts are UTF-8 bytes, null counts as empty. A byte goes if some string of length bytes that covers it also starts earlier: in
    a document with a smaller id, or further up in the same. All is judged on the input. Rows repeated with the same id and text
    are one document. A null id comes first; rows with one id and other texts are ordered by the texts' hash.
    """
    copies, spans = covered(docs, id_col, text_col, length)
    order = F.sort_array(F.collect_set(F.struct("start", "stop")))
    gone = spans.groupBy("_d", "_k").agg(order.alias("spans")).unionByName(copies.select("_d", "_k", F.expr("array(struct(0L AS start, 9223372036854775807L AS stop))").alias("spans")))
    gone = common.materialize(gone, "gone")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)).alias("_d"), F.xxhash64(text).alias("_k"), text.cast("binary").alias("_t"))

    def cut(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = []
                for d, t, spans in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                    kept, at, removed, runs = [], 0, 0, 0
                    for s in spans or ():
                        start, stop = s["start"], min(s["stop"], len(t))
                        if start > at or not runs:
                            kept.append(t[at:start])
                            runs += 1
                        if stop > at:
                            removed += stop - max(start, at)
                            at = stop
                    kept = b"".join(kept) + t[at:]
                    rows.append((d, kept, len(t), removed, runs))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["_d", "_kept", "n_bytes", "n_removed", "n_spans"])

    joined = base.join(gone, ["_d", "_k"], "left").select("_d", "_t", "spans")
    return joined.mapInArrow(common.lean(cut), "_d long, _kept binary, n_bytes long, n_removed long, n_spans long")


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    out = dedup(docs, id_col, text_col, length)
    return out.select(F.when(F.col("_d") != common.NO_ID, F.col("_d")).alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """What summarize returns, string by string; for tests."""
    seen, out = set(), []
    for d, t in sorted(texts):
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(s)
        runs = sum(mark[i] and not (i and mark[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    return out
