"""Gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, whole-document scores.

P(word | before) = P(class | state) * P(word | class, state). The most frequent words are in small classes with a softmax of their
own; other frequent words in classes by frequency with fixed shares; all others in one class whose shares come from a join.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, langid

#: Words with their own place in the model (seen twice or more, most frequent first): a bound on what is broadcast.
HEAD = 65_536
FINE_CLASSES, FINE_SIZE, COARSE = 24, 24, 8
HIDDEN, LANES, STEPS = 16, 512, 16
RATE, DISCOUNT = 0.01, 0.75
HELD_FOLDS = 10
#: Documents from which one set of weights is fitted before sets are averaged, tokens of a training text after which the state
#: starts anew, and documents that are scored together.
FIT_ROWS, FIT_TOKENS, SCORE_ROWS = 4096, 2048, 8192
END = np.uint64(0x9E3779B97F4A7C15)
_FINE = FINE_CLASSES * FINE_SIZE


@dataclass
class Head:
    """Sorted hashes of the head words with rank and count of each; n, v, tail mass and kinds over all training tokens."""

    hashes: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray  # by rank
    n: int
    v: int

    def __post_init__(self):
        size = len(self.counts)
        edges = np.unique(np.geomspace(_FINE, max(size, _FINE + 1), COARSE + 1).astype(int))
        self.cls = np.where(np.arange(size) < _FINE, np.arange(size) // FINE_SIZE, FINE_CLASSES + np.searchsorted(edges, np.arange(size), side="right") - 1)
        self.tail_class = FINE_CLASSES + COARSE + 1
        self.tail_n, self.tail_v = self.n - int(self.counts.sum()), self.v - size
        mass = np.bincount(self.cls, self.counts, minlength=self.tail_class + 1)
        mass[self.tail_class] += max(self.tail_n, 1)
        self.within = np.log(np.maximum(self.counts, 1) / np.maximum(mass[self.cls], 1))
        self.bias = np.log((mass + 1e-3) / mass.sum()).astype(np.float32)
        self.classes = np.append(self.cls, self.tail_class)
        self.rows = np.append(np.where(np.arange(size) < _FINE, np.arange(size), _FINE + self.cls - FINE_CLASSES), _FINE + self.tail_class - FINE_CLASSES)

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Rank of each hash, -1 if it is no head word."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, self.ranks[i], -1)

    def inputs(self, rank: np.ndarray) -> np.ndarray:
        """Input row of each rank: its own if among the most frequent, else its class's."""
        return self.rows[rank]


def start_params(head: Head) -> list[np.ndarray]:
    """Input rows by gate, recurrence, class weights and bias, weights and bias within the classes; gates are update, reset, new."""
    g, h, c = np.random.default_rng(5), HIDDEN, head.tail_class + 1
    fine = np.full(_FINE, -20.0)
    k = min(_FINE, len(head.counts))
    fine[:k] = head.within[:k]
    table = g.standard_normal((_FINE + c - FINE_CLASSES, 3 * h)) * 0.5
    recur = g.standard_normal((h, 3 * h)) * (0.5 / np.sqrt(h))
    made = [table, recur, np.zeros((h, c)), head.bias, np.zeros((FINE_CLASSES, h, FINE_SIZE)), fine.reshape(FINE_CLASSES, FINE_SIZE)]
    return [np.ascontiguousarray(x, np.float32) for x in made]


def _lanes(ranks: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, texts, first) as step x lane matrices; texts one after another in lanes of about equal length, longest lane first.

    Targets are ranks, -1 for tail words; texts is -1 where a lane has ended.
    """
    total, longest = sum(map(len, ranks)), max(map(len, ranks))
    lanes = [(0, i, []) for i in range(max(1, min(most, len(ranks), -(-total // longest))))]
    for t in sorted(range(len(ranks)), key=lambda t: -len(ranks[t])):
        n, i, own = lanes[0]
        own.append(t)
        heapq.heapreplace(lanes, (n + len(ranks[t]), i, own))
    lanes.sort(key=lambda x: -x[0])
    shape = (lanes[0][0], len(lanes))
    target, text, first = np.full(shape, -1, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, bool)
    for j, (_, _, own) in enumerate(lanes):
        at = 0
        for t in own:
            target[at : at + len(ranks[t]), j], text[at : at + len(ranks[t]), j], first[at, j] = ranks[t], t, True
            at += len(ranks[t])
    return target, text, first


def _inputs(target: np.ndarray, first: np.ndarray, head: Head, end_rank: int) -> np.ndarray:
    before = np.vstack([np.full((1, target.shape[1]), end_rank), target[:-1]])
    return head.inputs(np.where(first, end_rank, before))


def _forward(p, x, h, first):
    """(states H x steps x lanes, what backpropagation needs) of a window; all arrays have lanes last."""
    k = HIDDEN
    table = np.ascontiguousarray(p[0][x].transpose(0, 2, 1))
    u, states, kept = np.ascontiguousarray(p[1].T), np.empty((k, *x.shape), np.float32), []
    for t in range(len(x)):
        if first[t].any():
            h = h * ~first[t]
        hw = u @ h
        zr = table[t, : 2 * k] + hw[: 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n = zr[k:] * hw[2 * k :]
        n += table[t, 2 * k :]
        np.tanh(n, out=n)
        kept.append((h, zr[:k], zr[k:], n, hw[2 * k :]))
        h = n + zr[:k] * (h - n)
        states[:, t] = h
    return states, kept


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Sums over the first axis of the exponentials, which replace logits (held under 60, so no sum overflows)."""
    np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    return logits.sum(axis=0)


def _outputs(p, hs, target, head):
    """Natural-log probability of each target (tail words: of their class); classes; class softmaxes; and of the words in fine
    classes, in order of class: which they are, their bounds by class, and their softmaxes."""
    cls = head.classes[target]
    probs = p[2].T @ hs
    probs += p[3][:, None]
    own = probs[cls, np.arange(len(cls))].copy()
    total = _softmax(probs)
    out = own - np.log(total)
    probs /= total
    fine = np.flatnonzero((target >= 0) & (target < _FINE))
    fine = fine[np.argsort(target[fine].astype(np.int16), kind="stable")]
    edges = np.searchsorted(target[fine], np.arange(FINE_CLASSES + 1) * FINE_SIZE)
    states, q = np.take(hs, fine, axis=1), np.empty((FINE_SIZE, len(fine)), np.float32)
    for c in range(FINE_CLASSES):
        a, b = edges[c], edges[c + 1]
        if b > a:
            q[:, a:b] = p[4][c].T @ states[:, a:b] + p[5][c][:, None]
    own = q[target[fine] % FINE_SIZE, np.arange(len(fine))].copy()
    total = _softmax(q)
    out[fine] += own - np.log(total)
    q /= total
    coarse = np.flatnonzero(target >= _FINE)
    out[coarse] += head.within[target[coarse]]
    return out, cls, probs, fine, edges, states, q


def fit(p: list[np.ndarray], ranks: list[np.ndarray], head: Head, end_rank: int) -> tuple[list[np.ndarray], int]:
    """Parameters after one pass over the texts (Adam, windows of STEPS words, states carried between windows); tokens seen.

    Texts of over FIT_TOKENS words are learned in stretches, so that lanes stay full.
    """
    k, p = HIDDEN, [x.copy() for x in p]
    m1, m2, count, seen = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0, 0
    target, text, first = _lanes([r[i : i + FIT_TOKENS] for r in ranks for i in range(0, len(r), FIT_TOKENS)], LANES)
    x = _inputs(target, first, head, end_rank)
    h = np.zeros((k, target.shape[1]), np.float32)
    for t0 in range(0, len(target), STEPS):
        live = int((text[t0] >= 0).sum())
        tt, ff, xx = (a[t0 : t0 + STEPS, :live] for a in (target, first, x))
        on = (text[t0 : t0 + STEPS, :live] >= 0).ravel()
        hs, kept = _forward(p, xx, h[:, :live], ff)
        h = hs[:, -1]
        flat, size = hs.reshape(k, -1), int(on.sum())
        _, cls, d, fine, edges, states, q = _outputs(p, flat, tt.ravel(), head)
        scale = (on / size).astype(np.float32)
        d[cls, np.arange(len(cls))] -= 1
        d *= scale
        q[tt.ravel()[fine] % FINE_SIZE, np.arange(len(fine))] -= 1
        q *= scale[fine]
        g = [np.zeros_like(a) for a in p]
        g[2], g[3], dh = flat @ d.T, d.sum(axis=1), p[2] @ d
        back = np.zeros((k, len(fine) + 1), np.float32)
        for c in range(FINE_CLASSES):
            a, b = edges[c], edges[c + 1]
            if b > a:
                g[4][c] = states[:, a:b] @ q[:, a:b].T
                g[5][c] = q[:, a:b].sum(axis=1)
                back[:, a:b] = p[4][c] @ q[:, a:b]
        own = np.full(len(cls), len(fine))
        own[fine] = np.arange(len(fine))
        dh += np.take(back, own, axis=1)
        dh, back = dh.reshape(hs.shape), np.float32(0)
        dx, dw = np.empty((len(xx), 3 * k, live), np.float32), np.empty((3 * k, live), np.float32)
        for t in range(len(xx) - 1, -1, -1):
            h0, z, r, n, hwn = kept[t]
            dt = dh[:, t] + back
            dn = dt * (1 - z) * (1 - n * n)
            dx[t, :k] = dt * (h0 - n) * z * (1 - z)
            dx[t, k : 2 * k] = dn * hwn * r * (1 - r)
            dx[t, 2 * k :] = dn
            dw[: 2 * k] = dx[t, : 2 * k]
            dw[2 * k :] = dn * r
            g[1] += h0 @ dw.T
            back = (dt * z + p[1] @ dw) * ~ff[t]
        order = np.argsort(xx.ravel().astype(np.int16), kind="stable")
        rows = xx.ravel()[order]
        at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        g[0][rows[at]] = np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, 3 * k)[order], at, axis=0)
        count, seen = count + 1, seen + size
        norm = np.sqrt(sum(float(np.vdot(a, a)) for a in g))
        clip, fast, slow = np.float32(min(1.0, 1.0 / (norm + 1e-9))), 1 - 0.9**count, 1 - 0.99**count
        for a, b, u, v in zip(p, g, m1, m2, strict=True):
            b *= clip
            u += np.float32(0.1) * (b - u)
            v += np.float32(0.01) * (b * b - v)
            a -= np.float32(RATE / fast) * u / (np.sqrt(v / np.float32(slow)) + np.float32(1e-6))
    return p, seen


def score_texts(p: list[np.ndarray], ranks: list[np.ndarray], head: Head, end_rank: int) -> np.ndarray:
    """Log10 probability of each whole text, tail words by their class; the state is carried from its first word to its end."""
    target, text, first = _lanes(ranks, LANES)
    x = _inputs(target, first, head, end_rank)
    alive = (text >= 0).sum(axis=1)
    h, out = np.zeros((HIDDEN, target.shape[1]), np.float32), np.zeros(len(ranks))
    for t0 in range(0, len(target), STEPS):
        k = alive[t0]
        tt, own, ff, xx = (a[t0 : t0 + STEPS, :k] for a in (target, text, first, x))
        hs, _ = _forward(p, xx, h[:, :k], ff)
        h = hs[:, -1]
        own = own.ravel()
        logp = _outputs(p, hs.reshape(HIDDEN, -1), tt.ravel(), head)[0]
        out += np.bincount(own + 1, logp, minlength=len(ranks) + 1)[1:]
    return out / np.log(10)


def _tokens(column: pa.Array):
    """(first row, number of rows, hash of every token, text of every token): the words of each text and then one END."""
    for lo, off, data in common.text_blocks(column, 4 * common.BLOCK_BYTES):
        w = common.Words(data, off, common.WORD_BYTES)
        n = len(off) - 1
        text = np.concatenate([w.doc, np.arange(n)])
        order = np.argsort(text, kind="stable")
        yield lo, n, np.concatenate([w.hash, np.full(n, END)])[order], text[order]


def _by_text(rank: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(rank, np.cumsum(np.bincount(text, minlength=n))[:-1])


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """h, c: how often each token occurs; added up within tasks first."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                all_h = [h for _, _, h, _ in _tokens(b.column(0).slice(i, 4096))]
                h, c = np.unique(np.concatenate(all_h), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])

    return docs.select(F.col(text_col).alias("_t")).mapInArrow(common.lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _of_rows(batches, rows: int, columns: int = 1):
    """The first columns (one alone: itself) in arrays of so many rows (the last may be shorter), whatever the session's batches are."""
    held, have = [], 0

    def whole():
        cols = [pa.concat_arrays([x.column(i) for x in held]) for i in range(columns)]
        return cols[0] if columns == 1 else cols

    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows - have)
            held.append(part)
            have, at = have + part.num_rows, at + part.num_rows
            if have == rows:
                yield whole()
                held, have = [], 0
    if held:
        yield whole()


def rounds_for(rows: int) -> int:
    """Rounds of fitting for so many training documents: one more for every tenfold, so that what is learned grows with them."""
    return 2 + max(0, int(np.log10(max(rows, 1) / 1000)))


def round_of(id_col: str, text_col: str, rounds: int) -> Column:
    """The round that a training document is fitted in, by id and text, so that rows of one id or of none are dealt out too."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit("round")), F.lit(rounds))


def _summed(batches):
    """One row of the sums (tokens, weighted parameters) of all rows."""
    n, total = 0, None
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            n, x = n + k, np.frombuffer(x.as_buffer(), "<f8")
            total = x.copy() if total is None else total + x
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "p"])


def learn(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Head, list[np.ndarray], int]:
    """(token counts, head, parameters, rank of END) from the given training documents.

    Weights are fitted in rounds, each over its own part of the documents, which together are all of them. In a round sets of
    FIT_ROWS documents start from the same weights and are averaged by their tokens: within tasks, then by sixteen tasks.
    """
    spark = docs.sparkSession
    counts = common.materialize(count_tokens(docs, text_col), "tokens")
    end = F.col("h") == int(END.view(np.int64))
    v, n, rows = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(end, F.col("c"))), F.lit(0))).first()
    top = counts.filter((F.col("c") > 1) | end).orderBy(end.desc(), F.col("c").desc(), "h").limit(HEAD).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(-c, kind="stable")
    h, c = h[order], c[order]
    at = np.argsort(h)
    head = Head(h[at], at, c, n, v)
    end_rank = int(head.rank(np.array([END]))[0])
    params = start_params(head)
    cuts, shapes = np.cumsum([x.size for x in params])[:-1], [x.shape for x in params]
    rounds = rounds_for(rows)
    for r in range(rounds if rows else 0):
        known = spark.sparkContext.broadcast((params, head))

        def run(batches, known=known):
            p, head = known.value

            def sets():
                for texts in _of_rows(batches, FIT_ROWS):
                    got, seen = fit(p, [x for _, n, h, t in _tokens(texts) for x in _by_text(head.rank(h), t, n)], head, end_rank)
                    weighted = np.concatenate([x.ravel() for x in got]).astype("<f8") * seen
                    yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([weighted.tobytes()], pa.binary())], names=["n", "p"])

            yield from _summed(sets())

        part = docs.filter(round_of(id_col, text_col, rounds) == r).select(F.col(text_col).alias("_t"))
        sums, tasks = part.mapInArrow(common.lean(run), "n long, p binary"), part.rdd.getNumPartitions()
        while tasks > 16:  # at most sixteen rows come to the driver
            sums = sums.withColumn("at", F.floor(F.spark_partition_id() / 16)).repartition(tasks := -(-tasks // 16), "at").select("n", "p").mapInArrow(common.lean(_summed), "n long, p binary")
        found = sums.collect()
        if found:
            total = sum(np.frombuffer(bytes(x["p"]), "<f8") for x in found) / sum(x["n"] for x in found)
            params = [np.ascontiguousarray(x.reshape(s), np.float32) for x, s in zip(np.split(total, cuts), shapes, strict=True)]
    return counts, head, params, end_rank


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = HELD_FOLDS) -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from the rows whose crc32 of the id as text is no multiple of folds. Tokens are words (A-Z as a-z) and one end for
    each text; null texts are empty. base_score is the smoothed unigram. score is the model's: of the words that are no head words
    it takes the class from the network and the share in it from counts, discounted in favour of words never seen. Words are told
    apart by 64-bit hashes. Without training rows every word is unseen. Rows repeated with the same id and text score alike. An
    empty table gives no rows. Scores depend in their last digits on how the input is split into tasks.
    """
    held = langid.held_out(id_col, folds)
    counts, head, params, end_rank = learn(docs.filter(~held), id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast((params, head))

    def run(batches):
        p, head = known.value
        logs = np.log10(head.counts + 0.1)
        for d, key, texts in _of_rows(batches, SCORE_ROWS, 3):
            ranks, cols = [], []
            for lo, n, h, t in _tokens(texts):
                rank = head.rank(h)
                inside = rank >= 0
                pair = np.stack([t[~inside], h[~inside].view(np.int64)])
                order = np.lexsort(pair[::-1])
                pair = pair[:, order]
                new = np.flatnonzero(np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)))) if pair.shape[1] else np.zeros(0, int)
                times = np.diff(np.append(new, pair.shape[1]))
                sizes = np.bincount(pair[0, new], minlength=n)
                cols.append([d.slice(lo, n), key.slice(lo, n), pa.array(np.bincount(t, minlength=n)), pa.array(np.bincount(t[inside], minlength=n)), pa.array(np.bincount(t[inside], logs[rank[inside]], minlength=n).astype(float)), common.list_array(pair[1, new], sizes, pa.int64()), common.list_array(times, sizes, pa.int64())])
                ranks += _by_text(rank, t, n)
            got, at = score_texts(p, ranks, head, end_rank), 0
            for c in cols:
                n = len(c[0])
                yield pa.RecordBatch.from_arrays([*c, pa.array(got[at : at + n])], names=["_d", "_k", "n_tokens", "n_known", "base", "h", "times", "score"])
                at += n

    rows = docs.select(*common.doc_keys(id_col, text_col), F.col(text_col).alias("_t")).mapInArrow(common.lean(run), "_d long, _k long, n_tokens long, n_known long, base double, h array<long>, times array<long>, score double")
    rows = common.materialize(rows, "scored")
    tail = rows.select("_d", "_k", F.explode(F.arrays_zip("h", "times")).alias("x")).select("_d", "_k", "x.h", "x.times").join(counts, "h", "left")
    c = F.coalesce("c", F.lit(0))
    unseen = F.lit(float(DISCOUNT * max(head.tail_v, 1) / max(head.tail_n, 1)))
    share = F.log10(F.when(c > 0, (c - DISCOUNT) / F.lit(float(max(head.tail_n, 1)))).otherwise(F.least(unseen, F.lit(1.0))))
    rest = tail.groupBy("_d", "_k").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(F.col("times") * F.log10(c + 0.1)).alias("b2"), F.sum(F.col("times") * share).alias("s2"))
    again = rows.groupBy("_d", "_k").agg(F.count("*").alias("m"))
    rest = again.join(rest, ["_d", "_k"], "left")
    zero, total = F.lit(0), F.lit(float(np.log10(head.n + 0.1 * (head.v + 1))))
    ident = F.when(F.col("_d") != common.NO_ID, F.col("_d"))
    return rows.join(rest, ["_d", "_k"]).select(
        ident.alias(id_col), (F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("k2") / F.col("m")).cast("long"), zero)).alias("n_known"), F.lit(int(head.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("b2") / F.col("m"), zero) - F.col("n_tokens") * total).alias("base_score"), (F.col("score") + F.coalesce(F.col("s2") / F.col("m"), zero)).alias("score"),
    )
