"""Substring dedup over sliding runs of sentences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A run has at least so many sentences and words. Sentences are also cut after the word with the least hash (the last of equal
#: ones) of every WINDOW words in them, so cuts depend on near words only and no piece has more than WINDOW words. In a passage of
#: 5 * WINDOW + 1 words at least one run is the same wherever the passage stands.
RUN_SENTENCES, RUN_WORDS, WINDOW = 2, 10, 10
#: Documents with removals up to which the removals are broadcast to the texts.
BROADCAST_DOCS, BROADCAST_RUNS = 10_000, 200_000

#: Characters that end a sentence, and the letters of scripts without spaces between words. Each of these letters
#: is a word, two count as one.
MARKS = ".!?…。！？｡．؟۔।॥"
LETTER_RANGES = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
]
_MARK_BYTES = {n: np.array([int.from_bytes(m.encode(), "big") for m in MARKS if len(m.encode()) == n]) for n in (1, 2, 3)}


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, length) of every letter of scripts without spaces."""
    at = np.flatnonzero(data >= 0xE0)
    size = np.where(data[at] >= 0xF0, 4, 3)
    keep = at + size <= len(data)
    at, size = at[keep], size[keep]
    b = [data[at + i].astype(np.int64) & 0x3F for i in range(3)]
    last = data[np.minimum(at + 3, len(data) - 1)].astype(np.int64) & 0x3F
    cp = np.where(size == 3, (b[0] & 0x0F) << 12 | b[1] << 6 | b[2], (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | last)
    known = np.zeros(len(at), bool)
    for lo, hi in LETTER_RANGES:
        known |= (cp >= lo) & (cp <= hi)
    return at[known], size[known]


def _marked(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word's last character ends a sentence."""
    code, out = np.zeros(len(end), np.int64), np.zeros(len(end), bool)
    for n in (1, 2, 3):
        at = end - n
        code += np.where(at >= 0, data[np.maximum(at, 0)], 0).astype(np.int64) << (8 * (n - 1))
        out |= np.isin(code, _MARK_BYTES[n])
    return out


@dataclass
class Runs:
    """Runs of the texts of a block: text, first sentence, number of sentences, first and last byte (end) in the text, hashes."""

    doc: np.ndarray
    at: np.ndarray
    count: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[common.Words, np.ndarray, np.ndarray]:
    """(words, whether each is a letter that counts half, whether a piece ends with it): pieces are sentences and parts of them."""
    letter, size = _letters(data)
    breaks = np.zeros(len(data) + 1, bool)
    breaks[letter] = True
    breaks[letter + size] = True
    w = common.Words(data, off, common.WORD_BYTES, breaks[:-1], common.BYTE_CASED)
    n = len(w.hash)
    half = breaks[w.start] & np.isin(w.start, letter) if len(letter) else np.zeros(n, bool)
    ends = np.zeros(n, bool)
    if n:
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        ends[-1] = True
        ends[:-1] = (w.doc[1:] != w.doc[:-1]) | _marked(data, w.end[:-1]) | (lines[w.start[1:]] > lines[w.end[:-1]])
    if n >= WINDOW:
        sentence = np.cumsum(ends) - ends
        least = (w.hash >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
        width = 1
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WINDOW:
            least = np.minimum(least[: n - WINDOW + 1], least[WINDOW - width :])
        inside = sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :]
        ends[(np.uint64(0xFFFFFFFF) - (least[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
    return w, half, ends


def runs(data: np.ndarray, off: np.ndarray) -> Runs:
    """The shortest run from each piece on that has RUN_SENTENCES pieces and RUN_WORDS words. What the last run leaves at the
    text's end is one more, known by the words of both."""
    w, half, ends = pieces(data, off)
    last = np.flatnonzero(ends)
    first = np.concatenate(([0], last + 1))[:-1] if len(last) else last
    doc, n = w.doc[first], len(first)
    docs = np.arange(len(off) - 1)
    lo, hi = np.searchsorted(doc, docs), np.searchsorted(doc, docs, side="right")
    weight = np.concatenate(([0], np.cumsum(np.where(half, 1, 2))))
    total = weight[np.concatenate((first, [len(w.hash)]))] if n else np.zeros(1, np.int64)
    stop = np.maximum(np.searchsorted(total, total[:-1] + 2 * RUN_WORDS), np.arange(n) + RUN_SENTENCES)
    ok = stop <= hi[doc] if n else np.zeros(0, bool)
    a = np.flatnonzero(ok)
    b, known = stop[a], a
    many = np.bincount(doc[a], minlength=len(docs)) if len(a) else np.zeros(len(docs), np.int64)
    final = lo + many - 1
    tail = np.flatnonzero((many > 0) & (stop[np.minimum(np.maximum(final, 0), n - 1)] < hi)) if n else docs[:0]
    if len(tail):
        f = final[tail]
        a, b, known = np.concatenate((a, stop[f])), np.concatenate((b, hi[tail])), np.concatenate((known, f))
        order = np.argsort(a, kind="stable")
        a, b, known = a[order], b[order], known[order]
    edge = np.concatenate((first, [len(w.hash)]))
    x, y = edge[known], edge[b]
    hashes = []
    up, down = common.powers(len(w.hash) + 1)
    for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
        with np.errstate(over="ignore"):
            p = np.concatenate(([np.uint64(0)], np.cumsum(common.mix(w.hash ^ salt) * up[: len(w.hash)], dtype=np.uint64)))
            hashes.append(common.mix((p[y] - p[x]) * down[x] + (y - x).astype(np.uint64)).view(np.int64))
    at = np.concatenate((w.start[first], [0]))
    d = doc[a] if len(a) else a
    start = np.where(a == lo[d], 0, at[a] - off[d])
    end = np.where(b == hi[d], off[d + 1] - off[d], at[b] - off[d])
    return Runs(d, a - lo[d], b - a, start, end, *hashes)


def _counts(texts: DataFrame) -> DataFrame:
    """h1, c: how often each run's hash occurs, added up within tasks first."""

    def run(batches):
        for b in batches:
            found = [runs(data, off).h1 for _, off, data in common.text_blocks(b.column(2))]
            if found:
                h, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c, pa.int64())], names=["h1", "c"])

    return texts.mapInArrow(common.lean(run), "h1 long, c long").groupBy("h1").agg(F.sum("c").alias("c"))


def _places(texts: DataFrame, lookup) -> DataFrame:
    """_d, _k, i, n, start, end, h1, h2 of the runs whose h1 the lookup may hold."""
    names = ["_d", "_k", "i", "n", "start", "end", "h1", "h2"]

    def run(batches):
        for b in batches:
            for lo, off, data in common.text_blocks(b.column(2)):
                r = runs(data, off)
                keep = common.may_hold(lookup, r.h1)
                row = pa.array(r.doc[keep] + lo)
                cols = [pa.array(x[keep].astype(np.int64)) for x in (r.at, r.count, r.start, r.end, r.h1, r.h2)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), *cols], names=names)

    return texts.mapInArrow(common.lean(run), ", ".join(f"{n} long" for n in names))


def repeated(docs: DataFrame, scratch: common.Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_d, _k, runs (start, end, i, n in order): the runs of each document that occur earlier, in one with a smaller id or further up.

    First only hashes are dealt out, counted within tasks before; copies by the thousand cost one row a task. Then only the runs
    that may be repeated (by a bit set of bounded size) are, with their places, so that no text is looked through again.
    """
    texts = docs.select(*common.doc_keys(id_col, text_col), F.col(text_col).alias("_t"))
    often = scratch.keep(_counts(texts).filter("c > 1").select("h1"), "often")
    places = scratch.keep(_places(texts, common.key_filter(often, F.col("h1"), often.count())), "places")
    first = places.groupBy("h1", "h2").agg(F.min(F.struct("_d", "_k", "i")).alias("first"), F.count("*").alias("c"))
    first = scratch.keep(first.filter("c > 1"), "first")
    later = common.join_counted(places, first, ["h1", "h2"], places.count()).filter(F.struct("_d", "_k", "i") != F.col("first"))
    gone = later.groupBy("_d", "_k").agg(F.sort_array(F.collect_set(F.struct("start", "end", "i", "n"))).alias("runs"))
    return scratch.keep(gone, "repeated")


def _union(start, end) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that sorted (by start) ranges cover."""
    start, end = np.asarray(start), np.maximum.accumulate(np.asarray(end))
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def cut(text: str, start, end) -> tuple[str, int]:
    """(what is left of the text without the given ranges of its UTF-8 bytes, removed stretches)."""
    data, a, b = text.encode("utf-8", "surrogatepass"), *_union(start, end)
    left = [data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)]
    return b"".join(left).decode("utf-8", "surrogatepass"), len(a)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as _row with _kept_text, n_removed (sentences and parts of them), n_spans (stretches): all in a run that is not its
    first occurrence goes.

    Words are runs of anything but ASCII space, and letters of scripts without spaces; they alone decide, so space and breaks do
    not count. Null texts stay null. Rows repeated with the same id and text are one document: each is cut alike. Rows with one
    id and other texts are ordered by the texts' hash; a null id comes first. An empty table gives no rows. Extra columns pass
    through. Documents without removals are not dealt out, and do not pass through Python a third time.
    """
    scratch = common.Scratch(docs.sparkSession, "spans")
    gone = repeated(docs, scratch, id_col, text_col)
    n, total = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    lookup = common.key_filter(gone, F.col("_d").bitwiseXOR(F.col("_k")), n)
    gone = F.broadcast(gone) if n <= BROADCAST_DOCS and total <= BROADCAST_RUNS else gone.hint("merge")

    @F.pandas_udf("boolean")
    def touched(x: pd.Series) -> pd.Series:
        return pd.Series(common.may_hold(lookup, x.to_numpy()))

    @F.pandas_udf("text string, n_removed long, n_spans long")
    def cut_all(text: pd.Series, start: pd.Series, end: pd.Series, i: pd.Series, n: pd.Series) -> pd.DataFrame:
        made = []
        for t, a, b, x, y in zip(text, start, end, i, n, strict=True):
            left, spans = (t, 0) if a is None or not len(a) else cut(t, a, b)
            x, y = _union(x, np.asarray(x) + np.asarray(y)) if spans else (np.zeros(1), np.zeros(1))
            made.append((left, int((y - x).sum()), spans))
        return pd.DataFrame(made, columns=["text", "n_removed", "n_spans"])

    marked = common.packed(docs, *common.doc_keys(id_col, text_col)).withColumn("_touched", touched(F.col("_d").bitwiseXOR(F.col("_k"))))
    whole = marked.filter("not _touched").select("_row", F.col(f"_row.`{text_col}`").alias("_kept_text"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    some = marked.filter("_touched").join(gone, ["_d", "_k"], "left")
    some = some.withColumn("_cut", cut_all(F.col(f"_row.`{text_col}`"), *[F.col(f"runs.{c}") for c in ("start", "end", "i", "n")]))
    return whole.unionByName(some.select("_row", F.col("_cut.text").alias("_kept_text"), "_cut.n_removed", "_cut.n_spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs, columns unchanged, with repeated runs cut from the texts (and chars_col, where there is one, counted anew);
    a row of which no word is left goes, unless it had none before."""
    out = dedup(docs, id_col, text_col).filter((F.col("n_removed") == 0) | (F.btrim("_kept_text", F.lit(" \t\n\x0b\x0c\r")) != ""))
    new = {text_col: F.col("_kept_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("n_removed") == 0, F.col(f"_row.`{chars_col}`")).otherwise(F.length("_kept_text").cast(docs.schema[chars_col].dataType))
    return common.unpacked(out, docs, **new)
