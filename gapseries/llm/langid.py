"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS, GRAM, LETTERS, DIRECT = 256, 3, 2048, 0x250
UNKNOWN = "und"
#: keep_identified rejects texts of MIN_CHARS characters or more whose nearest prototype has a cosine under MIN_SCORE: lines or words
#: over and over, random letters. Shorter texts hold too few n-grams for that.
MIN_SCORE, MIN_CHARS = 0.25, 100
_SCALE, _BLOCK_CHARS, _HELD = 1 << 20, 1 << 18, 96


@cache
def _symbols() -> np.ndarray:
    """Of each code point the row of its letter vector; 0 if it is no letter. Latin letters have rows of their own."""
    n = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    at = np.arange(n, dtype=np.uint64)
    row = np.where(at < DIRECT, at, DIRECT + common.mix(at) % np.uint64(LETTERS - DIRECT)).astype(np.int64)
    return np.where(letter, row, 0)


@cache
def _letters() -> np.ndarray:
    """Random sign vectors of the letters, permuted (rotated) for each place in an n-gram."""
    v = np.random.default_rng(7).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
    return np.stack([np.roll(v, GRAM - 1 - j, axis=1) for j in range(GRAM)])


def _bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vector of length 1 or 0 for each text, whether it has a letter)."""
    texts = [t.lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in texts])
    cp = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    sym, doc = _symbols()[cp], np.repeat(np.arange(len(texts)), sizes)
    has = np.bincount(doc[sym > 0], minlength=len(texts)) > 0
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0)
    sym, doc = sym[keep], doc[keep]
    n = max(len(sym) - GRAM + 1, 0)
    code, ok = np.zeros(n, np.int64), doc[:n] == doc[GRAM - 1 :]
    for j in range(GRAM):
        code = code * LETTERS + sym[j : n + j]
    ok &= sym[1 : n + 1] > 0
    grams, inverse = np.unique(code[ok], return_inverse=True)
    counts = np.bincount(doc[:n][ok] * len(grams) + inverse, minlength=len(texts) * len(grams)).reshape(len(texts), len(grams)).astype(np.float32)
    bound = np.ones((len(grams), DIMENSIONS), np.int8)
    for j in range(GRAM):
        bound *= _letters()[j][grams // LETTERS ** (GRAM - 1 - j) % LETTERS]
    v = counts @ bound.astype(np.float32)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0), has


def _runs(texts: pa.Array):
    """(first row, texts) of runs of rows of about a quarter of a million characters (counts of n-grams by text stay small); null: empty."""
    lo, held, size = 0, [], 0
    for x in texts:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size > _BLOCK_CHARS or len(held) >= _HELD:
            yield lo, held
            lo, held, size = lo + len(held), [], 0
    if held:
        yield lo, held


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Prototype of each language: the sum of its documents' vectors, to length 1. Rows without lang or letters teach nothing.

    Vectors are summed as integers within tasks, then by language and dimension, so the result does not depend on partitions.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

        for b in batches:
            langs = b.column(0).to_pylist()
            for lo, texts in _runs(b.column(1)):
                v, _ = _bundles(texts)
                v = np.rint(v * _SCALE).astype(np.int64)
                own = langs[lo : lo + len(texts)]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + v[[i for i, x in enumerate(own) if x == lang]].sum(axis=0)
                if len(sums) > 1000:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    parts = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col).mapInArrow(common.lean(run), "lang string, v array<long>")
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()  # languages x dimensions
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["x"]
    return {k: v / np.linalg.norm(v) for k, v in found.items() if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], columns: list[Column], text_col: str = "text") -> DataFrame:
    """columns of every row with lang_pred and score (cosine with the nearest prototype, at least 0).

    Null texts and those without a letter, or with no prototype learned, are UNKNOWN with score 0; ties go to the first name.
    """
    names = sorted(prototypes)
    known = docs.sparkSession.sparkContext.broadcast((names, np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)))
    rows = docs.select(F.col(text_col).alias("_t"), F.struct(*columns).alias("_c"))

    def run(batches):
        names, matrix = known.value
        for b in batches:
            for lo, texts in _runs(b.column(0)):
                v, has = _bundles(texts)
                cos = v @ matrix.T if names else np.zeros((len(texts), 1), np.float32)
                best = cos.argmax(axis=1)
                lang = [names[i] if names and h else UNKNOWN for i, h in zip(best, has, strict=True)]
                score = np.where(has, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, len(texts)), pa.array(lang, pa.string()), pa.array(score)], names=["_c", "lang_pred", "score"])

    kind = rows.schema["_c"].dataType.simpleString()
    out = rows.mapInArrow(common.lean(run), f"_c {kind}, lang_pred string, score double")
    return out.select("_c.*", "lang_pred", "score")


def held_out(id_col: str, folds: int) -> Column:
    """Whether crc32 of the id as text is a multiple of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """id, held_out, lang_pred, score of every row; prototypes come from the rows that are not held out."""
    prototypes = learn(docs.filter(~held_out(id_col, folds)), lang_col, text_col)
    return predict(docs, prototypes, [F.col(id_col), held_out(id_col, folds).alias("held_out")], text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, min_score: float = MIN_SCORE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows, columns unchanged, whose text is in a language. Rejected are null texts, those without a letter, and those of
    min_chars characters or more that are like no language (cosine with every prototype under min_score). Without any lang to learn
    from nothing is identified, so no row stays. Repeated rows fare alike."""
    prototypes = learn(docs.filter(~held_out(id_col, folds)), lang_col, text_col)
    marked = common.packed(docs, F.col(text_col).alias("_text"))
    got = predict(marked, prototypes, [F.col("_row"), (F.char_length("_text") >= min_chars).alias("_long")], "_text")
    return common.unpacked(got.filter((F.col("lang_pred") != UNKNOWN) & ~(F.col("_long") & (F.col("score") < min_score))), docs)
