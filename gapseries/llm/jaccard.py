"""N-gram Jaccard join: the product of the document by n-gram incidence matrix with its transpose, in blocks.

The matrix's rows are classes of documents with equal n-gram sets. N-grams that one row alone holds meet nothing, and a row without
enough others is left out. What stays is multiplied in two steps. The first takes each row's rarest n-grams, as many as it takes
for any two linked rows to meet there, and gives each row few partners: the row most of its n-grams name as the one with the
fewest n-grams of its own, and its neighbours by size. The second takes pairs of rows that are still in different components.
Bounds from sizes and places discard most pairs; of the others the overlap counts are accumulated over all their n-grams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

SHINGLE_WORDS = 5
#: Linked: 9 * overlap >= 4 * (sum of sizes), that is similarity 0.8 or more.
_NUM, _DEN = 4, 9
#: Counters of how often n-grams occur, by hash; they only say which may be so frequent that their rows are split over tasks.
COUNTERS, CHUNKS = 1 << 18, 64
#: Rows of one n-gram in a task. Lists of more frequent ones are split by row, and multiplied block by block.
HOT_ROWS = 1 << 18
_C1, _C2 = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: The number of occurrences that counts for n-grams whose lists are split: more than any other's.
_OFTEN = 1 << 40
#: Partners of a row in the first step.
PARTNERS = 4


def _least(n):
    """The least size, and overlap, that a set linked with one of n n-grams can have."""
    return (4 * n + 4) // 5


def _sample(n):
    """How many n-grams of least hash of a set are looked at first: two more than twice those that a linked set may lack."""
    return np.minimum(n, 2 * (n - _least(n)) + 1)


def _shared(n):
    """Of those how many another set must hold: a linked set may lack n - _least(n), and the smallest such set looks at fewer."""
    small = _least(n)
    return _sample(small) - (small - _least(small))


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram hash) sorted and distinct, and the sets' sizes. Shorter texts are one n-gram, those without words none."""
    w = common.Words(data, off, common.WORD_BYTES)
    at = w.whole(k)
    docs, grams = [w.doc[at]], [w.grams(k)[at] if len(at) else np.zeros(0, np.uint64)]
    for n in range(1, k):
        if len(short := np.flatnonzero(w.count == n)):
            docs.append(short)
            grams.append(w.grams(n, at=w.first[short]))
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[new], gram[new]
    return doc, gram, np.bincount(doc, minlength=len(off) - 1)


def _name(doc: np.ndarray, gram: np.ndarray, n: int, c: np.uint64) -> np.ndarray:
    """64-bit name of each set that does not depend on order."""
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(common.mix(gram ^ c), dtype=np.uint64)))
        ends = np.searchsorted(doc, np.arange(n), side="right")
        starts = np.searchsorted(doc, np.arange(n), side="left")
        total = common.mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
    return total.view(np.int64)


def _scan(rows: DataFrame, make, schema: str, last=None) -> DataFrame:
    """rows (_d, _k, _t) through make(ids, keys, bytes, offsets), a block of texts at a time."""

    def run(batches):
        for b in batches:
            for lo, off, data in common.text_blocks(b.column(2)):
                n = len(off) - 1
                yield from make(b.column(0).slice(lo, n), b.column(1).slice(lo, n), data, off)
        if last is not None:
            yield from last()

    return rows.mapInArrow(common.lean(run), schema)


def _classes(texts: DataFrame, k: int, scratch: common.Scratch) -> tuple[DataFrame, np.ndarray]:
    """(_d, _k, n, node, twin of every document; counts of n-grams by hash modulo COUNTERS)."""
    counts = np.zeros(COUNTERS, np.int64)
    names = ["_d", "_k", "n", "node", "twin", "chunk", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def make(d, key, data, off):
        doc, gram, n = _sets(data, off, k)
        if len(gram):
            counts[:] += np.bincount((gram & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        nothing = pa.nulls(len(n))
        cols = [d, key, pa.array(n, pa.int64()), pa.array(_name(doc, gram, len(n), _C1)), pa.array(_name(doc, gram, len(n), _C2))]
        yield pa.RecordBatch.from_arrays([*cols, nothing.cast(pa.int32()), nothing.cast(pa.binary())], names=names)

    def last():
        if counts.any():
            rows = [[None] * CHUNKS] * 5 + [list(range(CHUNKS)), [c.astype("<i8").tobytes() for c in counts.reshape(CHUNKS, -1)]]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=names)
            counts[:] = 0

    schema = "_d long, _k long, n long, node long, twin long, chunk int, counts binary"
    got = scratch.keep(_scan(texts, make, schema, last).withColumn("part", F.spark_partition_id()), "classes")

    def add(batches):  # rows in order of their chunk
        chunk, total = None, None
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()])], names=["chunk", "counts"])
                    chunk, total = c, np.zeros(COUNTERS // CHUNKS, "<i8")
                total += np.frombuffer(x.as_buffer(), "<i8")
        if chunk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()])], names=["chunk", "counts"])

    def summed(df: DataFrame, *by) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions("chunk").select("chunk", "counts").mapInArrow(common.lean(add), "chunk int, counts binary")

    parts = got.filter("chunk is not null").select("chunk", "counts", F.floor(F.col("part") / 64).alias("some"))
    total = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.int64)
    for c, x in summed(summed(parts, "chunk", "some"), "chunk").collect():  # 2 MB: a row for each chunk, if few more
        total[c] += np.frombuffer(bytes(x), "<i8")
    return got.filter("chunk is null").select("_d", "_k", "n", "node", "twin"), total.ravel()


def _ways(counts: np.ndarray) -> np.ndarray:
    """Into how many parts the list of an n-gram with each counter is split; 1 for all but those far above the mean."""
    hot = counts > HOT_ROWS + 4 * counts.mean()
    return np.where(hot, -(-counts // HOT_ROWS), 1)


def _salts(gram: np.ndarray, node: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """0 where an n-gram's list is whole, else the part (from 1) that the row is in."""
    w = ways[(gram & np.uint64(COUNTERS - 1)).astype(np.int64)]
    return np.where(w > 1, node.view(np.uint64) % w.astype(np.uint64) + np.uint64(1), np.uint64(0)).astype(np.int32)


def _first_look(texts: DataFrame, k: int, ways) -> DataFrame:
    """h, salt, node of each document's n-grams of least hash."""

    def make(_d, _k, data, off):
        doc, gram, n = _sets(data, off, k)
        name = _name(doc, gram, len(n), _C1)
        starts = np.concatenate(([0], np.cumsum(n)))[:-1]
        take = np.arange(len(doc)) - starts[doc] < _sample(n)[doc]
        gram, node = gram[take], name[doc[take]]
        for lo in range(0, len(gram), 1 << 16):
            g, x = gram[lo : lo + (1 << 16)], node[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(_salts(g, x, ways.value)), pa.array(x)], names=["h", "salt", "node"])

    return _scan(texts, make, "h long, salt int, node long")


def _met_elsewhere(sorted_rows: DataFrame) -> DataFrame:
    """node, c: how many of a row's n-grams (h, salt, node, in order) another row holds, or are so frequent that they are split.

    Nothing is held but the row before, so lists of any length pass.
    """

    def run(batches):
        before = None
        for b in batches:
            h, salt, node = (b.column(i).to_numpy() for i in range(3))
            if before is not None:
                h, salt, node = (np.concatenate(([x], y)) for x, y in zip(before[:3], (h, salt, node), strict=True))
            if not len(h):
                continue
            same = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])
            many = salt > 0
            many[1:] |= same
            many[:-1] |= same
            if before is not None:
                many[0] |= before[3]
            # the last row waits for what comes next
            nodes, c = np.unique(node[:-1][many[:-1]], return_counts=True)
            before = (h[-1], salt[-1], node[-1], many[-1])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(c, pa.int64())], names=["node", "c"])
        if before is not None and before[3]:
            yield pa.RecordBatch.from_arrays([pa.array([before[2]], pa.int64()), pa.array([1], pa.int64())], names=["node", "c"])

    return sorted_rows.mapInArrow(common.lean(run), "node long, c long")


def _whole_sets(texts: DataFrame, wanted: DataFrame, k: int, ways) -> DataFrame:
    """node, n, grams, salts of the wanted documents (_d, _k, ...)."""
    lookup = common.key_filter(wanted, F.col("_d").bitwiseXOR(F.col("_k")), wanted.count())

    def run(batches):
        for b in batches:
            keep = common.may_hold(lookup, b.column(0).to_numpy() ^ b.column(1).to_numpy())
            if not keep.any():
                continue
            b = b.filter(pa.array(keep))
            for lo, off, data in common.text_blocks(b.column(2)):
                doc, gram, n = _sets(data, off, k)
                name = _name(doc, gram, len(n), _C1)
                cols = [b.column(0).slice(lo, len(n)), b.column(1).slice(lo, len(n)), pa.array(name), pa.array(n, pa.int64())]
                lists = [common.list_array(gram.view(np.int64), n, pa.int64()), common.list_array(_salts(gram, name[doc], ways.value), n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *lists], names=["_d", "_k", "node", "n", "grams", "salts"])

    got = texts.mapInArrow(common.lean(run), "_d long, _k long, node long, n long, grams array<long>, salts array<int>")
    # Beside the wanted documents some others may come along.
    return got.join(wanted.select("_d", "_k"), ["_d", "_k"], "left_semi").dropDuplicates(["node"]).select("node", "n", "grams", "salts")


def _whole_runs(batches, columns: list[str], keys: int):
    """Arrays of the columns for stretches of sorted rows that end where the first columns, keys in number, change."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
        if not len(new[0]):
            continue
        other = np.zeros(len(new[0]), bool)
        for x in new[:keys]:
            other |= x != x[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if held and (cut or any(x[-1] != y[0] for x, y in zip(held[-1][:keys], new[:keys], strict=True))):
            yield [np.concatenate(x) for x in zip(*held, [y[:cut] for y in new], strict=True)]
            held = []
        elif cut:
            yield [y[:cut] for y in new]
        held.append([y[cut:] for y in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _run_numbers(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _occurrences(sorted_rows: DataFrame) -> DataFrame:
    """node, n, h, salt, often of the n-grams (h, salt, node, n, in order) that another row holds; often: how many rows do."""

    def run(batches):
        for h, salt, node, n in _whole_runs(batches, ["h", "salt", "node", "n"], 2):
            size = np.bincount(r := _run_numbers(h, salt))[r]
            keep = (size > 1) | (salt > 0)
            cols = [node, n, h, salt, np.where(salt > 0, _OFTEN, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], names=["node", "n", "h", "salt", "often"])

    return sorted_rows.mapInArrow(common.lean(run), "node long, n long, h long, salt int, often long")


def _leading(rows: DataFrame) -> DataFrame:
    """h, salt, node, n, place of each row's rarest n-grams: as many of its set as any linked set must meet, those of its own first."""
    own = rows.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h", "salt"))).alias("x"))
    alone = (F.col("n") - F.size("x")).cast("int")
    take = (F.col("n") - F.expr("(4 * n + 4) div 5") + 1).cast("int") - alone
    some = own.withColumn("alone", alone).withColumn("take", take).filter("take > 0")
    placed = some.select("node", "n", "alone", F.posexplode(F.slice("x", F.lit(1), F.col("take"))).alias("at", "y"))
    return placed.select("y.h", "y.salt", "node", "n", (F.col("alone") + F.col("at")).cast("long").alias("place"))


def _possible(n1, place1, n2, place2):
    """Whether sets that first meet at these places can be linked."""
    return _DEN * np.minimum(n1 - place1, n2 - place2) >= _NUM * (n1 + n2)


def _partners(sorted_rows: DataFrame) -> DataFrame:
    """a, an, b, bn: each row (h, salt, n, node, place, in order) with the row in its list that has the least place, and with the
    one before it; without those that sizes and places leave no link."""

    def run(batches):
        for h, salt, n, node, place in _whole_runs(batches, ["h", "salt", "n", "node", "place"], 2):
            r = _run_numbers(h, salt)
            by_place = np.lexsort((node, place, r))
            starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            here = np.arange(len(h))
            out = []
            for i in (by_place[starts][r], np.maximum(here - 1, starts[r])):
                ok = (node[i] != node) & _possible(n, place, n[i], place[i])
                out.append([x[ok] for x in (node, n, node[i], n[i])])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "an", "b", "bn"])

    return sorted_rows.mapInArrow(common.lean(run), "a long, an long, b long, bn long")


def _cross(sorted_rows: DataFrame) -> DataFrame:
    """Pairs a, an, b, bn of different components out of each list's pair of blocks (h, p, q, n, node, place, comp, block, in order)."""

    def run(batches):
        for h, p, q, n, node, place, comp, block in _whole_runs(batches, ["h", "p", "q", "n", "node", "place", "comp", "block"], 3):
            r = _run_numbers(h, p, q)
            size = r * (1 << 33) + n
            lo, out, held = np.searchsorted(size, r * (1 << 33) + _least(n)), [], 0
            for j in range(len(h)):
                i = np.arange(lo[j], j)
                i = i[(comp[i] != comp[j]) & ((block[i] != block[j]) | (p[j] == q[j]))]
                i = i[_possible(n[j], place[j], n[i], place[i])]
                if len(i):
                    out.append((i, np.full(len(i), j)))
                    held += len(i)
                if out and (held > 100_000 or j + 1 == len(h)):
                    i, jj = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[jj], n[jj], node[i], n[i])], names=["a", "an", "b", "bn"])
                    out, held = [], 0
            if out:
                i, jj = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[jj], n[jj], node[i], n[i])], names=["a", "an", "b", "bn"])

    return sorted_rows.mapInArrow(common.lean(run), "a long, an long, b long, bn long")


def _still_apart(leading: DataFrame, comp: DataFrame) -> DataFrame:
    """h, p, q, n, node, place, comp, block: lists whose rows are of different components, long ones in blocks, each with each."""
    rows = leading.join(comp, "node", "left").select("h", "node", "n", "place", F.coalesce("comp", "node").alias("comp"))
    mixed = rows.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).filter("x <> y").select("h", "size")
    ways = F.ceil(F.col("size") / HOT_ROWS).cast("int")
    dealt = rows.join(mixed, "h").withColumn("block", F.pmod(F.xxhash64("node"), ways).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), ways - 1)))
    return dealt.select("h", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "n", "node", "place", "comp", "block")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b (with sizes an, bn) whose overlap, accumulated over all their n-grams, links them."""
    nodes = pairs.select(F.col("b").alias("node")).distinct()
    left = pairs.join(sets.select(F.col("node").alias("a"), "grams"), "a").select("a", "an", "b", "bn", F.explode("grams").alias("h"))
    right = sets.join(nodes, "node", "left_semi").select(F.col("node").alias("b"), F.explode("grams").alias("h"))
    overlap = left.join(right, ["b", "h"]).groupBy("a", "an", "b", "bn").count()
    return overlap.filter(_DEN * F.col("count") >= _NUM * (F.col("an") + F.col("bn"))).select("a", "b")


def _links(texts: DataFrame, reps: DataFrame, k: int, counts: np.ndarray, scratch: common.Scratch) -> DataFrame:
    """node, comp of the classes that are linked with another."""
    spark = texts.sparkSession
    ways = spark.sparkContext.broadcast(_ways(counts))
    rows = _first_look(texts, k, ways).repartition("h", "salt").sortWithinPartitions("h", "salt", "node")
    met = _met_elsewhere(rows).groupBy("node").agg(F.sum("c").alias("c"))
    small = F.expr("(4 * n + 4) div 5")
    lacks = F.expr("(4 * n + 4) div 5 - (4 * ((4 * n + 4) div 5) + 4) div 5")
    wanted = scratch.keep(reps.join(met, "node").filter(F.col("c") >= F.least(small, 2 * lacks + 1) - lacks).select("_d", "_k", "node"), "wanted")
    sets = scratch.keep(_whole_sets(texts, wanted, k, ways), "sets")
    entries = sets.select("node", "n", F.explode(F.arrays_zip("grams", "salts")).alias("x")).select(F.col("x.grams").alias("h"), F.col("x.salts").alias("salt"), "node", "n")
    often = _occurrences(entries.repartition("h", "salt").sortWithinPartitions("h", "salt"))
    leading = scratch.keep(_leading(often), "leading")
    tried = _partners(leading.select("h", "salt", "n", "node", "place").repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "node"))
    best = Window.partitionBy("a").orderBy(F.col("count").desc(), "b")
    tried = tried.groupBy("a", "an", "b", "bn").count().withColumn("i", F.row_number().over(best)).filter(F.col("i") <= PARTNERS)
    tried = scratch.keep(tried.select("a", "an", "b", "bn"), "tried")
    links = scratch.keep(_linked(tried, sets), "links")
    comp = graph.components(links, scratch)
    apart = _still_apart(leading, comp).repartition("h", "p", "q").sortWithinPartitions("h", "p", "q", "n", "node")
    rest = scratch.keep(_cross(apart).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    more = scratch.keep(_linked(rest, sets), "more")
    return graph.components(links.union(more), scratch) if more.limit(1).count() else comp


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """_d, _k, n_shingles, _first_d, _first_k (the least document of its component) of every row of docs.

    Words are runs of anything but ASCII space, A-Z as a-z. A document's set are its distinct runs of k words; with fewer words
    the whole sequence is its one element; without words (or text) the set is empty and the document stays alone. Documents are
    linked when 100 * |intersection| >= 80 * |union|; components are the links' closure. Rows repeated with the same id and text
    are one document; a null id comes before all others. An empty table gives no rows. Sets are compared by 64-bit hashes of
    their n-grams.
    """
    spark = docs.sparkSession
    scratch, kept = common.Scratch(spark, "jaccard"), common.Scratch(spark, "components")
    texts = docs.select(*common.doc_keys(id_col, text_col), F.col(text_col).alias("_t"))
    all_docs, counts = _classes(texts, k, kept)
    reps = all_docs.filter("n > 0").groupBy("n", "node", "twin").agg(F.min(F.struct("_d", "_k")).alias("r"), F.count("*").alias("m"))
    reps = scratch.keep(reps.select("n", "node", "twin", "r.*", "m"), "reps")
    copies = all_docs.filter("n > 0").join(reps.filter("m > 1").select("n", "node", "twin", F.col("_d").alias("r_d"), F.col("_k").alias("r_k")), ["n", "node", "twin"])
    copies = scratch.keep(copies.filter("_d <> r_d or _k <> r_k").select("_d", "_k").distinct(), "copies")
    firsts = texts.join(common.broadcast_if(copies, copies.count(), common.BROADCAST_KEYS), ["_d", "_k"], "left_anti")
    comp = _links(firsts, reps, k, counts, scratch)
    named = reps.join(comp, "node", "left").select("n", "node", "twin", "_d", "_k", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min(F.struct("_d", "_k")).alias("f"))
    names = kept.keep(named.join(least, "comp").select("n", "node", "twin", F.col("f._d").alias("_first_d"), F.col("f._k").alias("_first_k")), "names")
    scratch.clear()
    out = all_docs.join(names, ["n", "node", "twin"], "left")
    return out.select("_d", "_k", F.col("n").alias("n_shingles"), F.coalesce("_first_d", "_d").alias("_first_d"), F.coalesce("_first_k", "_k").alias("_first_k"))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """id, n_shingles, component_id (the component's smallest id) of every row."""
    known = lambda c: F.when(F.col(c) != common.NO_ID, F.col(c))
    return link(docs, id_col, text_col, k).select(known("_d").alias(id_col), "n_shingles", known("_first_d").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs, columns unchanged, one for each component: its smallest id; of repeated rows one stays."""
    scratch = common.Scratch(docs.sparkSession, "first")
    linked = scratch.keep(link(docs, id_col, text_col, k).select("_d", "_k", "_first_d", "_first_k"), "linked")
    bad = scratch.keep(linked.filter("_d <> _first_d or _k <> _first_k").select("_d", "_k").distinct(), "others")
    again = linked.groupBy("_d", "_k").count().filter("count > 1").limit(1).count()
    out = common.without(docs, bad, common.doc_keys(id_col, text_col))
    if again:
        out = common.unpacked(common.packed(out, *common.doc_keys(id_col, text_col)).dropDuplicates(["_d", "_k"]), docs)
    return out
