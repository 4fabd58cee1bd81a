"""Hard negatives, line dedup and fill-in-middle: hard rows, bounds lowered, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapseries.llm import common, fim, lines, negatives

EMBEDDED = "vec_id long, label int, embedding array<float>, id long, block int, j string"


def mined(rows, anchors, low=30, high=90):
    """Every anchor with every row, in Python's whole numbers."""
    good = {(i, lab, tuple(math.floor(256.0 * x) for x in v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, lab, v in good:
        if not anchors(i):
            continue
        scored = {(-sum(a * b for a, b in zip(v, w)), k, m == lab) for k, m, w in good}
        pos = sorted({(s, k) for s, k, same in scored if same and k != i})[:5]
        for p, pid in pos:
            neg = sorted({(s, k) for s, k, same in scored if not same and -low * p <= -100 * s <= -high * p})[:10]
            out += [(i, pid, r + 1, k, -p, -s) for r, (s, k) in enumerate(neg)]
    return Counter(out)


def embedded(n=400, seed=3):
    """Ties by the dozen (small whole components), a third of all rows alike, and rows that take no part."""
    r = random.Random(seed)
    rows = [(i, r.randrange(4), [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(n)]
    rows += [(1000 + i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(n // 2)]
    bad = [(0, None, [1.0] * 4), (10, 1, None), (20, 1, [1.0, None, 0.0, 0.0]), (30, 1, [float("nan"), 0.0, 0.0, 0.0]), (40, 1, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, [1.0] * 4)]
    odd = [(50, 2, [1.0, 1.0]), (60, 2, []), (70, 1, [0.5] * 6), (80, -3, [1.0] * 4)]
    return rows + rows[:40] + bad + odd + [(100, 2, [0.25, 1.0, 1.0, 0.5]), (100, 3, [0.25, 1.0, 1.0, 0.5])]


def of(spark, rows):
    return spark.createDataFrame([(i, lab, v, 7, 7, "clash") for i, lab, v in rows], EMBEDDED).repartition(7)


def got(df):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("block", [16_384, 5])
def test_hard_negatives(spark, block):
    rows = embedded()
    want = mined(rows, lambda i: i % 10 == 0)
    assert want and got(negatives.mine(of(spark, rows), F.col("vec_id") % 10 == 0, block_anchors=block)) == want


def test_hard_negatives_of_no_rows(spark):
    d = of(spark, embedded(40))
    assert negatives.mine(d.filter("false"), F.lit(True)).count() == 0 == negatives.mine(d, F.lit(False)).count()
    assert negatives.mine(d.filter("label = 1"), F.lit(True)).count() == 0  # one label: no negatives
    assert negatives.mine(d.withColumn("label", F.col("vec_id").cast("int")).dropDuplicates(["vec_id"]), F.lit(True)).count() == 0  # no positives


def test_products_are_exact():
    r = np.random.default_rng(1)
    a, b = np.floor(r.normal(0, 3e5, (7, 64))), np.floor(r.normal(0, 3e7, (9, 64)))
    assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    a *= 1 << 6
    assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    with pytest.raises(ValueError, match="too long"):
        negatives.products(a * 1e6, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3), st.integers(0, 9)), max_size=80), st.integers(1, 4), st.integers(1, 9))
def test_best_of_parts(entries, k, step):
    best = negatives.Best(4, k)
    best.room = 5
    for i in range(0, len(entries), step):
        best.add(*np.array(entries[i : i + step], np.int64).reshape(-1, 3).T)
    want = [(key, s, i) for key in range(4) for s, i in sorted({(s, i) for x, s, i in entries if x == key}, key=lambda e: (-e[0], e[1]))[:k]]
    assert list(zip(*(x.tolist() for x in best.rank()))) == want


SCHEMA = "doc_id long, text string, n_lines long, h long, _d string"
EDGE = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in EDGE.sub("", line))


def kept(rows, min_docs, min_chars=1):
    count = Counter(k for d, t in set(rows) for k in {key_of(x) for x in (t or "").split("\n")})
    gone = {k for k, n in count.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if key_of(x) not in gone]
        out.append((d, "\n".join(stay), len(own), len(own) - len(stay)))
    return Counter(out)


def texts():
    r = random.Random(8)
    pool = ["Home", " home\t", "HOME", "é", "É", "", "  ", "a b", "A  b", "ﬀ ﬁ", "x" * 400, "\r", "　", "one\x0b", "menu | login"]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.6 else f"line {r.randrange(300)}" for _ in range(r.randrange(1, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n"), (204, "home"), (None, "home\nhome\nother"), (205, "line 1\n" * 3000 + "end"), (206, "tail\n")]
    return rows + rows[:6] * 3 + [(0, "another text\nhome"), (0, None)]


def stripped(out):
    return Counter((r["_row"]["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())


@pytest.mark.parametrize(("bound", "min_docs", "min_chars"), [(500_000, 10, 1), (0, 10, 1), (0, 2, 5), (500_000, 1, 2)])
def test_line_dedup(spark, monkeypatch, bound, min_docs, min_chars):
    monkeypatch.setattr(lines, "BROADCAST_LINES", bound)
    monkeypatch.setattr(common, "HOT_PARTS", 20)
    rows = texts()
    d = spark.createDataFrame([(i, t, -1, -1, "clash") for i, t in rows], SCHEMA).repartition(5)
    assert stripped(lines.dedup(d, min_docs, min_chars)) == kept(rows, min_docs, min_chars)


@pytest.mark.parametrize("bound", [0, 10])
def test_line_dedup_of_no_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(lines, "BROADCAST_LINES", bound)
    d = spark.createDataFrame([(1, "a", -1, -1, "clash")], SCHEMA)
    assert lines.dedup(d.filter("false")).count() == 0
    assert [tuple(r) for r in lines.remove_lines(d, min_docs=1).collect()] == [(1, "", -1, -1, "clash")]
    assert lines.remove_lines(d.withColumn("text", F.lit(None).cast("string")), min_docs=1).first()["text"] is None


def test_runs_count_over_batches_and_levels(spark):
    """Keys of which no batch alone has enough are found; settled ones are not added again; runs are merged level by level."""
    runs = lines.Runs(common.Scratch(spark, "test"), enough=4)
    batches = [[1] * 5 + [2] * 2 + [3], [1] * 9 + [2] + [4], [2] + [3] * 2, [3] + [1], [5] * 4]
    sizes = []
    for b in batches:
        runs.add(spark.createDataFrame([(x, -x) for x in b], "h long, g long"))
        sizes.append([len(x) for x in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert {r["h"]: r["n"] for r in runs.often().collect()} == {1: 5, 2: 4, 3: 4, 5: 4}
    plan = runs._merged([x for level in runs.levels for x in level])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("\n \tAbé€𝄞\r")), max_size=12), max_size=6))
def test_lines_of_blocks(made):
    data = np.frombuffer("".join(made).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in made]))).astype(np.int64)
    at = lines.lines(data, off)
    found = [[bytes(data[s:e]).decode() for d, s, e in zip(at.doc, at.start, at.end) if d == i] for i in range(len(made))]
    assert found == [t.split("\n") for t in made]
    keys = [key_of(x) for t in found for x in t]
    assert at.chars.tolist() == [len(k) for k in keys]
    assert len({(k, h, g) for k, h, g in zip(keys, at.h.tolist(), at.g.tolist())}) == len(set(keys)) == len(set(zip(at.h.tolist(), at.g.tolist())))
    gone = np.array([len(k) == 1 for k in keys], bool)
    left, edge = lines.keep(data, off, at, gone)
    assert [bytes(left[a:b]).decode() for a, b in zip(edge[:-1], edge[1:])] == ["\n".join(x for x in t if len(key_of(x)) != 1) for t in found]


def infilled(i, text, rate=50):
    """The contract with all units in a list."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return text, n, "plain", None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return "<S>" + s + "<P>" + p + "<M>" + m, n, "spm", len(p), len(m)
    return "<P>" + p + "<S>" + s + "<M>" + m, n, "psm", len(p), len(m)


@pytest.mark.parametrize("rate", [50, 100])
def test_fill_in_middle(spark, rate):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["a", "é", "𝄞", " ", "\n", "\t", "<", "P>", "<S", ">", "word", " ", "\x1c"]) for _ in range(r.randrange(30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "x<P>y"), (None, "a b c"), (204, "w " * 50_000), (205, "x" * 100_000), (206, "<"), (206, "<"), (207, " " * 100_000)]
    d = spark.createDataFrame([(i, t, "clash", "clash", 0) for i, t in rows], "doc_id long, text string, output string, form string, n long").repartition(3)
    out = fim.transform(d, rate=rate).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((x["_row"]["doc_id"], x["output"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"]) for x in out) == Counter((i, *infilled(i, t, rate)) for i, t in rows)
    assert all(x["again"] == (x["_row"]["text"] or "") for x in out) and {x["form"] for x in out} == {"plain", "psm", "spm"}
    assert fim.transform(d.filter("false")).count() == 0


def test_second_pass_stops_at_its_rank(monkeypatch):
    seen = []

    class Counted:
        def finditer(self, text):
            for m in re.finditer(r"\s*\S+|\s+", text):
                seen.append(m.end())
                yield m

    monkeypatch.setattr(fim, "UNIT", Counted())
    assert fim.ends("a b c d e f", 2, 3) == (3, 5) and len(seen) == 3
    assert fim.ends("a b", 0, 0) == (0, 0) and len(seen) == 3


@pytest.mark.parametrize("markers", [("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "b", "c"), ("<P>", "<P>", "<M>")])
def test_markers_that_overlap_are_refused(markers):
    with pytest.raises(ValueError, match="marker"):
        fim.check_markers(markers)
