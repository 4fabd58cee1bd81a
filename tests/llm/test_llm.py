"""The corpus operators against brute force, round trips and held-out accuracy; hard rows by the dozen."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapseries.llm import ORACLES, QUERIES, chat, common, decontaminate, jaccard, langid, lm, packing, quality, spans, suffixes, warc
from gapseries.llm.queries import tokenizer_path

from compare import TABLES, assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, n_words string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty and long texts, exact and near copies, repeated rows, and columns that clash with working names."""
    base, passage = words(120, 1), words(60, 2)
    near = base.replace(base.split()[50], "zz")
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, near, "en"), (4, words(80, 3) + ". " + passage + ". " + words(30, 4), "fr"), (5, words(70, 5) + ". " + passage + ". " + words(40, 6), "fr"),
        (6, None, "en"), (7, "", None), (8, "   \n\t ", "en"), (None, "one two three", None), (9, "one two three", "de"), (10, "ab " * 400, "en"), (11, words(6000, 7), "de"), (12, "1234 5678 !!", "en"), (13, "Ünï çødé ß " * 20, "fr"), (14, "x", "en"),
    ]
    return spark.createDataFrame([(d, t, lang, None, len(t or ""), "clash", "clash") for d, t, lang in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_packing_covers_every_token_once(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), shard_pieces=4).collect()
    want = Counter()
    for d, x in rows_of(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        cut = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(cut, len(ids), 1024)]):
            part = ids[s : cut if k == 0 else s + 1024]
            want[d, k, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 1024


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_hold_each_item_once(lengths):
    bins = packing.pack_lengths(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 64 for b in bins)


def test_local_search_beats_best_fit():
    r = random.Random(4)
    better = 0
    for _ in range(40):
        n = [r.randint(10, 60) for _ in range(80)]
        bins = packing._Bins(n, 100)
        bins.best_fit()
        assert len(packing.pack_lengths(n, 100)) <= len(bins.items)
        better += len(packing.pack_lengths(n, 100)) < len(bins.items)
    assert better


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "\n", "\t", ".", ",", "'s", "_", "a", "é", "1", "²", "\x1c", "<|endoftext|>", "<|endof", "text|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_ids_of_parts_are_ids_of_the_whole(text):
    got = packing.encode([text], tokenizer_path())[0]
    assert got == b"".join(i.to_bytes(4, "little") for i in fresh_tokenizer().encode(text, add_special_tokens=False).ids)


@cache
def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_packing_of_hard_rows(spark):
    d = spark.createDataFrame([(1, "a<|endoftext|>b", 5), (1, "a<|endoftext|>b", 5), (None, None, 5)], "doc_id long, text string, piece int")
    got = sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(d, tokenizer_path()).collect())
    assert got == [(0, 1), (1, 4), (1, 4)] and packing.pack(d.filter("false"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(spark, tmp_path, compress):
    big = "é" * 800
    pages = spark.createDataFrame([(1, "http://a/\r\n", big), (2, None, big), (None, "u", None), (4, "v", "x" * 999), (5, "w", "x" * 999), (6, "y", words(3000, 9))], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), compress=compress)
    records, gaps = warc.read_archives(spark, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.page_records(records).collect()}
    assert len(got) == 6 and gaps.count() == 0 and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[4]["record_type"] == got[5]["record_type"] == "response"
    assert got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and got[1]["payload_bytes"] == 1600 and got[None]["payload_bytes"] == 0
    file = next(tmp_path / "w" / f for f in os.listdir(tmp_path / "w") if f.startswith("part"))
    raw = file.read_bytes()
    whole = list(warc.salvage(raw))
    assert sum(x[2] for x in whole) == len(raw)
    hurt = bytearray(raw)
    at, size = whole[2][1], whole[2][2]
    hurt[at + size - 8] ^= 0xFF  # in the block, or in the member's checksum
    hurt = b"junk" + bytes(hurt[: -whole[-1][2] // 2])
    found = list(warc.salvage(hurt))
    assert sum(x[2] for x in found) == len(hurt) and [x[0] for x in found].count("gap") == 3
    kept = [x[3]["record_id"] for x in found if x[0] == "record"]
    assert kept == [x[3]["record_id"] for i, x in enumerate(whole) if i not in (2, len(whole) - 1)]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_long_header(spark, tmp_path, compress):
    pages = spark.createDataFrame([(1, "http://a/" + "x" * 200_000, "one"), (2, "http://b/", "two")], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), compress=compress)
    records, gaps = warc.read_archives(spark, str(tmp_path / "w"))
    assert {r["page_id"]: r["payload_bytes"] for r in warc.page_records(records).collect()} == {1: 3, 2: 3} and gaps.count() == 0


def warc_records(n):
    bodies = [words(3000, i).encode() for i in range(n)]
    return [warc.build_record(i, f"http://{i}/", b, hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]


def salvaged(content):
    found = list(warc.salvage(content))
    covered = 0
    for _, at, size, _ in sorted(found, key=lambda x: x[1]):
        assert at <= covered
        covered = max(covered, at + size)
    assert covered == len(content)
    return [int(x[3]["record_id"].rpartition(":")[2]) for x in found if x[0] == "record"], [x[3] for x in found if x[0] == "gap"]


def test_warc_damage_within_members():
    import gzip

    records = warc_records(6)
    next_member = gzip.compress(warc_records(8)[7])
    hurt = list(records)
    hurt[2] = hurt[2][:-50] + b"#" + hurt[2][-49:]
    ids, gaps = salvaged(gzip.compress(b"".join(hurt)) + next_member)
    start = len(records[0]) + len(records[1])
    assert ids == [0, 1, 3, 4, 5, 7] and len(gaps) == 1 and f"bytes {start} to {start + len(records[2])} " in gaps[0]
    whole = gzip.compress(b"".join(records))
    assert salvaged(whole) == ([0, 1, 2, 3, 4, 5], [])
    assert salvaged(whole[:-8] + b"????" + whole[-4:] + next_member)[0] == [0, 1, 2, 3, 4, 5, 7]
    ids, gaps = salvaged(whole[: len(whole) // 2])
    assert ids[:2] == [0, 1] and len(ids) < 6 and gaps == ["no record starts here"]
    torn = zlib.compressobj(6, zlib.DEFLATED, 31)
    torn = torn.compress(b"".join(records[:3])) + torn.flush(zlib.Z_FULL_FLUSH) + b"\xff" * 40
    assert salvaged(torn + next_member)[0] == [0, 1, 2, 7]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = stored.compress(b"".join(records)) + stored.flush()
    assert salvaged(stored[:-20])[0] == [0, 1, 2, 3, 4]
    bare = [re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", r) for r in records]
    assert salvaged(gzip.compress(b"".join(bare)))[0] == [0, 1, 2, 3, 4, 5]
    assert salvaged(gzip.compress(bare[0] + records[1])[:-8] + b"????" + whole[-4:])[0] == [1]


def test_empty_archives(spark, tmp_path):
    assert list(warc.salvage(b"")) == []
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w"))[0].count() == 0


MARKS = ".!?…。！？｡．؟۔।॥"
M64 = (1 << 64) - 1


def is_letter(c):
    return any(lo <= ord(c) <= hi for lo, hi in spans.LETTER_RANGES)


def plain_words(text):
    """(start, end) in characters of words: runs of anything but ASCII space, letters of unspaced scripts alone."""
    out, at = [], None
    for i, c in enumerate(text + " "):
        if at is not None and (c in " \t\n\x0b\x0c\r" or is_letter(c) or is_letter(text[at])):
            out.append((at, i))
            at = None
        if at is None and c not in " \t\n\x0b\x0c\r":
            at = i
    return out


def word_hash(w):
    base, h = 0x9E3779B97F4A7C15 | 1, 0
    for i, b in enumerate(w.encode()):
        h = (h + int(common.BYTE_CASED[b]) * pow(base, i, 1 << 64)) & M64
    x = (h + len(w.encode())) & M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return (x ^ x >> 31) >> 32


def plain_runs(text):
    """(start, end in characters, words) of the runs, and the pieces' starts; word by word from the definition."""
    w = plain_words(text)
    ends = [text[b - 1] in MARKS or i + 1 == len(w) or "\n" in text[b : w[i + 1][0]] for i, (a, b) in enumerate(w)]
    h, cut, at = [word_hash(text[a:b]) for a, b in w], set(), 0
    while at < len(w):
        stop = next(i for i in range(at, len(w)) if ends[i]) + 1
        for i in range(at, stop - spans.WINDOW + 1):
            cut.add(max(range(i, i + spans.WINDOW), key=lambda j: (-h[j], j)))
        at = stop
    first = [i for i in range(len(w)) if i == 0 or ends[i - 1] or i - 1 in cut] + [len(w)]
    edge = [0] + [w[i][0] for i in first[1:-1]] + [len(text)]
    size = lambda i, j: sum(1 if is_letter(text[a]) else 2 for a, b in w[first[i] : first[j]])
    said = lambda i, j: tuple(text[a:b] for a, b in w[first[i] : first[j]])
    n, out, last = len(first) - 1, [], None
    for i in range(n):
        j = next((j for j in range(i + 2, n + 1) if size(i, j) >= 2 * spans.RUN_WORDS), None)
        if j is not None:
            out.append((edge[i], edge[j], said(i, j)))
            last = i, j
    if last and last[1] < n:
        out.append((edge[last[1]], edge[n], said(last[0], n)))
    return out


def plain_dedup(rows):
    """What is left of each (id, text)."""
    seen, left = set(), {}
    for d, t in sorted(rows):
        gone = set()
        for a, b, said in plain_runs(t):
            if said in seen:
                gone |= set(range(a, b))
            seen.add(said)
        left[d, t] = "".join(c for i, c in enumerate(t) if i not in gone)
    return left


@pytest.mark.parametrize("bound", [None, 0])
def test_span_dedup(spark, docs, bound, monkeypatch):
    if bound is not None:
        monkeypatch.setattr(spans, "BROADCAST_DOCS", bound)
    r = random.Random(77)
    vocabulary = ["the", "of.", "a", "Über", "字", "字字。字", "x\ny", "end!", "b", "c", "d", "e"]
    noise = [(500 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(120)))) for i in range(40)]
    some = docs.select("doc_id", "text").union(spark.createDataFrame(noise, "doc_id long, text string"))
    got = Counter(tuple(x) for x in spans.dedup(some).select("_row.doc_id", "_row.text", "_kept_text").collect())
    rows = rows_of(some)
    left = plain_dedup({(common.NO_ID if d is None else d, t) for d, t in rows if t is not None})
    assert got == Counter((d, t, t if t is None else left[common.NO_ID if d is None else d, t]) for d, t in rows)
    assert left[2, words(120, 1)] == "" and words(60, 2)[100:300] not in left[5, next(t for d, t in rows if d == 5)]
    out = spans.remove_repeats(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 11").first()["text"] == words(6000, 7)
    assert spans.remove_repeats(docs.filter("false")).count() == 0


@pytest.mark.parametrize("kind", ["spaced", "stopped", "letters"])
def test_spans_find_a_passage_at_any_offset(kind):
    r = random.Random(50)
    letters = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    text = letters if kind == "letters" else lambda n: words(n, r.random())
    for size in (51, 55, 60, 102):
        for trial in range(60):
            passage = text(size * 2 if kind == "letters" else size)
            if kind == "stopped":
                w = passage.split()
                for i in r.sample(range(len(w)), 3):
                    w[i] += "."
                passage = " ".join(w)
            gap = "" if kind == "letters" else " "
            found = []
            for before in (". ", gap):  # after a full stop in one document, mid-sentence in the other
                t = (text(trial) + before + passage + gap + text(r.randrange(60))).encode()
                found.append(set(spans.runs(common.np.frombuffer(t, common.np.uint8), common.np.array([0, len(t)])).h1.tolist()))
            assert found[0] & found[1], (kind, size, trial)


def test_span_dedup_mid_sentence(spark):
    passage = words(26, 60) + ". " + words(29, 61)
    d = spark.createDataFrame([(1, "Start. " + passage + ". End."), (2, words(10, 62) + " " + passage + " " + words(5, 63))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in spans.dedup(d).select("_row.doc_id", "n_removed", "_kept_text").collect()}
    assert got[1]["n_removed"] == 0 < got[2]["n_removed"] and len(got[2]["_kept_text"].split()) < 50


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .!\n字é。"), max_size=150), min_size=1, max_size=4))
def test_runs_are_those_of_the_definition(texts):
    data = [t.encode() for t in texts]
    off = common.np.cumsum([0] + [len(d) for d in data])
    got = spans.runs(common.np.frombuffer(b"".join(data), common.np.uint8), off)
    names = {}
    for i, t in enumerate(texts):
        want = [(len(t[:a].encode()), len(t[:b].encode()), said) for a, b, said in plain_runs(t)]
        mine = [(int(a), int(b), (int(x), int(y))) for d, a, b, x, y in zip(got.doc, got.start, got.end, got.h1, got.h2) if d == i]
        assert [x[:2] for x in mine] == [x[:2] for x in want]
        for (_, _, h), (_, _, said) in zip(mine, want):
            assert names.setdefault(said, h) == h and names.setdefault(h, said) == said


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(words(60, 2).split()[10:40])), (10, "ONE, two"), (2, "one two three"), (3, None), (4, "..."), (None, "x"), (2, "one two three")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.summarize(docs, bench).collect()}
    assert got[4]["n_hit"] == 30 and got[4]["n_items"] == 1 and got[4]["contaminated"]
    assert got[9]["n_hit"] == 3 and got[9]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and got[14]["n_hit"] == 1 and got[14]["n_items"] == 0
    assert not got[1]["contaminated"] and got[6]["n_words"] == 0 and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {1, 2, 3, 6, 7, 8, 10, 11, 12, 13}
    assert decontaminate.summarize(docs, bench.filter("false")).filter("contaminated").count() == 0


def test_lm_base_scores_and_gain(spark):
    d = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000, None), (10_001, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in lm.score(d).collect()}
    import math

    texts = {r[0]: re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")) + [None] for r in d.collect()}
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(train.values()), len(train)
    for i, t in texts.items():
        assert got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(train[w] > 0 for w in t) and got[i]["train_tokens"] == n
        assert math.isclose(got[i]["base_score"], sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in got.values())


def test_lm_rounds_cover_all_documents(spark):
    d = spark.createDataFrame([(i if i < 200 else None, f"text {i}") for i in range(400)] + [(None, None), (1, None)], "doc_id long, text string")
    n = lm.rounds_for(20_000)
    parts = [{(r[0], r[1]) for r in d.filter(lm.round_of("doc_id", "text", n) == r).collect()} for r in range(n)]
    assert n == 3 and sum(len(p) for p in parts) == d.count() == len(set().union(*parts))
    assert all(any(i is None for i, _ in p) for p in parts)


def test_lm_score_is_the_recurrence_word_by_word():
    np = common.np
    r = np.random.default_rng(3)
    counts = np.sort(r.integers(2, 900, 1500))[::-1].copy()
    head = lm.Head(np.arange(1, 1501, dtype=np.uint64) * np.uint64(7), np.arange(1500), counts, int(counts.sum()) + 500, 1900)
    p = [x + r.standard_normal(x.shape).astype(np.float32) * np.float32(0.2) for x in lm.start_params(head)]
    ranks = [r.integers(-1, 1500, n) for n in (1, 2, 5, 40, 333, 1, 90)]
    got, k = lm.score_texts(p, ranks, head, 0), lm.HIDDEN
    q = [x.astype(float) for x in p]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for text, have in zip(ranks, got, strict=True):
        h, before, total = np.zeros(k), 0, 0.0
        for w in text:
            x, u = q[0][head.inputs(np.array([before]))[0]], h @ q[1]
            z, reset = sigmoid(x[:k] + u[:k]), sigmoid(x[k : 2 * k] + u[k : 2 * k])
            h = (1 - z) * np.tanh(x[2 * k :] + reset * u[2 * k :]) + z * h
            c = head.classes[w]
            logits = h @ q[2] + q[3]
            total += logits[c] - np.log(np.exp(logits).sum())
            if 0 <= w < lm._FINE:
                own = h @ q[4][c] + q[5][c]
                total += own[w % lm.FINE_SIZE] - np.log(np.exp(own).sum())
            elif w >= 0:
                total += np.log(counts[w] / counts[head.cls == c].sum())
            before = w
        assert abs(have - total / np.log(10)) < 1e-3 * max(1, len(text))
    fitted, seen = lm.fit(p, ranks, head, 0)
    assert seen == sum(map(len, ranks)) and any((a != b).any() for a, b in zip(p, fitted, strict=True))


def test_lm_gradients_are_those_of_the_loss():
    np = common.np
    counts = np.full(600, 5)
    head = lm.Head(np.arange(600, dtype=np.uint64), np.arange(600), counts, 3100, 650)
    r = np.random.default_rng(4)
    p = [x + r.standard_normal(x.shape).astype(np.float32) * np.float32(0.3) for x in lm.start_params(head)]
    ranks = [r.integers(-1, 600, 12) for _ in range(6)]
    loss = lambda p: -lm.score_texts(p, ranks, head, 0).sum()
    for _ in range(12):
        p, _ = lm.fit(p, ranks, head, 0)
    before = loss(lm.start_params(head))
    assert loss(p) < 0.8 * before


@pytest.mark.parametrize("rows", [[], [(6, "only a held out text")], [(6, "a b"), (None, "a b"), (None, None), (1, "x " * 5000), (1, "x " * 5000)]])
def test_lm_of_hard_tables(spark, rows):
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, h long, _d string")
    got = lm.score(d).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows) and all(r["score"] <= 0 for r in got)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) + 1 for _, t in rows)


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {(d, len(s), comp[d]) for d, s in sets.items()}


@pytest.mark.parametrize("hot", [None, 4])
def test_jaccard_components(spark, docs, hot, monkeypatch):
    if hot:  # lists of n-grams split over tasks and multiplied block by block
        monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    r = random.Random(8)
    group = words(80, 20).split()
    near = []
    for i in range(40):
        w = list(group)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(80)] = f"edit{r.random()}"
        near.append((100 + i, " ".join(w)))
    extra = spark.createDataFrame(near, "doc_id long, text string")
    some = docs.filter("doc_id is not null").select("doc_id", "text").union(extra)
    assert {tuple(x) for x in jaccard.clusters(some).collect()} == brute_components(rows_of(some))
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted((x[0] is not None, x[0] or 0) for x in kept.select("doc_id").collect()) == [(False, 0)] + [(True, i) for i in (1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14)]
    assert jaccard.clusters(docs.filter("false")).count() == 0


def test_language_id_held_out_accuracy(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.95
    edge = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert {edge[i]["lang_pred"] for i in (6, 7, 8, 12)} == {"und"} and all(0 <= r["score"] <= 1 for r in edge.values())
    junk = spark.createDataFrame([(90_000, "Qxz " * 200, "en", None, 800), (90_001, "jkqv " * 3, "en", None, 15)], "doc_id long, text string, lang string, source string, n_chars long")
    plain = d.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    kept = {r[0] for r in langid.keep_identified(plain.union(junk)).select("doc_id").collect()}
    assert 90_000 not in kept and 90_001 in kept and len(kept) > 0.98 * d.count()  # like no language; too short to tell
    assert langid.keep_identified(docs.filter("false")).count() == 0 == langid.identify(docs.filter("false")).count()
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {6, 7, 8, 12}.isdisjoint({r[0] for r in kept.select("doc_id").collect()})
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_quality_cascade(spark, docs):
    got = {r["doc_id"]: r for r in quality.assess(docs).select("_row.doc_id", "n_words", "n_repeat_words", "word_chars", "base_failed", "kept").collect()}
    assert got[10]["n_repeat_words"] == 400 and got[10]["base_failed"] and got[1]["kept"] and got[6]["n_words"] == 0 and not got[8]["kept"] and got[11]["word_chars"] == len(words(6000, 7).replace(" ", ""))
    order = quality.rule_order(docs, quality.rules())
    assert {r.name for r, _, _ in order} == {r.name for r in quality.rules()}
    assert quality.assess(docs.filter("false")).count() == 0


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 5, "user", "hi"), (4, 9, "assistant", None), (4, 9, "assistant", None), (None, 0, None, "lone"), (6, None, "user", "hi"), (7, 0, "user", "h")]
    long = [(8, i, "user", f"t{i}") for i in range(700)] + [(9, i, "user", f"t{i}") for i in range(690)]
    c = spark.createDataFrame(turns + long, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["part"]): r for r in chat.render(c).collect()}
    assert set(got) == {(2, 0), (4, 0), (None, 0), (7, 0), (8, 0), (8, 1), (8, 2)}
    assert got[2, 0]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n" and got[2, 0]["n_same"] == 2 and got[4, 0]["n_turns"] == 2 and got[8, 2]["n_turns"] == 700
    assert chat.render(c.filter("false")).count() == 0


def test_suffix_dedup(spark, docs):
    assert_suffixes(docs.filter("doc_id is not null").select("doc_id", "text").distinct())
    assert suffixes.summarize(docs).count() == docs.count()


def test_suffix_dedup_of_many_contexts(spark):
    r = random.Random(3)
    core = words(12, 30)
    rows = [(i, "".join(r.choice("xyz") for _ in range(r.randint(0, 90))) + core + "".join(r.choice("uvw") for _ in range(r.randint(0, 90)))) for i in range(60)]
    rows += [(100 + i, ("ab" * (40 + i))[: 70 + i]) for i in range(50)] + [(200 + i, words(40, 31)[i : i + 150]) for i in range(40)]
    assert_suffixes(spark.createDataFrame(rows, "doc_id long, text string"))


def test_suffix_dedup_of_repeated_rows(spark):
    lone, twice = words(60, 40), words(30, 41)
    rows = [(1, lone), (1, lone), (2, words(40, 42) + twice + twice), (2, words(40, 42) + twice + twice), (3, words(20, 43) + lone[:200]), (None, words(50, 44)), (None, words(50, 44)), (4, lone), (4, lone)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x[0]: x for x in suffixes.brute_force([(common.NO_ID if i is None else i, t.encode()) for i, t in set(rows)])}
    got = [tuple(x) for x in suffixes.summarize(d).collect()]
    assert Counter(got) == Counter((i, *want[common.NO_ID if i is None else i][1:]) for i, _ in rows)
    assert want[1][2] == want[common.NO_ID][2] == 0 < want[2][2] and want[3][2] == 200 and want[4][2] == len(lone)


@pytest.mark.parametrize("places, hot", [(0, 1), (1, 10**12), (30, 1000)])
def test_suffix_dedup_of_frequent_grams(spark, monkeypatch, places, hot):
    """Grams above a bound are settled string by string; hot keys by broadcast or not; several ranges, each in slices."""
    for module, name, value in ((suffixes, "GRAM_PLACES", places), (suffixes, "RANGE_SUFFIXES", 20), (suffixes, "RANGES", 3), (common, "HOT_PARTS", hot)):
        monkeypatch.setattr(module, name, value)
    line = words(40, 50)
    rows = [(i, words(3 + i % 7, 60 + i) + line + words(5, 100 + i)) for i in range(50)] + [(60 + i, words(30, 51)) for i in range(20)]
    rows += [(90, line[:130] * 3), (91, "ab" * 200), (91, "ab" * 200), (92, None), (93, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter({x: 2 if x[0] == 91 else 1 for x in suffixes.brute_force([(i, (t or "").encode()) for i, t in set(rows)])})
    assert Counter(tuple(x) for x in suffixes.summarize(d).collect()) == want
    assert suffixes.summarize(d.filter("false")).count() == 0


def test_anchors_do_not_depend_on_stretches():
    texts = [words(400, 70).encode(), b"", b"ab" * 300, words(300, 71).encode(), b"x" * 99]
    data, off = common.np.frombuffer(b"".join(texts), common.np.uint8), common.np.cumsum([0, *map(len, texts)])
    whole = suffixes.anchors(data, off)
    for stretch in (1, 77, 1000):
        assert all((a == b).all() for a, b in zip(whole, suffixes.anchors(data, off, stretch=stretch), strict=True))
    starts = common.np.concatenate([x[0] for x in suffixes.anchored(data, off, stretch=200)])
    assert starts.tolist() == [o + i for o, t in zip(off.tolist(), texts, strict=False) for i in range(len(t) - 99)]


def assert_suffixes(d):
    want = suffixes.brute_force([(i, (t or "").encode()) for i, t in rows_of(d)])
    assert sorted(tuple(x) for x in suffixes.summarize(d).collect()) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=5), min_size=1, max_size=8), min_size=1, max_size=6))
def test_loser_tree_merges(runs):
    coded = [suffixes.front_code(sorted((s, 1, 2, 10 * i + j, b"") for j, s in enumerate(run))) for i, run in enumerate(runs)]
    got = list(suffixes.LoserTree(coded))
    assert [x[1] for x in got] == sorted(s for r in runs for s in r)
    assert all(b[0] == suffixes.shared(a[1], b[1]) for a, b in zip(got, got[1:], strict=False))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    first = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TABLES)
        assert docs.columns == first.columns
    assert 0 < docs.count() < first.count()
    assert corpus_pipeline.run(spark, TABLES).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def plain_language_vector(text):
    np = common.np
    rows, letters = langid._symbols(), langid._letters()
    symbols = [int(rows[ord(c)]) for c in "\0" + text.lower() + "\0"]
    kept = [s for i, s in enumerate(symbols) if i == 0 or s or symbols[i - 1]]
    total = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(kept, kept[1:], kept[2:], strict=False):
        if b:
            total += letters[0][a].astype(float) * letters[1][b] * letters[2][c]
    size = np.linalg.norm(total)
    return (total / size if size else total), any(symbols)


def plain_pipeline(rows, bench):
    """(id, text) that the first four stages keep, and the stages' numbers of rows; rows: distinct (id, text, lang)."""
    np, kept = common.np, []
    known = {(d, t): plain_language_vector(t or "") for d, t, _ in rows}
    langs = {}
    for d, t, lang in rows:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 5 and lang is not None and t is not None:
            langs[lang] = langs.get(lang, 0) + known[d, t][0]
    langs = {k: v / np.linalg.norm(v) for k, v in langs.items() if np.any(v)}
    for d, t, _ in rows:
        v, has = known[d, t]
        if has and (len(t) < langid.MIN_CHARS or max(float(v @ p) for p in langs.values()) >= langid.MIN_SCORE):
            kept.append((d, t))
    sizes, first = [len(kept)], {d: c for d, _, c in brute_components(kept)}
    kept = [(d, t) for d, t in kept if first[d] == d]
    sizes.append(len(kept))
    left = plain_dedup(kept)
    kept = [(d, left[d, t]) for d, t in kept if left[d, t].strip(" \t\n\x0b\x0c\r")]
    sizes.append(len(kept))
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for _, t in bench for w in [words_of(t)] if w for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words_of(t)] for n in range(1, 11) for i in range(len(w) - n + 1))
    kept = [(d, t) for d, t in kept if not hit(t)]
    return kept, [*sizes, len(kept)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    langs, r = {"de": "abcdef", "en": "ghijkl", "fr": "mnopqr"}, random.Random(70)

    def prose(lang, n):
        return " ".join("".join(r.choice(langs[lang]) for _ in range(r.randint(2, 7))) + r.choice(["", "", "", ".", ","]) for _ in range(n))

    rows = [(i, prose(lang, r.randint(20, 160)), lang) for i in range(60) for lang in [sorted(langs)[i % 3]]]
    passage, item = prose("en", 70), prose("de", 14)
    near = rows[3][1].split()
    near[10] = "changed"
    rows += [(100, rows[3][1], "de"), (101, " ".join(near), None), (102, prose("en", 30) + " " + passage + " " + prose("en", 20), "en"), (103, prose("fr", 12) + ". " + passage + " " + prose("fr", 40), "fr")]
    rows += [(104, prose("de", 40) + " " + item + " " + prose("de", 9), "de"), (105, None, "en"), (106, "", None), (107, "  \n ", "de"), (108, "123 456", "fr"), (109, "xyz " * 120, None), (110, "ab cd", "de"), (111, prose("en", 4000), "en")]
    bench = [(1, item), (2, None), (3, "...")]
    spark.createDataFrame([(*x, None, len(x[1] or ""), "clash") for x in [*rows, rows[0], rows[3]]], "doc_id long, text string, lang string, source string, n_chars long, _d string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, sizes = plain_pipeline(rows, bench)
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < len(rows) and sizes[1] < sizes[0] and sizes[3] < sizes[2] and 109 not in dict(kept)
    want = Counter()
    for d, t in kept:
        ids = fresh_tokenizer().encode(t, add_special_tokens=False).ids + [2]
        cut = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(cut, len(ids), 1024)]):
            part = ids[s : cut if k == 0 else s + 1024]
            want[d, k, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert want == Counter(tuple(x) for x in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    empty = tmp_path / "empty"
    spark.read.parquet(f"{tmp_path}/documents.parquet").filter("false").write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
