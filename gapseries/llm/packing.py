"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TOKENS, END_ID, SHARD_PIECES = 1024, 2, 4096
#: Space-led parts whose ids a worker remembers; when full, rarer parts are encoded anew each time.
CACHE_PARTS = 600_000

_PIECES = "_d long, piece int, start long, length long, ids_crc32 long, _shard int"
#: A space after another character always begins a new part in the byte-level vocabulary's own pattern, so texts can be cut there.
_CUT = re.compile(r"(?<=\S)(?= )")
_loaded: dict[str, _Parts] = {}
common.KEPT["packing"] = _loaded


def _simple(text: str) -> bool:
    """Only single spaces and single line breaks between printing characters; each such break is a part of its own."""
    edge = text[:1] + text[-1:]
    return not (edge.isspace() or edge != edge.strip() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text) and text.replace("\n", "").isprintable()


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Parts(dict):
    """Ids (little-endian unsigned 32-bit) of parts of texts, each with space before it where the key leaves it out."""

    def __init__(self, tokenizer, space: str = " "):
        self.tokenizer = tokenizer
        self.merges, self.letters, self.space = self.tokenizer.model.tokenize, _byte_letters(), space
        self.mark = space.translate(self.letters)
        self.plain = _Parts(tokenizer, "") if space else self
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        if part.isalpha():  # one part of the pattern: straight to the merges
            ids = array("I", [x.id for x in self.merges(self.mark + (part if part.isascii() else part.encode().decode("latin1").translate(self.letters)))]).tobytes()
        elif part[-1:] in (".", ",") and part[:-1].isalpha():
            ids = self[part[:-1]] + self.plain[part[-1]]
        else:
            ids = self.whole(self.space + part)
        if len(self) < CACHE_PARTS:
            self[part] = ids
        return ids


def encode(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text; equal to encoding each text as a whole."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = _Parts(Tokenizer.from_file(path))
    known, out = _loaded[path], []
    plain = known.plain
    for text in texts:
        if known.added is not None and known.added.search(text):  # tokens of the vocabulary's own in the text are one id
            out.append(known.whole(text))
            continue
        if not _simple(text):
            parts = _CUT.split(text)
            out.append(known.whole(parts[0]) + b"".join([known[x[1:]] for x in parts[1:]]))
            continue
        lines = []
        for line in text.split("\n"):
            parts = line.split(" ")
            lines.append(plain[parts[0]] + b"".join(map(known.__getitem__, parts[1:])))
        out.append(plain["\n"].join(lines))
    return out


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, shards: int = 1) -> DataFrame:
    """Pieces of at most max_tokens ids of each document (its ids, then END_ID; null text: empty), with their checksum.

    Only longer documents are cut; all their pieces but the first have max_tokens ids.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                while hi < len(ids) and (size < 1_000_000 or hi == lo):
                    size += len(texts[hi].as_py() or "")
                    hi += 1
                rows = []
                for d, buf in zip(ids[lo:hi], encode([x or "" for x in texts.slice(lo, hi - lo).to_pylist()], tokenizer_path), strict=True):
                    buf += END_ID.to_bytes(4, "little")
                    n = len(buf) // 4
                    cut = n if n <= max_tokens else n % max_tokens or max_tokens
                    for k, s in enumerate([0, *range(cut, n, max_tokens)]):
                        e = cut if k == 0 else s + max_tokens
                        crc = zlib.crc32(buf[4 * s : 4 * e])
                        rows.append((d, k, s, e - s, crc, zlib.crc32(b"%d %d" % (crc, d or 0), k) % shards))
                lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["_d", "piece", "start", "length", "ids_crc32", "_shard"])

    return docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("_t")).mapInArrow(common.lean(run, "packing"), _PIECES)


class _Bins:
    """Bins of item indexes; bins with room are found by room, their items by length."""

    def __init__(self, lengths: list[int], cap: int):
        self.n, self.cap = lengths, cap
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that still takes it."""
        room, mask = defaultdict(list), 0
        for i in sorted(range(len(self.n)), key=lambda i: -self.n[i]):
            x = self.n[i]
            if above := mask >> x:
                r = x + ((above & -above).bit_length() - 1)
                b = room[r].pop()
                if not room[r]:
                    mask ^= 1 << r
            else:
                b, r = len(self.items), self.cap
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += x
            if left := r - x:
                if not room[left]:
                    mask |= 1 << left
                room[left].append(b)

    def search(self) -> None:
        """Exchanges that fill the fuller of two underfull bins, so that the sum of squared fills grows, until none helps."""
        self.where = defaultdict(dict)  # length -> {item: bin}, of underfull bins
        self.mask = 0
        for b, items in enumerate(self.items):
            if self.fill[b] < self.cap:
                for i in items:
                    self._list(i, b)
        changed = 1
        while changed:  # the sum of squared fills grows with each, so this ends
            changed = 0
            for b in sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.cap), key=lambda b: -self.fill[b]):
                while 0 < self.fill[b] < self.cap and self._improve(b):
                    changed += 1

    def _list(self, i: int, b: int) -> None:
        self.where[self.n[i]][i] = b
        self.mask |= 1 << self.n[i]

    def _unlist(self, i: int) -> None:
        of = self.where[self.n[i]]
        of.pop(i, None)
        if not of:
            self.mask &= ~(1 << self.n[i])

    def _from(self, x: int, b: int, taken: int = -1) -> int:
        """An item of length x in a bin no fuller than b."""
        for i, a in reversed(self.where[x].items()):
            if a != b and i != taken and self.fill[a] <= self.fill[b]:
                return i
        return -1

    def _takes(self, b: int, give: int, i: int, j: int) -> int:
        """The bin of i or j that may take give back so that the sum of squared fills grows; -1 if none."""
        x, z, fill = self.n[i], self.n[j], self.fill
        p, q = self.where[x][i], self.where[z][j]
        if p == q:
            return p
        up = (fill[b] + x + z - give) ** 2 - fill[b] ** 2
        for to, own, other, away in ((p, x, q, z), (q, z, p, x)):
            now = fill[to] - own + give
            if now <= self.cap and up + now**2 - fill[to] ** 2 + (fill[other] - away) ** 2 - fill[other] ** 2 > 0:
                return to
        return -1

    def _improve(self, b: int) -> bool:
        room, best = self.cap - self.fill[b], (0, None, (), -1)
        for y in {-1: 0} | {self.n[i]: 1 for i in self.items[b]}:
            give = 0 if y == -1 else y
            top = self.mask & ((1 << (give + room + 1)) - 1)
            while top and best[0] < room:  # one for one, or a move
                x = top.bit_length() - 1
                if x - give <= best[0]:
                    break
                if (i := self._from(x, b)) >= 0:
                    best = (x - give, y, (i,), self.where[x][i])
                    break
                top ^= 1 << x
            first = self.mask & ((1 << (give + room)) - 1)
            while first and best[0] < room:  # two for one
                x = first.bit_length() - 1
                rest = self.mask & ((1 << min(x + 1, give + room - x + 1)) - 1)
                if rest:
                    z = rest.bit_length() - 1
                    if x + z - give > best[0] and (i := self._from(x, b)) >= 0 and (j := self._from(z, b, i)) >= 0:
                        if (to := self._takes(b, give, i, j)) >= 0:
                            best = (x + z - give, y, (i, j), to)
                first ^= 1 << x
            if best[0] == room:
                break
        gain, y, come, to = best
        if not gain:
            return False
        back = next((i for i in self.items[b] if self.n[i] == y), -1)
        for i in come:
            self._move(i, self.where[self.n[i]][i], b)
        if back >= 0:
            self._move(back, b, to)
        if self.fill[b] == self.cap:
            for i in self.items[b]:
                self._unlist(i)
        return True

    def _move(self, i: int, a: int, b: int) -> None:
        self.items[a].remove(i)
        self.fill[a] -= self.n[i]
        self.items[b].append(i)
        self.fill[b] += self.n[i]
        self._list(i, b)


def pack_lengths(lengths: list[int], cap: int = MAX_TOKENS) -> list[list[int]]:
    """Bins (lists of indexes) of lengths from 1 to cap, none over cap."""
    bins = _Bins(lengths, cap)
    bins.best_fit()
    bins.search()
    return [x for x in bins.items if x]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Sequences of at most max_tokens ids that hold all pieces of all documents.

    Pieces are dealt by checksum to shards of about shard_pieces; each is packed by best fit, longest first, and then by local
    search over its underfull bins. A shard ends with about one bin that more documents could have filled.
    Columns: the document's id, piece, start, length, ids_crc32, sequence_id, offset. Null or empty text: one piece of one id.
    Repeated rows are packed once for each row. A null id stays null. No documents: no rows.
    """
    shards = max(1, -(-docs.count() // shard_pieces))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_d", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        n = pdf["length"].tolist()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for b, items in enumerate(pack_lengths(n, max_tokens)):
            at = 0
            for i in items:
                seq[i], off[i] = b, at
                at += n[i]
        pdf["sequence_id"], pdf["offset"] = seq + pdf["_shard"].to_numpy(np.int64) * (1 << 32), off
        return pdf[["_d", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    pieces = tokenize(docs, tokenizer_path, id_col, text_col, max_tokens, shards)
    out = pieces.groupBy("_shard").applyInPandas(one, "_d long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("_d", id_col)
