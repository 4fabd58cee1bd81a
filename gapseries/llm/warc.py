"""WARC archives: a writer with revisit records, and a reader that salvages what damaged archives still hold.

Archives are written by Spark's own text writer, a record to a row, so commits and lost executors are Spark's business: a gzip
member of less than 16 MiB always ends with a zero byte (the top byte of its length), which serves as line separator; larger
records are followed by an empty member, which ends with one as well. Archives are read back with Spark's binaryFile source.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT_BYTES = 1000
RECORDS_PER_ARCHIVE = 4000
#: Rows of the table of repeated payloads (20-byte digest and id) that may be broadcast.
BROADCAST_ROWS = 100_000

RECORD = "path string, at long, size long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
GAP = "path string, at long, size long, reason string"
_CRLF, _END = b"\r\n", b"\r\n\r\n"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CHUNK = 1 << 16


def _member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(record) + c.flush()
    if out[-1]:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += c.compress(b"") + c.flush()
    return out


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record without its gzip frame; with refers_to a revisit, whose block is the response's head only."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + _END + block + _END


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", compress: bool = True, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """A record for each row of pages, payload the body in UTF-8 (null: empty), as archives under path.

    Of equal payloads of at least min_bytes the one with the largest id is a response, the others revisit it; a row repeated with
    that id and payload is a response each time. Null ids count as smaller than any; a group of null ids only is all responses.
    """
    p = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary").alias("_body"))
    p = p.withColumn("_sha", F.sha1("_body"))
    same = p.filter(F.octet_length("_body") >= min_bytes).groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1").select("_sha", "_keep")
    same = common.materialize(same, "payloads")
    p = p.join(common.broadcast_if(same, same.count(), BROADCAST_ROWS), "_sha", "left")
    p = p.withColumn("_refers", F.when(F.col("_keep") != F.coalesce("_id", F.lit(common.NO_ID)), F.col("_keep")))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True)
                made = (build_record(d, u, body, sha, to) for d, u, body, sha, to in rows)
                yield pa.RecordBatch.from_arrays([pa.array([_member(r)[:-1] if compress else r[: -len(_END)] for r in made], pa.binary())], names=["record"])

    rows = p.select("_id", "_url", "_body", "_sha", "_refers").mapInArrow(common.lean(run), "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\0" if compress else "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


def _inflate(buf: memoryview, at: int) -> tuple[bytes, int, str]:
    """What the member at that byte inflates to, where reading it ended, and what is wrong with it, if anything: "truncated",
    "checksum" (all is there, but it fails the member's check), or "damaged" (inflated up to the damage)."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while pos < len(buf) and not d.eof:
            out.append(d.decompress(buf[pos : pos + _CHUNK]))
            pos += _CHUNK
    except zlib.error as e:
        d, last = zlib.decompressobj(31), pos  # again, and byte by byte through the chunk that failed
        for p in range(at, last, _CHUNK):
            d.decompress(buf[p : p + _CHUNK])
        try:
            while pos < len(buf):
                out.append(d.decompress(buf[pos : pos + 1]))
                pos += 1
        except zlib.error:
            pass
        if "incorrect data check" in str(e):
            return b"".join(out), min(pos + 5, len(buf)), "checksum"  # its last byte, and the length after it
        return b"".join(out), min(pos + 1, len(buf)), "checksum" if "incorrect length check" in str(e) else "damaged"
    return b"".join(out), min(pos, len(buf)) - len(d.unused_data), "" if d.eof else "truncated"


def _compressed(buf: memoryview, at: int, size: int) -> int:
    """Where the bytes end that all but the last of the first size bytes of the member's data were inflated from."""
    d, pos, size = zlib.decompressobj(31), at, size - 1
    while size > 0:
        piece = buf[pos : pos + _CHUNK]
        size -= len(d.decompress(piece, size))
        pos += len(piece) - len(d.unconsumed_tail)
    return pos


def _record(data: bytes, at: int, proven: bool = False) -> tuple[dict, int] | str:
    """The record whose version line stands at that byte, checked, and where it ends; else what is wrong. If proven, only a
    record with a digest of its whole block counts."""
    cut = data.find(_END, at) - at
    if cut < 0:
        return "header without end"
    head = {}
    for line in data[at : at + cut].decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            return "bad header line"
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        return "no length"
    start = at + cut + len(_END)
    stop = start + int(head["content-length"])
    if data[stop : stop + len(_END)] != _END:
        return "no end where its length says"
    block = data[start:stop]
    said = head.get("warc-block-digest", "").rpartition(":")[2]
    if proven and not said:
        return "no block digest in a damaged member"
    if said and said != hashlib.sha1(block).hexdigest():
        return "block digest differs"
    web, _, body = block.partition(_END)
    digest, kind = head.get("warc-payload-digest", "").rpartition(":")[2], head.get("warc-type", "")
    if kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", web)
        size, body = int(m[1]) if m else None, None
    else:
        if digest and digest != hashlib.sha1(body).hexdigest():
            return "payload digest differs"
        digest, size = hashlib.sha1(body).hexdigest(), len(body)
    return {"record_id": head.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, "payload_digest": digest, "payload_bytes": size, "payload": body}, stop + len(_END)


def _within(data: bytes, proven: bool) -> tuple[list[dict], list[tuple[int, int, str]], int]:
    """(records, gaps as first byte, last and reason, where the last record ends) of a member's data: after a failed check each
    later version line is tried."""
    found, gaps, pos, bad, end = [], [], 0, None, 0
    while pos < len(data):
        r = _record(data, pos, proven) if data[pos : pos + 7] == b"WARC/1." else "no version line"
        if isinstance(r, str):
            bad = bad or (pos, r)
            m = _VERSION.search(data, pos + 1)
            pos = m.start() if m else len(data)
            continue
        if bad:
            gaps.append((bad[0], pos, bad[1]))
            bad = None
        found.append(r[0])
        pos = end = r[1]
    if bad:
        gaps.append((bad[0], len(data), bad[1]))
    return found, gaps, end


def salvage(content: bytes):
    """("record", at, size, fields) and ("gap", at, size, reason) in order; together they cover the archive.

    After a failed check the reader tries each later gzip magic or version line until one begins a record that passes all checks;
    the bytes between are a gap. An empty archive yields nothing. A member may hold several records, or none.

    Within a member too each later version line is tried; at and size are the member's, and a gap's reason names its bytes of the
    member's data. Of a member that is cut off the records before the cut stand; of a damaged one, or one of several records that
    fails the member's checksum, those that their own block digest proves. That checksum is the only record's own if there is but one.
    """
    content = bytes(content)
    buf, at, bad, reason = memoryview(content), 0, -1, ""
    while at < len(buf):
        found, gaps, end, why = [], [], at, "no record starts here"
        if content[at : at + 3] == b"\x1f\x8b\x08":
            data, end, wrong = _inflate(buf, at)
            found, gaps, last = _within(data, wrong in ("damaged", "checksum"))
            if wrong == "checksum" and len(found) == 1 and not gaps:
                found = []
            if wrong in ("truncated", "damaged") and found:
                end = _compressed(buf, at, last)
                gaps = [g for g in gaps if g[0] < last]
            why = "" if found or not (wrong or gaps) else "damaged member" if wrong else gaps[0][2]
        elif content[at : at + 7] == b"WARC/1.":
            r = _record(content, at)
            if isinstance(r, str):
                why = r
            else:
                found, end, why = [r[0]], r[1], ""
        if why:
            bad, reason = (at, why) if bad < 0 else (bad, reason)
            m = _START.search(content, at + 1)
            at = m.start() if m else len(buf)
            continue
        if bad >= 0:
            yield "gap", bad, at - bad, reason
            bad = -1
        for r in found:
            yield "record", at, end - at, r
        for lo, hi, what in gaps:
            yield "gap", at, end - at, f"{what} (bytes {lo} to {hi} of the member's data)"
        at = end
    if bad >= 0:
        yield "gap", bad, len(buf) - bad, reason


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of all archives under path, and the gaps (quarantined byte ranges with the reason of the first failure).

    Without payload the payload column is null. What is taken of damaged members is said at salvage.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(want):
        names = [x.split()[0] for x in (RECORD if want == "record" else GAP).split(", ")]

        def of(batches):
            schema = pa.schema([(n, {"at": pa.int64(), "size": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])
            for b in batches:
                for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    rows, held = [], 0
                    for kind, at, size, what in salvage(content.as_py()):
                        if kind == want:
                            row = {"path": file, "at": at, "size": size} | ({"reason": what} if want == "gap" else what | ({} if payload else {"payload": None}))
                            rows.append(row)
                            held += len(row.get("payload") or b"") + 500
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

        return of

    return files.mapInArrow(common.lean(run("record")), RECORD), files.mapInArrow(common.lean(run("gap")), GAP)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that write_archives made."""
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
