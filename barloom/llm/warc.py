"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The writer makes one record of each page, a gzip member each. Pages of equal payload refer to
the one with the smallest id. The reader checks every member: gzip trailer, version line,
header, declared length, end marker and block digest. Where a check fails it searches for the
next position that passes them all (a gzip member, or a version line in a plain file), goes on
there and reports the bytes between as a quarantined gap. Within a gzip member it searches the
inflated bytes, and of a member that is cut off it keeps the complete records; a member that
fails gzip's own checks is a gap as a whole. Gaps are rows of the result, and the workers log
each. A task holds one file at a time. Headers may have any length where a record is due: at the start
of a file or member, and after a valid record. At places that are only searched in damaged bytes they must
end within MOST_HEADER bytes, else every false start would read on.

Defined results: records of other writers have no page_id unless their id is of this form
(record_id has it as written); of other types than HTTP ones the payload is the block; a length
that isn't a number is null; a null html is an empty payload; null or odd URLs are percent-escaped; a null
page id is written as empty and never chosen as the record that others refer to, unless alone;
rows that repeat the smallest id of their payload are all responses; an empty table gives no
archive; a file without any valid record gives one gap.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, open_fs, scan_partitions, scratch, ship, table, text_of

URN = "urn:barloom:page:"
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: Bytes in which the header of a record that was searched for ends.
MOST_HEADER = 1 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), value)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        if not self.headers.get("content-type", "").lower().startswith("application/http"):
            return {}, self.block
        head, _, payload = self.block.partition(END)
        lines = head.decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


@dataclass
class Gap:
    """Bytes from start to end that hold no valid record."""

    start: int
    end: int
    reason: str


def build(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header, with the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *([("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def member(record: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Damaged(Exception):
    pass


def _parse(data: bytes, at: int, due: bool) -> tuple[Record, int]:
    """The record that starts at `at` of plain data, and where it ends. due: whether it must start there."""
    if not data.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    stop = data.find(END, at) if due else data.find(END, at, at + MOST_HEADER)
    if stop < 0:
        raise Damaged("header without end")
    try:
        lines = data[at:stop].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        raise Damaged("header isn't UTF-8") from None
    headers = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    body = stop + len(END)
    end = body + int(length)
    if data[end : end + 4] != END:
        raise Damaged("no end marker after the declared length")
    block = data[body:end]
    said = headers.get("warc-block-digest")
    if said and said.lower().startswith("sha1:") and said[5:] != digest(block):
        raise Damaged("block digest differs")
    return Record(headers, block, at), end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at `at` holds, where it ends, and whether the file ends before it."""
    z, out, pos, step = zlib.decompressobj(31), [], at, 1 << 16
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos : pos + step]))
            pos += step
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), not z.eof


def _member(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """The valid records of the gzip member at `at`, the gaps between them, and where it ends.
    The bytes of such a gap are those of the member; its reason has the inflated ones."""
    plain, end, cut = _inflate(data, at)
    out, pos, hole, reason, first = [], 0, None, "", ""
    while pos < len(plain):
        try:
            r, after = _parse(plain, pos, hole is None)
        except Damaged as e:
            if hole is None:
                hole, reason = pos, str(e)
                first = first or reason
            pos = plain.find(VERSION[:7], pos + 1)
            pos = len(plain) if pos < 0 else pos
            continue
        if hole is not None:
            out.append(Gap(at, end, f"{reason}; inflated bytes {hole} to {pos}"))
            hole = None
        r.offset = at
        out.append(r)
        pos = after
    if not any(isinstance(x, Record) for x in out):
        raise Damaged("member is cut off" if cut else first or "empty member")
    if hole is not None or cut:
        hole = len(plain) if hole is None else hole
        out.append(Gap(at, end, f"{'member is cut off' if cut else reason}; inflated bytes {hole} to {len(plain)}"))
    return out, end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of a file, gzip members or plain, and the gaps between them."""
    at, gap, reason = 0, None, ""
    # Where each marker occurs next: looked for again only once it is passed.
    ahead = {b"\x1f\x8b\x08": -1, b"WARC/1.": -1}
    while at < len(data):
        zipped = data.startswith(b"\x1f\x8b", at)
        try:
            if zipped:
                found, end = _member(data, at)
            else:
                r, end = _parse(data, at, gap is None)
                found = [r]
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            for mark, next_ in ahead.items():
                if next_ <= at:
                    found_at = data.find(mark, at + 1)
                    ahead[mark] = found_at if found_at >= 0 else len(data)
            at = min(ahead.values())
            continue
        if gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Gap(gap, len(data), reason)


MANIFEST = "path string, n_records long, n_bytes long"


def _write(batches: Iterable, folder: str, rotate: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    part, k, out, n, size, done = TaskContext.get().partitionId(), 0, None, 0, 0, []
    tag, path = uuid.uuid4().hex, ""
    fs, p = open_fs(folder)
    fs.create_dir(p, recursive=True)
    for b in batches:
        for row in b.to_pylist():
            if out is None:
                path = f"{folder}/pages-{part:06d}-{k:04d}-{tag}.warc.gz"
                out, n, size, k = fs.open_output_stream(open_fs(path)[1], compression=None), 0, 0, k + 1
            data = member(build(row["page_id"], row["url"], row["payload"], row["first_id"], row["revisit"]))
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= rotate:
                out.close()
                out = None
                done.append({"path": path, "n_records": n, "n_bytes": size})
    if out is not None:
        out.close()
        done.append({"path": path, "n_records": n, "n_bytes": size})
    if done:
        yield pa.RecordBatch.from_pylist(done)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_revisit: int = 0, rotate: int = 64 << 20) -> DataFrame:
    """Write the pages as archives of about `rotate` bytes; the manifest, a row a file.
    Payloads that occur once need no partner: only the owners of repeated ones are joined."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.encode(text_of(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("sha"))
    again = rows.where(F.octet_length("payload") >= least_revisit).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    again = materialise(again.select(F.col("sha").alias("first_sha"), "first_id"), "warc-owners")
    df = rows.join(again, F.col("sha") == F.col("first_sha"), "left")
    df = df.withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).drop("sha", "first_sha")
    return materialise(df.mapInArrow(lambda it: _write(it, folder, rotate), MANIFEST), "warc-manifest")


ROWS = "path string, start long, end long, kind string, record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string"


def _read(batches: Iterable) -> Iterator:
    import pyarrow as pa

    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in ROWS.split(", ")]
    own = re.compile(rf"<?{re.escape(URN)}(-?[0-9]+)>?")
    log = logging.getLogger("barloom.warc")

    def number(v: str | None) -> int | None:
        m = own.fullmatch(v or "")
        return int(m[1]) if m else None

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            log.warning("quarantined bytes %d to %d of %s: %s", x.start, x.end, path, x.reason)
            return path, x.start, x.end, "gap", None, None, None, None, None, None, None, None, x.reason
        http, payload = x.http()
        revisit = x.type == "revisit"
        said = x.headers.get("warc-payload-digest", "").partition(":")[2]
        told = http.get("content-length", "")
        size = (int(told) if told.isascii() and told.isdigit() else None) if revisit else len(payload)
        return path, x.offset, None, "record", x.type, x.headers.get("warc-record-id"), number(x.headers.get("warc-record-id")), x.headers.get("warc-target-uri"), size, said if revisit else digest(payload), number(x.headers.get("warc-refers-to")), None if revisit else payload, None

    for b in batches:
        for path in b.column(0).to_pylist():
            fs, p = open_fs(path)
            with fs.open_input_file(p) as f:
                data = f.read()
            out, size = [], 0
            for x in salvage(data):
                out.append(row(path, x))
                size += out[-1][8] or 0
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read(manifest: DataFrame) -> DataFrame:
    """Records (kind 'record') and quarantined gaps (kind 'gap', start to end, reason) of the files
    in column path."""
    spark = manifest.sparkSession
    ship(spark)
    return manifest.select("path").repartition(scan_partitions(spark)).mapInArrow(_read, ROWS)


def op3_query(spark, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read(manifest).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hexed, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(('0x' || substr(hexed, CAST(1 + 5 * (i // 4) AS INTEGER), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p
"""
