"""Length-delimited binary records of token ids, with an offset index beside each file.

Record: u64 payload length, u32 masked checksum of those 8 bytes, payload, u32 masked checksum
of the payload; all little-endian. Checksum: CRC-32 (zlib's polynomial), rotated and shifted so
that a checksum of data that hold checksums stays useful. Payload: flags (bit 0: has an id),
bytes in an id of a token (2 or 4), i64 document id, token ids. Index: u64 record offsets and,
last, the file's length, framed as one record.

Files are written and read through the shared folder. A file's name holds its attempt; only
what a committed task reported in the manifest counts, so lost executors leave no effect.

Defined results: a null or empty text gives a record of the end id alone; null ids come first;
ids are integers (others raise); rows of equal ids are in order of their text's hash; an empty table gives no file; a damaged
record raises ValueError with its file and offset. Only the id and the text are read, so other columns' names
can't clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, open_fs, scan_partitions, scratch, ship, table, text_of
from .tokens import encoder, largest_id, public_path

#: Added to a rotated checksum (fixed value).
MASK_DELTA = 0xA282EAD8
#: Pieces that a worker keeps encoded.
CACHED = 1_300_000
HEAD = struct.Struct("<QI")
CRC = struct.Struct("<I")
META = struct.Struct("<BBq")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, CRC.pack(masked(n)), payload, CRC.pack(masked(payload))))


def unframe(f, where: str) -> bytes | None:
    """The next payload of a file object; None at its end."""
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or HEAD.unpack(head)[1] != masked(head[:8]):
        raise ValueError(f"damaged record length in {where}")
    n = HEAD.unpack(head)[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or CRC.unpack_from(body, n)[0] != masked(body[:n]):
        raise ValueError(f"damaged record in {where}")
    return body[:n]


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    import numpy as np

    body = ids
    if width == 2:
        wide = np.frombuffer(ids, "<u4")
        if wide.max(initial=0) > 0xFFFF:
            raise ValueError(f"id {wide.max()} doesn't fit two bytes")
        body = wide.astype("<u2").tobytes()
    return META.pack(doc_id is not None, width, doc_id or 0) + body


def ids_of(payload: bytes) -> tuple[int | None, bytes]:
    import numpy as np

    has, width, doc_id = META.unpack_from(payload)
    body = payload[META.size :]
    return doc_id if has else None, np.frombuffer(body, "<u2").astype("<u4").tobytes() if width == 2 else body


class RecordFile:
    """Random access to one file through its index."""

    def __init__(self, path: str, index_path: str):
        import numpy as np

        self.path = path
        fs, p = open_fs(index_path)
        with fs.open_input_stream(p) as f:
            self.offsets = np.frombuffer(unframe(f, index_path), "<u8")
        fs, p = open_fs(path)
        self.file = fs.open_input_file(p)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def get(self, i: int) -> tuple[int | None, bytes]:
        self.file.seek(int(self.offsets[i]))
        return ids_of(unframe(self.file, f"{self.path} at {self.offsets[i]}"))

    def close(self) -> None:
        self.file.close()


MANIFEST = "part long, path string, index_path string, n_records long, n_tokens long, n_bytes long"


def _write(batches: Iterable, folder: str, path: str, eos: int, width: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, enc, end = TaskContext.get().partitionId(), encoder(path, CACHED), eos.to_bytes(4, "little")
    name = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.rec"
    fs, p = open_fs(name)
    fs.create_dir(open_fs(folder)[1], recursive=True)
    offsets, at, tokens = [], 0, 0
    out = None
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            out = out or fs.open_output_stream(p, buffer_size=1 << 20)
            ids = enc.encode(text) + end
            record = frame(payload_of(doc_id, ids, width))
            out.write(record)
            offsets.append(at)
            at += len(record)
            tokens += len(ids) // 4
    if out is None:
        return
    out.close()
    with fs.open_output_stream(p + ".idx") as f:
        f.write(frame(np.array([*offsets, at], "<u8").tobytes()))
    yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "index_path": name + ".idx", "n_records": len(offsets), "n_tokens": tokens, "n_bytes": at}])


def write(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *, eos: int = 2, vocabulary: int | None = None, partitions: int | None = None) -> DataFrame:
    """Write the ids of docs in ascending order of id; the manifest, one row for each file.
    Ids take two bytes where the vocabulary (by default the tokenizer's) and eos allow; one that doesn't fit raises."""
    spark = docs.sparkSession
    ship(spark)
    width = 2 if max(largest_id(tokenizer_path) if vocabulary is None else vocabulary - 1, eos) < 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions or scan_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return materialise(dealt.mapInArrow(lambda it: _write(it, folder, tokenizer_path, eos, width), MANIFEST), "records-manifest")


ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _read(batches: Iterable) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for b in batches:
        for row in b.to_pylist():
            f, start, out, size = RecordFile(row["path"], row["index_path"]), row["base"], [], 0
            for i in range(len(f)):
                doc_id, ids = f.get(i)
                out.append((doc_id, start, len(ids) // 4, ids))
                start, size = start + len(ids) // 4, size + len(ids)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            f.close()


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the files in the manifest: doc_id, start (ids before it, over all
    files), n_tokens, ids. The running total is over one row for each file."""
    spark = manifest.sparkSession
    ship(spark)
    base = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    files = manifest.withColumn("base", base).select("part", "path", "index_path", "base")
    return files.repartition(scan_partitions(spark)).mapInArrow(_read, ROWS)


def op6_query(spark, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), scratch(spark, "records"))
    return read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
