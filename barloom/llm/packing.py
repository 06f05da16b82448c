"""Hierarchical multi-length packing of token ids.

Each scan task encodes its documents and packs them by itself, so nothing is shuffled. A
document gives whole long windows first; its rest goes to the smallest context tier that
holds it. Tier by tier, from the longest, the largest piece opens a window, the gap is filled
by the largest shorter pieces that fit, and the last of it by the head of one piece that is
cut. What a task can't complete at its end is cut into windows of powers of two. So every
sequence has a power of two of tokens and needs no padding. Windows of a flush are dealt to
step groups, largest first, each to the group with the fewest tokens.

Defined results: a null or empty text is a document of the end id alone; ids are integers
(others raise) or null; repeated rows and
ids are separate documents; an empty table gives no pieces; a document longer than the
longest window is cut, never shortened. Only the id and the text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table, text_of
from .tokens import encoder, public_path

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window int, step_group long, ids binary"


class TierPacker:
    """Packs (document, start, length) pieces into windows whose lengths are the tiers."""

    def __init__(self, tiers: tuple[int, ...], flush_tokens: int, step_tokens: int):
        self.tiers = tuple(sorted(tiers))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.longest = self.tiers[-1]
        self.flush_tokens, self.step_tokens = flush_tokens, step_tokens
        #: What waits, (document, start) by length in order of arrival; the bits of `lengths` are those in use.
        self.waiting: list[deque] = [deque() for _ in range(self.longest + 1)]
        self.lengths = self.tokens = self.groups = 0

    def _wait(self, doc, start: int, length: int) -> None:
        self.waiting[length].append((doc, start))
        self.lengths |= 1 << length
        self.tokens += length

    def _take(self, most: int) -> tuple | None:
        """The longest piece of at most that length, of equal ones the first; None without one."""
        length = (self.lengths & ((2 << most) - 1)).bit_length() - 1
        return self._taken(length, self.waiting[length].popleft()) if length >= 0 else None

    def _take_shortest(self) -> tuple | None:
        """The shortest piece, of equal ones the last; None without one."""
        length = (self.lengths & -self.lengths).bit_length() - 1
        return self._taken(length, self.waiting[length].pop()) if length >= 0 else None

    def _taken(self, length: int, piece: tuple) -> tuple:
        if not self.waiting[length]:
            self.lengths ^= 1 << length
        self.tokens -= length
        return (length, *piece)

    def add(self, doc, length: int) -> Iterator[tuple]:
        """Windows that became complete: (window, group, [(doc, start, length), ...])."""
        start = 0
        full = []
        while length - start >= self.longest:
            full.append((self.longest, [(doc, start, self.longest)]))
            start += self.longest
        if full:
            yield from self._grouped(full)
        if start < length:
            self._wait(doc, start, length - start)
        if self.tokens >= self.flush_tokens:
            yield from self._grouped(self._windows())

    def finish(self) -> Iterator[tuple]:
        done = self._windows()
        left = self.tokens
        window, filled = [], 0
        size = 1 << (left.bit_length() - 1) if left else 0
        size = min(size, self.longest)
        while piece := self._take(self.longest):
            length, doc, start = piece
            while length:
                take = min(length, size - filled)
                window.append((doc, start, take))
                filled, start, length, left = filled + take, start + take, length - take, left - take
                if filled == size:
                    done.append((size, window))
                    window, filled = [], 0
                    size = min(1 << (left.bit_length() - 1) if left else 0, self.longest)
        yield from self._grouped(done)

    def _tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def _windows(self) -> list[tuple]:
        done, held = [], []
        while piece := self._take(self.longest):
            length, doc, start = piece
            size = self._tier(length)
            if self.tokens + length < size:  # can't be completed with what waits
                held.append(piece)
                continue
            window, gap = [(doc, start, length)], size - length
            while gap:
                if piece := self._take(gap):
                    n, d, s = piece
                elif piece := self._take_shortest():  # none fits: cut the shortest
                    whole, d, s = piece
                    n = gap
                    self._wait(d, s + n, whole - n)
                else:
                    break
                window.append((d, s, n))
                gap -= n
            done.append((size, window))
        for length, doc, start in held:
            self._wait(doc, start, length)
        return done

    def _grouped(self, windows: list[tuple]) -> Iterator[tuple]:
        if not windows:
            return
        k = max(1, round(sum(w for w, _ in windows) / self.step_tokens))
        heap = [(0, self.groups + g) for g in range(k)]
        self.groups += k
        for size, pieces in sorted(windows, key=lambda w: -w[0]):
            load, g = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, g))
            yield size, g, pieces


def _pack(batches: Iterable, path: str, eos: int, tiers: tuple[int, ...], flush_tokens: int, step_tokens: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    enc, packer, end = encoder(path), TierPacker(tiers, flush_tokens, step_tokens), eos.to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in PIECES.split(", ")]
    cols: list[list] = [[] for _ in names]
    sequence = held = 0

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        for c in cols:
            c.clear()
        return out

    def take(windows: Iterable) -> Iterator:
        nonlocal sequence, held
        for size, group, pieces in windows:
            offset = 0
            for (doc_id, ids), start, length in pieces:
                for c, v in zip(cols, (doc_id, start, length, len(ids) // 4, base + sequence, offset, size, base + group, ids[4 * start : 4 * (start + length)]), strict=True):
                    c.append(v)
                offset += length
            sequence += 1
            held += 4 * offset
            if held > 4 << 20:
                yield batch()
                held = 0

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = enc.encode(text) + end
            yield from take(packer.add((doc_id, ids), len(ids) // 4))
    yield from take(packer.finish())
    if cols[0]:
        yield batch()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    eos: int = 2,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048, 4096),
    flush_tokens: int = 1 << 20,
    step_tokens: int = 1 << 16,
) -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, tokenizer_path, eos, tiers, flush_tokens, step_tokens), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the packed corpus."""
    return digest(pack(docs, public_path("word_bpe_49k.json")))
