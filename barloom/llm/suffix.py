"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of `span` bytes that covers it also starts earlier in the corpus. Equal
strings share their minimizer (the smallest hash among the k-grams in them), so each document
sends its minimizers, with two 64-bit hashes that stand for the minimizer and for all bytes that
strings around it can touch. Hashes route, and they settle places that agree in both: all but
the first are repeats. Map tasks settle their own first, so a text that is everywhere sends one
entry a task. Minimizers with different surroundings are where repeats begin and end: one place
of each surrounding is fetched, cut to the strings that occur twice, and what differs goes to a
suffix array, in which equal strings are neighbours. A task holds the segments of some
minimizers at a time, up to SHARD bytes. A minimizer with more than HOT surroundings isn't
gathered: its strings are counted each by themselves (two 64-bit hashes), over all tasks.

The suffix array is built by grouping: suffixes are grouped by their longest Lyndon prefix,
groups are processed in descending order, each moves the previous smaller suffixes of its
members into new groups right above their old ones, and a final scan emits the order within
each group. Groups are integers in a linked list: nothing is renamed, concatenated or sorted
again, and the work is linear.

Defined results: a null text counts as empty; a text shorter than the span loses nothing; ids
are integers (others raise); rows are ordered by id, nulls first, then by a hash of their text;
repeated rows are separate documents; columns of other names don't matter; an empty table gives
an empty result. Strings in a shard are compared by their bytes; elsewhere they are equal if
two 64-bit hashes are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scan_partitions, ship, table, text_of

K = 32
#: Odd multipliers (fixed values).
ODD, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
POS_BITS = 24
#: Places a minimizer may have with different surroundings to be gathered; bytes sorted at once.
HOT, SHARD = 1 << 14, 1 << 20


def suffix_array(t: bytes) -> list[int]:
    """Starts of all suffixes of t in order."""
    n = len(t)
    letters = sorted(set(t))
    number = [0] * 256
    for k, c in enumerate(letters):
        number[c] = k
    # Groups from 0 up, linked in their order; -1 is below and above all.
    group = [number[c] for c in t]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(letters) - 1)), [*range(1, len(letters)), -1]
    before = list(range(-1, n - 1))  # becomes the previous smaller suffix
    done = bytearray(n)
    size = [0] * len(letters)
    now = len(letters) - 1
    while now >= 0:
        mine = [i for i in members[now] if group[i] == now]  # others have moved on
        members[now] = []
        size[now] = len(mine)
        for i in mine:
            done[i] = 1
        times: dict[int, int] = {}
        for i in mine:
            p = before[i]
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):  # the oftener, the higher above the old group
            moved: dict[int, int] = {}
            for p in by_times[k]:
                old = group[p]
                new = moved.get(old, -1)
                if new < 0:
                    new = moved[old] = len(members)
                    members.append([])
                    size.append(0)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                group[p] = new
                members[new].append(p)
        now = below[now]
    head, at = [0] * len(members), 0
    g = 0 if letters else -1
    while g >= 0:
        head[g] = at
        at += size[g]
        g = above[g]
    out = [0] * n
    placed = bytearray(n)
    for k in range(-1, n):
        p = (out[k] if k >= 0 else n) - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            out[head[group[p]]] = p
            head[group[p]] += 1
            p = before[p]
    return out


def repeats(segments: list[bytes], order: list[tuple], span: int) -> list[tuple[int, int]]:
    """(segment, start) of each string of span bytes that an earlier place has too. order: a
    sortable place for the start of each segment; later bytes are later in the last item."""
    text = b"\0".join(segments) + b"\0"
    starts, at = [], 0
    for s in segments:
        starts.append(at)
        at += len(s) + 1
    which, offset = [], []
    for k, s in enumerate(segments):
        which += [k] * (len(s) + 1)
        offset += range(len(s) + 1)
    out: list[tuple[int, int]] = []

    def settle(run: list[tuple[int, int]]) -> None:
        if len(run) > 1:
            # Segments may overlap, so one place can occur twice.
            places = [(*order[k][:-1], order[k][-1] + o) for k, o in run]
            first = min(places)
            out.extend(x for x, place in zip(run, places, strict=True) if place != first)

    run, head = [], None
    for i in suffix_array(text):
        k, o = which[i], offset[i]
        if o + span > len(segments[k]):
            continue
        s = text[i : i + span]
        if s != head:
            settle(run)
            run, head = [], s
        run.append((k, o))
    settle(run)
    return out


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _grams(data, sizes: tuple[int, ...]) -> dict:
    """Hashes of all strings of the given sizes (powers of two), by doubling."""
    import numpy as np

    h = _mix(np.arange(1, 257, dtype=np.uint64))[data]
    out, w = {1: h}, 1
    while w < max(sizes):
        h = h[: max(len(h) - w, 0)] * np.uint64(ODD + 2 * w) + h[w:]
        h ^= h >> np.uint64(29)
        w *= 2
        out[w] = h
    return out


def _window_min(x, w: int):
    import numpy as np

    size = 1
    while 2 * size <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


def anchors(data: bytes, ends, span: int):
    """(position, hash, surroundings) of the minimizers of all strings of span bytes within the
    documents that end at `ends` in data."""
    import numpy as np

    a = np.frombuffer(data, np.uint8)
    w = span - K + 1
    empty = np.empty(0, np.uint64)
    if len(a) < span:
        return np.empty(0, np.int64), empty, empty
    h = _grams(a, (K,))[K]
    found = []
    block = 1 << (POS_BITS - 2)
    doc_end = np.repeat(ends, np.diff(np.r_[0, ends]))
    for s in range(0, len(a) - span + 1, block):
        e = min(s + block, len(a) - span + 1)  # starts of strings
        part = h[s : e + w - 1]
        keyed = (_mix(part) >> np.uint64(POS_BITS) << np.uint64(POS_BITS)) | np.arange(len(part), dtype=np.uint64)
        low = _window_min(keyed, w)
        low = low[np.arange(s, e) + span <= doc_end[s:e]]
        found.append(np.unique(low & np.uint64((1 << POS_BITS) - 1)).astype(np.int64) + s)
    pos = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    if not len(pos):
        return pos, empty, empty
    stop = doc_end[pos]
    start = np.r_[0, ends][np.searchsorted(ends, pos, side="right")]
    left, right = np.minimum(w - 1, pos - start), np.minimum(span, stop - pos)
    ctx = _mix((left * (span + 1) + right).astype(np.uint64))
    for off in [*range(-(w - 1), span - K, K), span - K]:
        q = np.clip(pos + off, start, stop - K)
        ctx = _mix(ctx * np.uint64(ODD) + h[q])
    return pos, _mix(h[pos] + np.uint64(1)), ctx


PACKED = "kind int, bucket long, a binary, b binary, c binary, d binary, e binary"
MARKS, PLACES, WANTED, COUNTED = 1, 0, 2, 3


def _rows(kind: int, bucket, cols: list) -> Iterator:
    """One row for each bucket, its entries packed by column."""
    import numpy as np
    import pyarrow as pa

    if not len(bucket):
        return
    o = np.argsort(bucket, kind="stable")
    bucket = bucket[o]
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
    cols = [c[o] for c in cols]
    step = 256
    for i in range(0, len(cuts) - 1, step):
        part = list(zip(cuts[i : i + step], cuts[i + 1 : i + step + 1], strict=False))
        out = [pa.array([kind] * len(part), pa.int32()), pa.array(bucket[[x for x, _ in part]].astype(np.int64))]
        out += [pa.array([c[x:y].tobytes() for x, y in part], pa.binary()) for c in cols]
        out += [pa.nulls(len(part), pa.binary())] * (7 - len(out))
        yield pa.RecordBatch.from_arrays(out, names=["kind", "bucket", "a", "b", "c", "d", "e"])


def _marks(docs, low, high, buckets: int) -> Iterator:
    """Starts low to high of repeated strings in documents, dealt by document."""
    import numpy as np

    yield from _rows(MARKS, _mix(docs.astype(np.uint64)) % np.uint64(buckets), [docs, low, high])


def _split_firsts(h, ctx, doc, pos, low, high) -> tuple:
    """Order by (hash, surroundings, document, position): the order, and which are first."""
    import numpy as np

    o = np.lexsort((pos, doc, ctx, h))
    h, ctx = h[o], ctx[o]
    return o, np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])] if len(o) else np.empty(0, bool)


def _send(batches: Iterable, span: int, buckets: int, hold: int = 1_500_000) -> Iterator:
    """Places (PLACES) of the map task's documents, its own repeats settled (MARKS)."""
    import numpy as np

    held: list[list] = []
    n_held = 0

    def flush() -> Iterator:
        nonlocal held, n_held
        if not held:
            return
        h, ctx, doc, pos, low, high = (np.concatenate(c) for c in zip(*held, strict=True))
        held, n_held = [], 0
        o, first = _split_firsts(h, ctx, doc, pos, low, high)
        r = o[~first]
        yield from _marks(doc[r], low[r], high[r], buckets)
        f = o[first]
        # low and high follow from the position and these two.
        yield from _rows(PLACES, h[f] % np.uint64(buckets), [h[f], ctx[f], doc[f], pos[f].astype(np.int32 if pos.max(initial=0) < 1 << 31 else np.int64), np.stack([pos[f] - low[f], high[f] - pos[f]], 1).astype(np.int16)])

    def settle(ids: list, texts: list[bytes]) -> None:
        nonlocal n_held
        ends = np.cumsum([len(x) for x in texts])
        pos, h, ctx = anchors(b"".join(texts), ends, span)
        if not len(pos):
            return
        k = np.searchsorted(ends, pos, side="right")
        start, stop = np.r_[0, ends][k], ends[k]
        low, high = np.maximum(pos - (span - K), start) - start, np.minimum(pos, stop - span) - start
        held.append([h, ctx, np.array(ids, np.int64)[k], pos - start, low, high])
        n_held += len(pos)

    ids, texts, size = [], [], 0
    for b in batches:
        for rid, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if len(content) >= span:
                ids.append(rid)
                texts.append(content)
                size += len(content)
            if size > 1 << 19:
                settle(ids, texts)
                ids, texts, size = [], [], 0
            if n_held > hold:
                yield from flush()
    if texts:
        settle(ids, texts)
    yield from flush()


def _meet(batches: Iterable, buckets: int, hot: int) -> Iterator:
    """Places of all tasks: repeats with equal surroundings become marks; one place of each of
    a minimizer's different surroundings is wanted (WANTED, or COUNTED if there are many)."""
    import numpy as np
    import pyarrow as pa

    got: list[list] = []
    for b in batches:
        kinds = np.array(b.column(0).to_pylist())
        if (kinds == MARKS).any():
            yield b.filter(pa.array(kinds == MARKS))
        for k in np.flatnonzero(kinds == PLACES):
            h, ctx, doc = (np.frombuffer(b.column(c)[k].as_py(), t) for c, t in ((2, np.uint64), (3, np.uint64), (4, np.int64)))
            raw = b.column(5)[k].as_py()
            pos = np.frombuffer(raw, np.int32 if len(raw) == 4 * len(h) else np.int64).astype(np.int64)
            got.append([h, ctx, doc, pos, np.frombuffer(b.column(6)[k].as_py(), np.int16).reshape(-1, 2)])
    if not got:
        return
    h, ctx, doc, pos, reach = (np.concatenate(c) for c in zip(*got, strict=True))
    del got
    low, high = pos - reach[:, 0], pos + reach[:, 1]
    o, first = _split_firsts(h, ctx, doc, pos, low, high)
    r = o[~first]
    yield from _marks(doc[r], low[r], high[r], buckets)
    f = o[first]
    hf = h[f]
    same = np.r_[False, hf[1:] == hf[:-1]] if len(hf) else np.empty(0, bool)
    if not len(f):
        return
    start = np.flatnonzero(~same)
    times = np.repeat(np.diff(np.r_[start, len(f)]), np.diff(np.r_[start, len(f)]))
    for kind, these in ((WANTED, f[(times > 1) & (times <= hot)]), (COUNTED, f[times > hot])):
        yield from _rows(kind, _mix(doc[these].astype(np.uint64)) % np.uint64(buckets), [h[these], doc[these], low[these], high[these]])


def _wanted(batches: Iterable) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for k in range(b.num_rows):
            cols = [np.frombuffer(b.column(c)[k].as_py(), np.int64) for c in (2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "doc", "low", "high"])


def _cut(batches: Iterable, span: int) -> Iterator:
    import pyarrow as pa

    for b in batches:
        out: list[tuple] = []
        for rid, content, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            out += [(p["h"], rid, p["low"], content[p["low"] : p["high"] + span]) for p in places]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h", "doc", "low", "segment"])


def _sorted_repeats(batches: Iterable, span: int, buckets: int, shard: int) -> Iterator:
    """Segments, sorted by minimizer: cut to what occurs twice, then by suffix array. Whole
    minimizers up to `shard` bytes are held at once."""
    held: list[tuple] = []
    size, last = 0, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > shard and row[0] != last:
                yield from _settled(held, span, buckets)
                held, size = [], 0
            held.append(row)
            last, size = row[0], size + len(row[3])
    if held:
        yield from _settled(held, span, buckets)


def _settled(rows: list[tuple], span: int, buckets: int) -> Iterator:
    import numpy as np

    h, doc, low, segs = zip(*rows, strict=True)
    h, doc, low = (np.array(c, np.int64) for c in (h, doc, low))
    sizes = np.array([len(s) for s in segs])
    ends = np.cumsum(sizes)
    a = np.frombuffer(b"".join(segs), np.uint8)
    size = 1 << (span.bit_length() - 1)
    g = _grams(a, (size,))[size]
    n = len(a) - span + 1
    owner = np.repeat(np.arange(len(segs)), sizes)[:n]
    inside = np.arange(n) + span <= ends[owner]
    name = _mix(_mix(g[:n] * np.uint64(3) + g[span - size : span - size + n]) ^ _mix(h.view(np.uint64))[owner])
    at = np.flatnonzero(inside)
    _, back, count = np.unique(name[at], return_inverse=True, return_counts=True)
    at = at[count[back] > 1]
    if not len(at):
        return
    own = owner[at]
    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    tails = np.r_[heads[1:], len(at)] - 1
    own, lo, hi = own[heads], at[heads], at[tails]
    begin = (ends - sizes)[own]
    groups: dict[int, dict[bytes, list]] = defaultdict(dict)
    out: list[tuple[int, int, int]] = []
    for k, x, y in zip(own.tolist(), (lo - begin).tolist(), (hi - begin).tolist(), strict=True):
        s = segs[k][x : y + span]
        place = (int(doc[k]), int(low[k]) + x, y - x)
        seen = groups[int(h[k])]
        if s in seen:
            first, later = min(seen[s], place), max(seen[s], place)
            seen[s] = first
            if first != later:
                out.append((later[0], later[1], later[1] + later[2]))
        else:
            seen[s] = place
    for seen in groups.values():
        if len(seen) > 1:
            keys = list(seen)
            out += [(seen[keys[k]][0], seen[keys[k]][1] + o, seen[keys[k]][1] + o) for k, o in repeats(keys, [seen[x][:2] for x in keys], span)]
    if out:
        yield from _marks(*(np.array(c, np.int64) for c in zip(*out, strict=True)), buckets)


STRINGS = "first_half long, last_half long, doc long, start long"


def _strings(batches: Iterable, span: int) -> Iterator:
    """Each string of span bytes around the places of rows (rid, content, places), by the hashes
    of its first and last bytes, which overlap or touch."""
    import numpy as np
    import pyarrow as pa

    size = 1 << (span.bit_length() - 1)
    for b in batches:
        for rid, content, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            low = min(p["low"] for p in places)
            g = _grams(np.frombuffer(content, np.uint8)[low : max(p["high"] for p in places) + span], (size,))[size]
            at = np.unique(np.concatenate([np.arange(p["low"], p["high"] + 1) for p in places]))
            yield pa.RecordBatch.from_arrays([pa.array(g[at - low].view(np.int64)), pa.array(g[at - low + span - size].view(np.int64)), pa.array(np.full(len(at), rid)), pa.array(at)], names=["first_half", "last_half", "doc", "start"])


def _packed(batches: Iterable, buckets: int) -> Iterator:
    """Marks of rows (doc, start)."""
    for b in batches:
        yield from _marks(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(1).to_numpy(), buckets)


def _spans(batches: Iterable, span: int) -> Iterator:
    """doc, starts, ends: the maximal removed runs of each document with marks."""
    import numpy as np
    import pyarrow as pa

    got: list[list] = []
    for b in batches:
        got += [[np.frombuffer(b.column(c)[k].as_py(), np.int64) for c in (2, 3, 4)] for k in range(b.num_rows)]
    if not got:
        return
    doc, low, high = (np.concatenate(c) for c in zip(*got, strict=True))
    del got
    o = np.lexsort((low, doc))
    doc, low, stop = doc[o], low[o], high[o] + span
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    # Running maximum of ends within a document: documents are lifted apart by their rank.
    rank = np.cumsum(new_doc) - 1
    lift = rank * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift) - lift
    head = new_doc | np.r_[True, low[1:] > reach[:-1]]
    heads = np.flatnonzero(head)
    starts, ends, docs = low[heads], reach[np.r_[heads[1:], len(doc)] - 1], doc[heads]
    cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    offsets = pa.array(np.r_[cuts, len(docs)].astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(docs[cuts]), pa.ListArray.from_arrays(offsets, pa.array(starts)), pa.ListArray.from_arrays(offsets, pa.array(ends))], names=["doc", "starts", "ends"])


def _removed(batches: Iterable, keep: bool) -> Iterator:
    import hashlib

    import pyarrow as pa

    for b in batches:
        out = []
        for content, starts, ends in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            left, at = [], 0
            for s, e in zip(starts or (), ends or (), strict=True):
                left.append(content[at:s])
                at = e
            left.append(content[at:])
            rest = b"".join(left)
            out.append((len(content), len(content) - len(rest), len(starts or ()), hashlib.sha256(rest).hexdigest(), rest if keep else None))
        if out:
            cols = list(zip(*out, strict=True))
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), *([pa.array(cols[4], pa.binary())] if keep else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, span: int = 100, keep: bool = False, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if keep, the bytes that are left."""
    if span < K + 1:
        raise ValueError(f"span must be over {K} bytes")
    spark = docs.sparkSession
    ship(spark)
    parts = scan_partitions(spark)
    buckets = max(4096, 8 * parts)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("content"))
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        rows = rows.withColumn("rid", F.col("doc_id"))
    else:  # nulls or repeated ids: number the rows in their order
        dealt = rows.withColumn("tie", F.xxhash64("content")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        rows = materialise(dealt.select("doc_id", "content", F.monotonically_increasing_id().alias("rid")), "suffix-rows")
    sent = rows.select("rid", "content").mapInArrow(lambda it: _send(it, span, buckets), PACKED)
    met = materialise(sent.repartition(parts, "bucket").mapInArrow(lambda it: _meet(it, buckets, hot), PACKED), "suffix-met")
    spark.sparkContext._jvm.System.gc()  # the shuffle of places is over

    def at_places(kind: int) -> DataFrame:
        """rid, content, places of the documents with places of a kind."""
        wanted = met.where(F.col("kind") == kind).mapInArrow(_wanted, "h long, doc long, low long, high long")
        places = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "low", "high")).alias("places"))
        return rows.join(places.hint("merge"), F.col("rid") == F.col("doc")).select("rid", "content", "places")

    cut = at_places(WANTED).mapInArrow(lambda it: _cut(it, span), "h long, doc long, low long, segment binary")
    by_hash = cut.repartition(parts, "h").sortWithinPartitions("h")
    more = materialise(by_hash.mapInArrow(lambda it: _sorted_repeats(it, span, buckets, shard), PACKED), "suffix-more")
    spark.sparkContext._jvm.System.gc()
    marks = met.where(F.col("kind") == MARKS).union(more)
    if not met.where(F.col("kind") == COUNTED).isEmpty():
        strings = materialise(at_places(COUNTED).mapInArrow(lambda it: _strings(it, span), STRINGS), "suffix-strings")
        first = strings.groupBy("first_half", "last_half").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
        late = strings.join(first, ["first_half", "last_half"]).where(F.struct("doc", "start") != F.col("first")).select("doc", "start")
        marks = marks.union(materialise(late.mapInArrow(lambda it: _packed(it, buckets), PACKED), "suffix-late"))
        discard(strings)
    spans = materialise(marks.repartition(parts, "bucket").mapInArrow(lambda it: _spans(it, span), "doc long, starts array<long>, ends array<long>"), "suffix-spans")
    df = rows.join(spans.hint("merge"), F.col("rid") == F.col("doc"), "left").select("doc_id", "content", "starts", "ends")
    return df.mapInArrow(lambda it: _removed(it, keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else ""))


def op4_query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
