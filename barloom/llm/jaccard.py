"""Near duplicates: n-gram Jaccard join with parity sketches.

A document's set of word shingles is hashed to a sketch: a shingle flips one bit. Two sketches
differ in no more bits than their sets differ in elements, so the Hamming distance is a lower
bound of the symmetric difference. Sets with a Jaccard similarity of t or more differ in at most
(1-t)/(1+t) of their summed sizes. For each size band that gives the most differing bits, T.
The sketch of a band is cut into more than T + r blocks, so a linked pair agrees on r of them
(pigeonhole). A set sends the T + r blocks with the most bits set (of equal ones by a hash of place
and content): of the blocks that both sets hold alike, r at least are sent by both. So of the blocks
that others sent, too, a set needs all but r - 1: it leaves out those that most sets sent, and
a set that shares fewer than r is linked with none. Sets also meet in the next band if they can
reach into it.

Sets that meet in a block are verified on their shingles. Equal sets are one node from the
start. Within a block only the members and one leader are paired. Of the blocks whose members
are still in different components, those of up to BLOCK members are compared across components
in place, by small sketches, and the pairs that may be linked are verified. Larger ones are
joined by their differences from a centre (see residual): a link a member for what is near the
centre, a prefix join for the rest. So the components are those of all links, and nothing holds
or compares all pairs of a large group.

Defined results: A-Z is lowered; a document with fewer words than a shingle is one shingle of
all its words; without words, or null, its set is empty and it is linked with nothing; ids are
integers (others raise), may be null or repeat (null ids don't count for component_id unless all
are null); columns of other names don't matter; an empty table gives an empty result. Sets are
told apart by two 64-bit names; sets that share the first get new ones.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, discard, fresh, materialise, ship, table, text_of
from .graph import components
from .residual import MEMBERS, PAIRS, centres, differences, meetings, reach

#: Multipliers of the mixing function (fixed values, splitmix64) and of the words in a shingle.
MIX_1, MIX_2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mix64(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


#: Bytes of texts that are hashed at once (a longer text is hashed alone).
SLICE = 1 << 17


class WordBytes:
    """Tables by byte: its lower case, whether it is white space, and its values by place in a word."""

    PLACES = 64

    def __init__(self, seed: int):
        import numpy as np

        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32  # A-Z
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.value = mix64(mix64(np.arange(256 * self.PLACES, dtype=np.uint64) + np.uint64(1)) + np.uint64(seed * STEP & 0xFFFFFFFFFFFFFFFF))

    def words(self, data, ends):
        """Hashes of the words of texts that end at `ends` in data, and how many each text has."""
        import numpy as np

        b = self.lower[data]
        inside = ~self.space[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.r_[0, ends[:-1]]
        starts = starts[starts < ends]  # of texts that aren't empty
        first[starts] = inside[starts]
        at = np.flatnonzero(first)
        counts = np.diff(np.searchsorted(at, np.r_[0, ends]))
        if not len(at):
            return np.empty(0, np.uint64), counts
        b, first = b[inside], first[inside]
        heads = np.flatnonzero(first)
        sizes = np.diff(np.r_[heads, len(b)])
        place = np.arange(len(b)) - np.repeat(heads, sizes)
        value = self.value[(place % self.PLACES) * 256 + b]
        if sizes.max() > self.PLACES:  # a long word is the sum of its runs; all but the first are mixed with their place
            runs = np.flatnonzero(place % self.PLACES == 0)
            run = np.add.reduceat(value, runs)
            late = np.flatnonzero(place[runs])
            run[late] = mix64(mix64(run[late]) + (place[runs[late]] // self.PLACES).astype(np.uint64) * np.uint64(STEP))
            total = np.add.reduceat(run, np.searchsorted(runs, heads))
        else:
            total = np.add.reduceat(value, heads)
        return mix64(total + sizes.astype(np.uint64) * np.uint64(STEP)), counts


_TABLES: dict[int, WordBytes] = {}


def _sorted_set(x):
    import numpy as np

    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(data, ends, n: int, seed: int) -> Iterator:
    """For each text in data that ends at `ends`: the sorted distinct 64-bit hashes of its shingles."""
    import numpy as np

    table_ = _TABLES.setdefault(seed, WordBytes(seed))
    k = 0
    while k < len(ends):
        low = int(ends[k - 1]) if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
        with np.errstate(over="ignore"):
            h, counts = table_.words(data[low : int(ends[stop - 1])], ends[k:stop] - low)
            power = np.uint64(1)
            total = np.full(max(len(h) - n + 1, 0), n, np.uint64)
            for i in range(n):
                total += h[i : len(h) - n + 1 + i] * power if len(total) else total
                power *= np.uint64(STEP)
            total = mix64(total)
            at = 0
            for c in counts.tolist():
                if c >= n:
                    yield _sorted_set(total[at : at + c - n + 1].copy())
                elif c:  # one shingle of all words
                    few = np.uint64(c)
                    power = np.uint64(1)
                    for x in h[at : at + c]:
                        few, power = few + x * power, power * np.uint64(STEP)
                    yield mix64(np.array([few], np.uint64))
                else:
                    yield np.empty(0, np.uint64)
                at += c
        k = stop


def column_sets(column, n: int, seed: int) -> Iterator:
    """shingle_sets() of an Arrow column of texts without nulls, on its bytes as they lie."""
    import numpy as np
    import pyarrow as pa

    if not len(column):
        return iter(())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return shingle_sets(data[int(offsets[0]) : int(offsets[-1])], offsets[1:] - offsets[0], n, seed)


def shingles(text: str, n: int = 5, seed: int = 0):
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np

    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return next(shingle_sets(data, np.array([len(data)]), n, seed))


class Bands:
    """Size bands for a threshold: edges, T and the number of blocks of each."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.gap = (1 - threshold) / (1 + threshold)
        self.edges = [1]

    def edge(self, k: int) -> int:
        while len(self.edges) <= k:
            e = self.edges[-1]
            reach = int(e / self.t) + (e / self.t != int(e / self.t))
            self.edges.append(max(e + 1, reach, e * 3 // 2))
        return self.edges[k]

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n elements meets others."""
        k = 0
        while self.edge(k + 1) <= n:
            k += 1
        return [k, k + 1] if n >= self.t * self.edge(k + 1) else [k]

    @lru_cache(maxsize=None)  # noqa: B019
    def most(self, k: int) -> int:
        """T: the most elements in which a linked pair of the band differs."""
        return int(2 * (self.edge(k + 1) - 1) * self.gap)

    def shared(self, k: int) -> int:
        """r: the blocks that a linked pair of the band shares at least."""
        return 2 + self.most(k) // 8

    def blocks(self, k: int) -> int:
        return (self.most(k) + self.shared(k)) * 13 // 10 + 1


#: The low bits of a key hold its band.
BAND_BITS = 6
#: Bits of the small sketch for each block of the large one.
FOLD = 8


def block_keys(s, bands: Bands):
    """The keys of the blocks that the set s sends, and {band: small sketch}. A block is a range of
    the hashes and holds the exclusive or of those in it: the parities of 2^64 places for each
    block, kept by their sum. A small sketch folds each block's shingles to FOLD parities: its
    Hamming distance is a bound, too."""
    import numpy as np

    out, small = [], {}
    for k in bands.of(len(s)):
        t, m = bands.most(k), bands.blocks(k)
        send = t + bands.shared(k)
        if t == 0:
            continue  # only equal sets are linked
        block = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # in order, as s is
        bits = np.bincount(block, minlength=m)
        value = np.zeros(m, np.uint64)
        starts = np.flatnonzero(bits)
        value[starts] = np.bitwise_xor.reduceat(s, (np.cumsum(bits) - bits)[starts])
        key = mix64(value ^ mix64(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32)))
        # The order of a block depends on its place and content alone, so both sets of a pair have
        # the blocks that they hold alike in one order.
        order = bits.astype(np.uint64) << np.uint64(44) | key >> np.uint64(20)
        key = key[np.argpartition(order, m - send)[m - send :]]
        out.append(key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.uint64(k))
        folded = np.bincount(block * FOLD + (s & np.uint64(FOLD - 1)).astype(np.int64), minlength=m * FOLD)
        small[k] = np.packbits(folded & 1).tobytes()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), small


def identity(s) -> tuple[int, int]:
    """Two 64-bit names of a set, from the exclusive or and from the sum of its hashes: the node id,
    and a check on it."""
    import numpy as np

    if not len(s):
        return 0, 0
    a, b = mix64(np.array([np.bitwise_xor.reduce(s), np.add.reduce(s)]) + np.uint64(len(s))).view(np.int64).tolist()
    return a, b


SETS = "doc_id long, spot long, tag string, n long, cid long, check long, keys array<long>, band int, sketch binary, next_sketch binary"


def _sets(batches: Iterable, n: int, seed: int, threshold: Fraction, node_bits: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    bands, seen = Bands(threshold), set()
    for b in batches:
        sizes, cids, checks, keys, ends, band, sketch, after = [], [], [], [], [0], [], [], []
        for s in column_sets(b.column(1), n, seed):
            cid, check = identity(s)
            cid &= (1 << node_bits) - 1 if node_bits < 64 else -1
            new = len(s) and (cid, check) not in seen  # equal sets of a task send their keys once
            small: dict = {}
            if new:
                if len(seen) > 500_000:
                    seen.clear()
                seen.add((cid, check))
                sent, small = block_keys(s, bands)
                keys.append(sent)
            k = bands.of(len(s))[0] if len(s) else None
            band.append(k)
            sketch.append(small.get(k))
            after.append(small.get(k + 1) if small else None)
            sizes.append(len(s))
            cids.append(cid)
            checks.append(check)
            ends.append(ends[-1] + (len(keys[-1]) if new else 0))
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(3), b.column(2), *(pa.array(c, pa.int64()) for c in (sizes, cids, checks)), lists, pa.array(band, pa.int32()), pa.array(sketch, pa.binary()), pa.array(after, pa.binary())],
            names=["doc_id", "spot", "tag", "n", "cid", "check", "keys", "band", "sketch", "next_sketch"],
        )


def _close(batches: Iterable, threshold: Fraction) -> Iterator:
    """Of rows (u, v, nu, nv, su, sv) with small sketches of one band, the pairs whose Hamming
    distance allows a link."""
    import numpy as np
    import pyarrow as pa

    gap = (1 - threshold) / (1 + threshold)
    for b in batches:
        nu, nv = (b.column(k).to_numpy() for k in (2, 3))
        most = (nu + nv) * gap.numerator // gap.denominator
        far = [int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(np.array(far) <= most))


def _across(batches: Iterable, threshold: Fraction) -> Iterator:
    """Rows (key, node, comp, n, sketch, left, right), sorted by key: the pairs of a left and a
    right row of a key that are in different components and whose sizes and sketches allow a
    link, each once. Holds one key, which its caller bounds, and a batch of pairs."""
    import numpy as np
    import pyarrow as pa

    gap = (1 - threshold) / (1 + threshold)
    num, den = threshold.numerator, threshold.denominator

    def pairs(rows: list[tuple]) -> tuple:
        node, comp, n, left, right = (np.array(c) for c in zip(*((x[1], x[2], x[3], x[5], x[6]) for x in rows), strict=True))
        if (comp == comp[0]).all():
            return ()
        bits = np.stack([np.frombuffer(x[4], np.uint8) for x in rows])
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        found = []
        for i in np.flatnonzero(left):
            both = left & right[i]  # such rows meet this one from either side
            j = np.flatnonzero(right & (~both | (node > node[i])) & (comp != comp[i]) & (den * n >= num * n[i]) & (den * n[i] >= num * n))
            far = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
            j = node[j[far <= (n[j] + n[i]) * gap.numerator // gap.denominator]]
            found.append((np.minimum(j, node[i]), np.maximum(j, node[i])))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else ()

    def batch(found: list):
        uv = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], names=["u", "v"])

    held: list[tuple] = []
    found: list[tuple] = []
    waiting = 0
    for row in (r for b in batches for r in [*zip(*(c.to_pylist() for c in b.columns), strict=True)]):
        if held and held[0][0] != row[0]:
            if uv := pairs(held):
                found.append(uv)
                waiting += len(uv[0])
            held = []
        held.append(row)
        if waiting > 100_000:
            yield batch(found)
            found, waiting = [], 0
    if held and (uv := pairs(held)):
        found.append(uv)
    if found:
        yield batch(found)


def _blobs(batches: Iterable, n: int, seed: int) -> Iterator:
    """(cid, size, shingles) of the rows (text, cid, check) whose set is the wanted one."""
    import pyarrow as pa

    for b in batches:
        rows = []
        for s, cid, check in zip(column_sets(b.column(0), n, seed), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if identity(s)[1] == check:
                rows.append((cid, len(s), s.tobytes()))
        if rows:
            a, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["cid", "n", "blob"])


def _verified(batches: Iterable, threshold: Fraction) -> Iterator:
    import numpy as np
    import pyarrow as pa

    num, den = threshold.numerator, threshold.denominator
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            same = int((q[at] == p).sum())
            keep.append(den * same >= num * (len(p) + len(q) - same))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], names=["u", "v", "linked"])


#: Members of a block that are compared in place; larger blocks get a centre.
BLOCK = 64


class Join:
    """The steps of one join; each table is written to the shared folder."""

    #: Fewer make different sets share a name, for tests.
    node_bits = 64
    block = BLOCK
    pairs = PAIRS

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: Fraction, seed: int, tag: Column | None = None):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.n, self.threshold, self.seed, self.temps = n, threshold, seed, []
        text, node_bits = text_of(text_col), self.node_bits
        doc_id = F.col(id_col).cast("long")
        #: spot: where a row without an id is found again.
        spot = F.coalesce(doc_id, F.xxhash64(text))
        self.rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), (F.lit(None) if tag is None else tag).cast("string").alias("tag"), spot.alias("spot"))
        sets = materialise(self.rows.mapInArrow(lambda it: _sets(it, n, seed, threshold, node_bits), SETS), "jaccard-sets")
        while True:
            first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "spot")).alias("first")
            self.classes = self.keep(sets.where("n > 0").groupBy("cid").agg(first, F.min("check").alias("check"), F.max("check").alias("c2")), "jaccard-classes")
            shared = self.classes.where("check <> c2").select(F.col("cid").alias("shared_cid"))
            if shared.isEmpty():
                break
            df = sets.join(shared, (F.col("cid") == F.col("shared_cid")) & (F.col("n") > 0), "left")
            cid = F.when(F.col("shared_cid").isNotNull(), F.xxhash64("cid", "check")).otherwise(F.col("cid"))
            old, sets = sets, materialise(df.withColumn("cid", cid).drop("shared_cid"), "jaccard-sets")
            discard(old)
        sent = sets.select(F.explode("keys").alias("key"), F.col("cid").alias("node"))
        block = Window.partitionBy("key")
        several = sent.withColumns({"low": F.min("node").over(block), "high": F.max("node").over(block), "size": F.count("*").over(block)}).where("low <> high")
        shared = materialise(several.select("key", "node", "size").dropDuplicates(["key", "node"]), "jaccard-shared")
        band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
        bands = Bands(threshold)
        least = F.get(F.array(*(F.lit(bands.shared(k)) for k in range(1 << BAND_BITS))), F.col("band"))
        own = Window.partitionBy("node", "band")
        ranked = shared.withColumn("band", band).withColumns({"place": F.row_number().over(own.orderBy("size", "key")), "held": F.count("*").over(own)})
        left = ranked.where(F.col("place") <= F.col("held") - least + 1).select("key", "node")
        #: key, node, leader of every block in which two nodes or more are left; the leader's own row is left out.
        self.met = self.keep(left.withColumn("leader", F.min("node").over(block)).where("node <> leader"), "jaccard-met")
        discard(shared)
        self.sets = materialise(sets.select("doc_id", "tag", "n", "cid"), "jaccard-nodes")
        both = sets.where("sketch IS NOT NULL").select("cid", "band", "n", "sketch").union(sets.where("next_sketch IS NOT NULL").select("cid", F.col("band") + 1, "n", F.col("next_sketch")))
        self.sketches = self.keep(both.dropDuplicates(["cid", "band"]), "jaccard-sketches")
        discard(sets)
        self.release()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """materialise() for a table that goes when the nodes are known."""
        self.temps.append(materialise(df, name))
        return self.temps[-1]

    def release(self) -> None:
        """Let the JVM drop the shuffle files of finished steps before the next writes its own."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def fetch(self, nodes: DataFrame) -> DataFrame:
        """cid, n, blob: the shingles of nodes (distinct cid), each from one document."""
        want = self.keep(self.classes.join(nodes, "cid").select("cid", "check", F.col("first.no_id").alias("no_id"), F.col("first.spot").alias("want_spot")), "jaccard-wanted")
        # A merge join at any size: it needs no bound on the nodes.
        hits = self.rows.join(want.hint("merge"), (F.col("spot") == F.col("want_spot")) & (F.col("doc_id").isNull() == F.col("no_id")))
        n, seed = self.n, self.seed
        found = hits.select("text", "cid", "check").mapInArrow(lambda it: _blobs(it, n, seed), "cid long, n long, blob binary")
        blobs = self.keep(found.dropDuplicates(["cid"]) if self.repeated_ids else found, "jaccard-blobs")
        self.release()
        return blobs

    @cached_property
    def repeated_ids(self) -> bool:
        return not self.sets.groupBy("doc_id").count().where("count > 1").isEmpty()

    def verify(self, pairs: DataFrame, blobs: DataFrame, name: str) -> DataFrame:
        """The linked ones of pairs (u, v), on the nodes' shingles."""
        side = lambda k: blobs.select(F.col("cid").alias(k), F.col("blob").alias(f"blob_{k}"))
        t = self.threshold
        df = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
        out = df.select("u", "v", "blob_u", "blob_v").mapInArrow(lambda it: _verified(it, t), "u long, v long, linked boolean")
        links = self.keep(out.where("linked").select("u", "v"), name)
        self.release()
        return links

    def rooted(self, df: DataFrame, node: str, comp: DataFrame, alias: str) -> DataFrame:
        c = comp.select(F.col("node").alias(f"{alias}_node"), F.col("root").alias(f"{alias}_root"))
        return df.join(c, F.col(node) == F.col(f"{alias}_node"), "left").withColumn(alias, F.coalesce(f"{alias}_root", node)).drop(f"{alias}_node", f"{alias}_root")

    def across(self, pairs: DataFrame, comp: DataFrame, roots: bool = False) -> DataFrame:
        """Those pairs (u, v) whose ends are in different components; on request their roots."""
        df = self.rooted(self.rooted(pairs, "u", comp, "cu"), "v", comp, "cv").where("cu <> cv")
        return df.select(F.col("cu").alias("u"), F.col("cv").alias("v")) if roots else df.drop("cu", "cv")

    def stars(self) -> DataFrame:
        """u, v: members and leaders that sizes and small sketches allow to be linked."""
        t = self.threshold
        band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
        pairs = self.met.select(F.col("node").alias("u"), F.col("leader").alias("v"), band.alias("band")).distinct()
        side = lambda k: self.sketches.select(F.col("cid").alias(k), "band", F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        df = pairs.join(side("u"), ["u", "band"]).join(side("v"), ["v", "band"])
        df = df.where((F.col("nu") * t.denominator >= F.col("nv") * t.numerator) & (F.col("nv") * t.denominator >= F.col("nu") * t.numerator))
        near = df.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(lambda it: _close(it, t), "u long, v long")
        return self.keep(near.distinct(), "jaccard-stars")

    def mixed(self, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
        """key, node, comp of the block members, and key, size of the blocks whose members are
        in several components."""
        members = self.met.select("key", "node").union(self.met.select("key", F.col("leader").alias("node")))
        labelled = self.keep(self.rooted(members.distinct(), "node", comp, "comp"), "jaccard-members")
        several = labelled.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size")).where("a <> b AND size > 2")
        return labelled, self.keep(several.select("key", "size"), "jaccard-mixed")

    def compared(self, df: DataFrame, name: str) -> DataFrame:
        """u, v: the pairs across components in rows (key, node, comp, n, sketch, left, right)."""
        t = self.threshold
        dealt = df.select("key", "node", "comp", "n", "sketch", "left", "right").repartition("key").sortWithinPartitions("key")
        return self.keep(dealt.mapInArrow(lambda it: _across(it, t), "u long, v long").distinct(), name)

    def grown(self, comp: DataFrame, links: DataFrame) -> DataFrame:
        """The components with more links. Only the roots that these join are looked at again."""
        roots = self.keep(self.across(links.select("u", "v"), comp, True).distinct(), "jaccard-roots")
        if roots.isEmpty():
            return comp
        over = components(roots, self.temps)
        up = over.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
        moved = comp.join(up, F.col("root") == F.col("up_node"), "left").select("node", F.coalesce("up_root", "root").alias("root"))
        # A node that was its own root has no row yet; others' rows of the same node come from comp.
        return self.keep(moved.union(over.join(comp.select("node"), "node", "left_anti")), "jaccard-components")

    def resolved(self, groups: DataFrame, comp: DataFrame, blobs: DataFrame) -> DataFrame:
        """The components with all links inside the groups (g, node). blobs: of their nodes."""
        t, level = self.threshold, 0
        blobs = blobs.withColumnRenamed("cid", "node")
        while True:
            groups = self.keep(groups.join(blobs.select("node", "n"), "node"), "jaccard-groups")
            if groups.isEmpty():
                return comp
            sizes = self.keep(groups.groupBy("g").agg(F.count("*").alias("size"), F.max("n").alias("widest")), "jaccard-sizes")
            members = groups.select("g", "node").join(blobs, "node")
            core = self.keep(centres(members, sizes, level), "jaccard-centres")
            diffs = self.keep(differences(members, sizes, core, t), "jaccard-differences")
            sure, beyond = reach(diffs)
            comp = self.grown(comp, self.keep(sure, "jaccard-sure"))
            beyond = self.keep(beyond, "jaccard-beyond")
            if beyond.isEmpty():
                return comp
            keyed = self.keep(self.rooted(meetings(diffs, beyond, t), "node", comp, "comp"), "jaccard-meetings")
            met = keyed.groupBy("key").agg(F.count_if("left").alias("lefts"), F.count_if("right").alias("rights"), F.min("comp").alias("a"), F.max("comp").alias("b"))
            met = self.keep(met.where("a <> b AND lefts > 0 AND rights > 0").select("key", ((F.col("lefts") * F.col("rights") <= self.pairs) & (F.col("lefts") + F.col("rights") <= MEMBERS)).alias("small")), "jaccard-met")
            few = keyed.join(met.where("small").select("key"), "key").join(diffs.select("g", "node", "n", "sketch"), ["g", "node"])
            pairs = self.compared(few, "jaccard-pairs")
            if not pairs.isEmpty():
                comp = self.grown(comp, self.verify(pairs, blobs.withColumnRenamed("node", "cid"), "jaccard-links"))
            groups = keyed.join(met.where(~F.col("small")).select("key"), "key").select(F.col("key").alias("g"), "node").distinct()
            level += 1

    def links(self) -> DataFrame:
        """Components over nodes: node, root."""
        stars = self.stars()
        ends = lambda df: df.select(F.col("u").alias("cid")).union(df.select(F.col("v").alias("cid")))
        blobs = self.fetch(ends(stars).distinct())
        comp = components(self.verify(stars, blobs, "jaccard-links"), self.temps)
        labelled, mixed = self.mixed(comp)
        small = labelled.join(mixed.where(F.col("size") <= self.block).select("key"), "key").withColumn("band", F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int"))
        small = small.join(self.sketches.withColumnRenamed("cid", "node"), ["node", "band"]).withColumns({"left": F.lit(True), "right": F.lit(True)})
        known = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        rest = self.keep(self.compared(small, "jaccard-crossing").join(known, ["u", "v"], "left_anti"), "jaccard-rest")
        # Larger blocks with members in common are one group, so each node has one place in them.
        large = self.met.join(mixed.where(F.col("size") > self.block).select("key"), "key").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
        places = components(large, self.temps)
        groups = places.select(F.col("root").alias("g"), "node").union(places.select(F.col("root").alias("g"), F.col("root").alias("node")).distinct())
        wanted = self.keep(ends(rest).union(groups.select(F.col("node").alias("cid"))).distinct(), "jaccard-ends")
        if wanted.isEmpty():
            return comp
        blobs = self.fetch(wanted)
        comp = self.grown(comp, self.verify(rest, blobs, "jaccard-more-links"))
        return self.resolved(groups, comp, blobs)

    def nodes(self) -> DataFrame:
        """doc_id, tag, n, cid, root of every document whose set isn't empty."""
        rooted = materialise(self.rooted(self.sets.where("n > 0").select("doc_id", "tag", "n", "cid"), "cid", self.links(), "root"), "jaccard-rooted")
        for df in self.temps:
            discard(df)
        return rooted

    def result(self) -> DataFrame:
        """doc_id, n_shingles, cid, component_id of every document."""
        rooted = self.nodes()
        low = rooted.groupBy(F.col("root").alias("low_root")).agg(F.min("doc_id").alias("component_id"))
        full = rooted.join(low, F.col("root") == F.col("low_root")).select("doc_id", F.col("n").alias("n_shingles"), "cid", "component_id")
        empty = self.sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "cid", F.col("doc_id").alias("component_id"))
        return full.union(empty)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, threshold: str | float = "0.8", seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, n_shingles, cid (of its set), component_id."""
    return Join(docs, id_col, text_col, words, Fraction(str(threshold)), seed).result()


def op10_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest id stays (then the smallest
    text hash; null ids last), and every row without words; columns unchanged."""
    tag = F.sha2(text_of("text"), 256)
    rooted = Join(docs, "doc_id", "text", 5, Fraction(4, 5), 0, tag).nodes()
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tag"))
    same = rooted.groupBy("root", "doc_id", "tag").agg(F.count("*").alias("rows"))
    best = same.groupBy("root").agg(F.min_by(F.struct("doc_id", "tag", "rows"), rank).alias("best"))
    keepers = materialise(best.select(F.col("best.doc_id").alias("keep_id"), F.col("best.tag").alias("keep_tag"), F.col("best.rows").alias("keep_rows")), "near-keepers")
    mine, kid, ktag, krows, pos = fresh(docs, "tag", "keep_id", "keep_tag", "keep_rows", "pos")
    k = keepers.select(F.col("keep_id").alias(kid), F.col("keep_tag").alias(ktag), F.col("keep_rows").alias(krows))
    df = docs.withColumn(mine, tag).join(k.hint("merge"), F.col("doc_id").eqNullSafe(F.col(kid)) & (F.col(mine) == F.col(ktag)), "left")
    stays = F.col(krows).isNotNull()
    if not keepers.where("keep_rows > 1").isEmpty():  # rows tied in text and id
        each = F.monotonically_increasing_id().cast("string")
        group = F.when(F.col(krows) > 1, F.concat_ws("|", F.col("doc_id").cast("string"), F.col(mine))).otherwise(F.col(pos))
        df = df.withColumn(pos, each).withColumn(pos, F.row_number().over(Window.partitionBy(group).orderBy(pos)))
        stays = stays & (F.col(pos) == 1)
    return df.where(stays | ~text_of("text").rlike(NON_SPACE)).select(*docs.columns)
