"""Links inside large candidate groups, by differences from a centre.

Let C be any set, d(x) the size of x ^ C, and F(x) = d(x) - gap * |x|, where two sets are linked
if they differ in at most gap * (|x| + |y|) elements. As |x ^ y| <= d(x) + d(y), sets with
F(x) + F(y) <= 0 are linked: all that the member with the least F reaches this way become one
component through it, a link a member. Any other link has an end beyond that reach, and its
two differences share at least (d(x) + d(y) - |x ^ y|) / 2 elements, one at least. So these
are joined on the first elements of their differences (prefix filter), in one order for all:
what a set has beside C, which few others have, before what it lacks of C. A group of that join
that is large again gets a centre of its own. No step makes pairs of a large group.

C holds what most of a sample of the group's members have. It decides the speed alone: the
links are the same for any C.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group whose majority is its centre, about.
SAMPLE = 32
#: Most left x right members of a group that are compared in place, and most members.
PAIRS, MEMBERS = 1 << 16, 1 << 10


def most_gap(threshold: Fraction) -> Fraction:
    return (1 - threshold) / (1 + threshold)


def _elements(batches: Iterable) -> Iterator:
    """g, e of rows (g, blob)."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        sets = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        if sets:
            g = np.repeat(b.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.concatenate(sets))], names=["g", "e"])


def centres(members: DataFrame, sizes: DataFrame, salt: int) -> DataFrame:
    """g, core: the elements that over half of the sampled members of a group have."""
    picked = members.join(sizes, "g").where(F.pmod(F.xxhash64("node", F.lit(salt)), F.col("size")) < SAMPLE).select("g", "blob")
    many = picked.groupBy("g").agg(F.count("*").alias("picked"))
    held = picked.mapInArrow(_elements, "g long, e long").groupBy("g", "e").agg(F.count("*").alias("times"))
    return held.join(many, "g").where("2 * times > picked").groupBy("g").agg(F.collect_list("e").alias("core"))


def _differences(batches: Iterable, threshold: Fraction) -> Iterator:
    """g, node, n, d, score, core_size, sketch, diff of rows (g, node, n, blob, core, widest). score:
    F times the denominator of the gap; sketch: parities of the difference, as many in a group."""
    import numpy as np
    import pyarrow as pa

    gap = most_gap(threshold)
    for b in batches:
        g, node, n, blob, core, widest = (c.to_pylist() for c in b.columns)
        out: list[tuple] = []
        size, ends, last, c = 0, [], object(), np.empty(0, np.uint64)
        flat = []
        for k in range(b.num_rows):
            if g[k] != last:
                last, c = g[k], np.sort(np.array(core[k] or [], np.int64).view(np.uint64))
            own = np.frombuffer(blob[k], np.uint64)
            diff = np.concatenate([np.setdiff1d(own, c, assume_unique=True), np.setdiff1d(c, own, assume_unique=True)])
            bits = 1 << min(15, max(8, (2 * widest[k]).bit_length()))
            folded = np.bincount((diff & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            out.append((g[k], node[k], n[k], len(diff), gap.denominator * len(diff) - gap.numerator * n[k], len(c), np.packbits(folded).tobytes()))
            flat.append(diff)
            size += len(diff)
            ends.append(size)
        if out:
            cols = list(zip(*out, strict=True))
            diffs = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(cols, types, strict=True)), diffs], names=["g", "node", "n", "d", "score", "core_size", "sketch", "diff"])


DIFFERENCES = "g long, node long, n long, d long, score long, core_size long, sketch binary, diff array<long>"


def differences(members: DataFrame, sizes: DataFrame, core: DataFrame, threshold: Fraction) -> DataFrame:
    df = members.join(sizes, "g").join(core, "g", "left").select("g", "node", "n", "blob", "core", "widest")
    return df.mapInArrow(lambda it: _differences(it, threshold), DIFFERENCES)


def reach(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The certain links (u, v) to the best member of each group, and the groups (g, best,
    least_beyond) that have members beyond its reach; least_beyond: the least d of those."""
    best = diffs.groupBy("g").agg(F.min(F.struct("score", "node")).alias("b")).select("g", F.col("b.score").alias("best"), F.col("b.node").alias("best_node"))
    df = diffs.select("g", "node", "d", "score").join(best, "g")
    links = df.where("score + best <= 0 AND node <> best_node").select(F.col("node").alias("u"), F.col("best_node").alias("v"))
    beyond = df.where("score + best > 0").groupBy("g", "best").agg(F.min("d").alias("least_beyond"))
    return links, beyond


def _overlap(d: int, n: int, least: int, core: int, threshold: Fraction) -> int:
    """Elements that the difference of a set (d, n) and that of a linked set share at least, if
    the other difference has `least` elements or more and they share one at all."""
    gap = most_gap(threshold)
    num, den = threshold.numerator, threshold.denominator
    low, high = -(-n * num // den), n * den // num  # sizes of linked sets
    # d' - gap n' is least where d' is; d' is `least`, or the gap between n' and the core's size.
    other = min(max(least + core, low), high)
    spare = max(least, abs(other - core)) + d - gap * (n + other)
    return max(1, -(-spare.numerator // (2 * spare.denominator)))


def _prefixes(batches: Iterable, threshold: Fraction) -> Iterator:
    """key, g, node, left, right of rows (g, node, n, d, score, core_size, diff, best,
    least_beyond): each member under the elements on which it can meet a member beyond reach
    (left), and such a member under those on which it can meet one whose difference isn't
    larger, or one within reach (right)."""
    import numpy as np
    import pyarrow as pa

    from .jaccard import mix64

    num, den = threshold.numerator, threshold.denominator
    gap = most_gap(threshold)
    for b in batches:
        g, node, n, d, score, size, best, least = (b.column(k).to_numpy() for k in (0, 1, 2, 3, 4, 5, 7, 8))
        lists = b.column(6)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        out: list[list] = [[], [], [], [], []]
        for k in range(b.num_rows):
            diff, dk, nk, core = flat[offsets[k] : offsets[k + 1]], int(d[k]), int(n[k]), int(size[k])
            most = (nk + nk * den // num) * gap.numerator // gap.denominator  # elements in which a linked pair differs
            beyond = bool(score[k] + best[k] > 0)
            left = max(0, dk - _overlap(dk, nk, max(int(least[k]), dk if beyond else 0, dk - most), core, threshold) + 1)
            right = max(0, dk - _overlap(dk, nk, max(0, dk - most), core, threshold) + 1) if beyond else 0
            upto = max(left, right)
            if not upto:
                continue
            diff = diff[:upto]
            at = np.arange(upto)
            with np.errstate(over="ignore"):
                key = mix64(diff.view(np.uint64) ^ mix64(np.full(1, g[k], np.int64).view(np.uint64)))
            for c, v in zip(out, (key.view(np.int64), np.full(upto, g[k]), np.full(upto, node[k]), at < left, at < right), strict=True):
                c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "g", "node", "left", "right"])


def meetings(diffs: DataFrame, beyond: DataFrame, threshold: Fraction) -> DataFrame:
    """key, g, node, left, right of the members of groups that have some beyond reach."""
    own = ["g", "node", "n", "d", "score", "core_size", "diff"]
    df = diffs.select(*own).join(beyond, "g").select(*own, "best", "least_beyond")
    return df.mapInArrow(lambda it: _prefixes(it, threshold), "key long, g long, node long, left boolean, right boolean")
