"""Audit of how the sources of a language differ in their terms, by mergeable radix tries.

1. Each task counts the terms of its documents in one byte trie a language (tries.Trie): a leaf
   counts documents and, by source, occurrences. A trie beyond `budget` counters is walked, sent
   and begun anew, so a task's memory is bounded.
2. What the walks give is cut into ranges of (language, prefix); a task merges the tries of its range
   in a trie of its own, of the terms that stay. A range comes in order, so a trie beyond the budget is
   walked and begun anew there, too. A frequent term is one leaf a trie, however often it occurs.
3. The merged tries with the terms that a language keeps are written. Sums over them give each
   source's N and V; a second walk, a range a task, streams what each term adds to the pairs of
   sources, and holds the best `top` candidates of a source, ties in the order of the walk.

All arithmetic is on integers: 10^9 (count + 5) / (N + 5 V) is divided in three steps of a thousand.
A task holds S x S sums for a language of S sources, as many numbers as the result has rows.

Defined results: null texts, languages and sources are empty strings; every row is a document,
repeated rows and ids too; a source whose documents have no term is a group like any other; a language that
keeps no term has pairs of value 0 and no terms; an empty table gives an empty result. Other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, open_fs, scan_partitions, ship, table
from .tries import Trie, summed, tallied

#: Scale of p, and what is added to each count (fixed values).
SCALE, ADDED = 1_000_000_000, 5

LEAVES = "lang string, term binary, docs long, sids array<int>, counts array<long>"
PARTS = "lang string, a int, b int, term binary, value long"

#: Bytes to term bytes: A-Z lower-cased, other letters and all bytes of wider characters kept, else a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Words that a task gathers before it counts them.
GATHERED = 1 << 21


def _file_rows(path: str) -> Iterator[dict]:
    """The rows of a written table, read in a task."""
    import pyarrow.dataset as ds

    fs, at = open_fs(path)
    for batch in ds.dataset(at, filesystem=fs, format="parquet").to_batches():
        yield from batch.to_pylist()


def _leaves(lang: str, trie: Trie, least: int = 0, rows: int = 1 << 15) -> Iterator:
    """The leaves of a trie in order, as record batches."""
    import numpy as np
    import pyarrow as pa

    terms, docs, sizes, sids, counts = trie.columns()
    ends = np.cumsum(sizes)
    kept = np.flatnonzero(docs >= least)
    for at in range(0, len(kept), rows):
        own = kept[at : at + rows]
        mine = np.repeat(ends[own] - sizes[own], sizes[own])
        offsets = np.r_[0, np.cumsum(sizes[own])]
        mine = mine + np.arange(len(mine)) - np.repeat(offsets[:-1], sizes[own])
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[mine], t)) for x, t in ((sids, pa.int32()), (counts, pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([terms[i] for i in own.tolist()], pa.binary()), pa.array(docs[own]), *lists], ["lang", "term", "docs", "sids", "counts"])


class _Language:
    """The trie of a language in a task. Words gather before they are counted. A dictionary numbers the
    distinct ones, so the trie is descended once for each, in order of their bytes."""

    def __init__(self, sources: int):
        self.trie = Trie(sources)
        self.leaf: defaultdict[bytes, int] = defaultdict()
        self.leaf.default_factory = self.leaf.__len__
        self.words, self.rows = [], []

    def add(self, words: list[bytes], sid: int) -> None:
        import numpy as np

        self.words.append(np.fromiter(map(self.leaf.__getitem__, words), np.int64, len(words)))
        self.rows.append(sid)

    def settle(self) -> None:
        import numpy as np

        if not self.words:
            return
        for term, number in sorted(islice(self.leaf.items(), self.trie.terms, None)):
            self.trie.leaf(term, number)
        sizes = np.array([len(w) for w in self.words])
        leaves, sids, docs = np.concatenate(self.words), np.repeat(self.rows, sizes), np.repeat(np.arange(len(sizes)), sizes)
        keys, n = tallied(leaves * self.trie.sources + sids)
        self.trie.add_counts(*np.divmod(keys, self.trie.sources), n)
        self.trie.add_docs(tallied(leaves * len(sizes) + docs)[0] // len(sizes), 1)
        self.words, self.rows = [], []


def _sizes(groups: str) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """The place of each source in its language, and how many a language has."""
    sid = {(r["lang"], r["source"]): r["sid"] for r in _file_rows(groups)}
    return sid, Counter(lang for lang, _ in sid)


def _count(batches: Iterable, groups: str, budget: int) -> Iterator:
    """Tries of a task's documents."""
    sid, sizes = _sizes(groups)
    langs: dict[str, _Language] = {}
    gathered = 0

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = text.translate(TERM_BYTES).split()
            if not found:
                continue
            own = langs.get(lang) or langs.setdefault(lang, _Language(sizes[lang]))
            own.add(found, sid[lang, source])
            gathered += len(found)
            if gathered >= GATHERED:
                gathered = 0
                for own in langs.values():
                    own.settle()
                if sum(x.trie.counters for x in langs.values()) >= budget:
                    for name, own in langs.items():
                        yield from _leaves(name, own.trie)
                    langs.clear()
    for name, own in langs.items():
        own.settle()
        yield from _leaves(name, own.trie)


def _merge(batches: Iterable, groups: str, least: int, budget: int) -> Iterator:
    """The merged tries of a range whose rows come in order of (language, term): equal terms stand side by
    side, and those in fewer than `least` documents are pruned before they enter the trie."""
    import numpy as np
    import pyarrow.compute as pc

    _, sizes = _sizes(groups)
    lang, trie = None, Trie(1)
    #: The last term so far, which may go on: language, term, documents, its (sources, counts).
    last, docs, parts = None, 0, []

    def enter() -> None:
        if last and docs >= least:
            leaf = np.array([trie.leaf(last[1])])
            trie.add_docs(leaf, docs)
            sids, n = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            trie.add_counts(np.repeat(leaf, len(sids)), sids, n)

    for batch in batches:
        if not batch.num_rows:
            continue
        names, terms = batch.column(0), batch.column(1)
        change = pc.or_(pc.not_equal(names[1:], names[:-1]), pc.not_equal(terms[1:], terms[:-1]))
        starts = np.r_[0, np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1]
        total = np.add.reduceat(batch.column(2).to_numpy(), starts)
        width = np.diff(batch.column(3).offsets.to_numpy())
        ends = np.r_[0, np.cumsum(width)]
        sids, counts = batch.column(3).flatten().to_numpy().astype(np.int64), batch.column(4).flatten().to_numpy()
        stops = np.r_[starts[1:], batch.num_rows]
        here = set(np.flatnonzero(total >= least).tolist()) | {0, len(starts) - 1}
        for g in sorted(here):
            row, key = int(starts[g]), (names[int(starts[g])].as_py(), terms[int(starts[g])].as_py())
            own = slice(ends[row], ends[stops[g]])
            if key != last:
                enter()
                if key[0] != lang or trie.counters >= budget:
                    if lang is not None:
                        yield from _leaves(lang, trie, least)
                    lang, trie = key[0], Trie(sizes[key[0]])
                last, docs, parts = key, 0, []
            docs += int(total[g])
            parts.append((sids[own], counts[own]))
            if len(parts) > 64:
                parts = [summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
    enter()
    if lang is not None:
        yield from _leaves(lang, trie, least)


def scaled(counts, total):
    """1 + floor(SCALE * (counts + ADDED) / total) without overflow: three steps of a thousand. counts
    + ADDED is at most total, and total below 9.2e15."""
    import numpy as np

    rest, out = counts + ADDED, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


class _Profile:
    """A language's totals in a task, and what its terms gave so far."""

    def __init__(self, rows: list[dict], top: int):
        import numpy as np

        rows.sort(key=lambda r: r["sid"])
        self.top = top
        self.totals = np.array([r["n"] + ADDED * r["v"] for r in rows], np.int64)
        self.all = np.int64(sum(r["n"] for r in rows) + ADDED * rows[0]["v"])
        self.pairs = np.zeros((len(rows), len(rows)), np.int64)
        #: By source: values and terms of the candidates, best first.
        self.best: list[tuple] = [(np.zeros(0, np.int64), []) for _ in rows]

    def add(self, terms: list[bytes], counts) -> None:
        """counts: terms by sources."""
        import numpy as np

        p = scaled(counts, self.totals)
        q = scaled(counts.sum(axis=1), self.all)
        for s in range(len(self.totals) - 1):
            self.pairs[s, s + 1 :] += np.abs(p[:, s + 1 :] - p[:, s : s + 1]).sum(axis=0)
        for s, (values, names) in enumerate(self.best):
            own = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
            gain = p[own, s] - q[own]
            if len(gain) > self.top:  # with all that are equal to the last
                near = gain >= -np.partition(-gain, self.top - 1)[self.top - 1]
                own, gain = own[near], gain[near]
            names = names + [terms[i] for i in own.tolist()]
            values = np.concatenate([values, gain])
            order = sorted(range(len(names)), key=lambda i: (-values[i], names[i]))[: self.top]
            self.best[s] = values[order], [names[i] for i in order]


def _score(batches: Iterable, profile: str, top: int, held: int = 1 << 18) -> Iterator:
    """What the terms of a range add to each pair of sources, and each source's best terms in it."""
    import numpy as np
    import pyarrow as pa

    rows: dict[str, list] = {}
    for r in _file_rows(profile):
        rows.setdefault(r["lang"], []).append(r)
    langs: dict[str, _Profile] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        at = 0
        while at < len(names):
            own = langs.get(names[at]) or langs.setdefault(names[at], _Profile(rows[names[at]], top))
            stop = at + 1
            while stop < len(names) and names[stop] == names[at] and (stop - at) * len(own.totals) < held:
                stop += 1
            part = batch.slice(at, stop - at)
            sids, counts = part.column(2), part.column(3)
            dense = np.zeros((stop - at, len(own.totals)), np.int64)
            sizes = np.diff(sids.offsets.to_numpy())
            dense[np.repeat(np.arange(stop - at), sizes), sids.flatten().to_numpy()] = counts.flatten().to_numpy()
            own.add(part.column(1).to_pylist(), dense)
            at = stop
    out: list[tuple] = []
    for lang, own in langs.items():
        a, b = np.triu_indices(len(own.totals), 1)
        out += [(lang, x, y, None, v) for x, y, v in zip(a.tolist(), b.tolist(), own.pairs[a, b].tolist(), strict=True)]
        out += [(lang, s, None, t, int(v)) for s, (values, terms) in enumerate(own.best) for v, t in zip(values, terms, strict=True)]
        while out:
            some, out = out[:8192], out[8192:]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], ["lang", "a", "b", "term", "value"])


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, *, min_docs: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """(groups, leaves), both written: groups (lang, source, sid: its place among the sources of the language,
    from 0) and the merged tries, of terms in at least min_docs documents of the language."""
    spark = docs.sparkSession
    ship(spark)
    text, lang, source = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, lang_col, source_col))
    rows = docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialise(rows.select("lang", "source").distinct().withColumn("sid", place.cast("int")), "divergence-groups")
    path = groups.barloom_path
    sent = materialise(rows.mapInArrow(lambda it: _count(it, path, budget), LEAVES), "divergence-tries")
    ranged = sent.repartitionByRange(scan_partitions(spark), "lang", "term").sortWithinPartitions("lang", "term")
    return groups, materialise(ranged.mapInArrow(lambda it: _merge(it, path, min_docs, budget), LEAVES), "divergence-merged")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, min_docs: int = 30, top: int = 50, budget: int = 1 << 20) -> DataFrame:
    """lang, source, part, item, value, rank: by language and source the other sources (`pair`, all
    of them) and its `top` terms beyond the language's share (`term`). budget: counters of the
    tries that a task holds; it decides memory, not results."""
    groups, leaves = term_counts(docs, text_col, lang_col, source_col, min_docs=min_docs, budget=budget)
    sums = leaves.select("lang", F.explode(F.arrays_zip("sids", "counts")).alias("c")).groupBy("lang", F.col("c.sids").alias("sid")).agg(F.sum("c.counts").alias("n"))
    kept = leaves.groupBy("lang").agg(F.count("*").alias("v"))
    totals = groups.join(sums, ["lang", "sid"], "left").join(kept, "lang", "left").select("lang", "sid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    path = materialise(totals, "divergence-totals").barloom_path
    parts = materialise(leaves.select("lang", "term", "sids", "counts").mapInArrow(lambda it: _score(it, path, top), PARTS), "divergence-parts")
    return _ranked(groups, parts, top)


def _ranked(groups: DataFrame, parts: DataFrame, top: int) -> DataFrame:
    own = groups.select("lang", F.col("sid").alias("a"), "source")
    other = groups.select("lang", F.col("sid").alias("b"), F.col("source").alias("item"))
    half = parts.where("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # Every source meets the others of its language: this is the result itself.
    pairs = own.join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    first = F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "term"))
    best = parts.where("b IS NULL").withColumn("rank", first).where(F.col("rank") <= top)
    terms = best.join(own, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("*", place.alias("rank")).union(terms)


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
t AS (SELECT g.lang, g.source, coalesce(any_value(v.v), 0) AS v, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY 1, 2),
l AS (SELECT lang, any_value(v) AS v, sum(n) AS n FROM t GROUP BY 1),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 5) AS HUGEINT) // CAST(t.n + 5 * t.v AS HUGEINT) AS p FROM t JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + CAST(1000000000 * (sum(c.n) + 5) AS HUGEINT) // CAST(any_value(l.n) + 5 * any_value(l.v) AS HUGEINT) AS q FROM k JOIN c USING (lang, term) JOIN l ON l.lang = k.lang GROUP BY 1, 2),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 50"""
