"""Exact dedup with Patricia-trie owners.

Rows are keyed by byte length and content hash. Each map task first merges its own equal
texts in a local trie, so a group of copies sends one entry a task. The entries are dealt by
key; each partition inserts the full byte strings into a compressed radix trie whose terminal
nodes hold the owner. A trie beyond its memory budget spills its largest subtree to a file in
the shared folder and rebuilds it alone at the end.

Defined results: a null text counts as empty; among equal texts the row with the largest
doc_id stays (smallest on request), null ids rank below all others; of fully tied rows one
stays; ids are integers (others raise); an empty table gives an empty result; other columns
pass through; where one is called `exact` the result is `_exact` (free_name).
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, fresh, materialise, open_fs, scan_partitions, scratch, ship, table, text_of


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Owner:
    """What a terminal node holds: the best id, its rows, all rows, and the caller's tag."""

    __slots__ = ("id", "n_best", "rows", "tag")

    def __init__(self, id_, n_best: int, rows: int, tag):
        self.id, self.n_best, self.rows, self.tag = id_, n_best, rows, tag

    def merge(self, id_, n_best: int, rows: int, largest: bool) -> None:
        self.rows += rows
        if id_ == self.id:
            self.n_best += n_best
        elif id_ is not None and (self.id is None or (id_ > self.id) == largest):
            self.id, self.n_best = id_, n_best


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.children, self.owner = label, {}, owner


class PatriciaTrie:
    """Byte strings to owners. Beyond `budget` bytes of labels the largest subtree of the root
    goes to a file in `folder`, and later strings of that subtree follow it there."""

    NODE_BYTES = 300

    def __init__(self, largest: bool = True, budget: int = 192 << 20, folder: str = "", depth: int = 0):
        self.largest, self.budget, self.folder, self.depth = largest, budget, folder, depth
        self.root = Node(b"")
        self.bytes_of: dict[int, int] = {}
        self.total = 0
        self.spilled: dict[int, object] = {}
        self.spills = 0

    def insert(self, key: bytes, id_, n_best: int = 1, rows: int = 1, tag=None) -> None:
        at = self.depth
        first = key[at] if at < len(key) else -1
        if first in self.spilled:
            pickle.dump((key, id_, n_best, rows, tag), self.spilled[first][1])
            return
        added = self._place(key, at, id_, n_best, rows, tag)
        if added:
            self.bytes_of[first] = self.bytes_of.get(first, 0) + added
            self.total += added
            if self.total > self.budget:
                self._spill()

    def _place(self, key: bytes, at: int, id_, n_best: int, rows: int, tag) -> int:
        node = self.root
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], Owner(id_, n_best, rows, tag))
                return len(key) - at + self.NODE_BYTES
            if not key.startswith(child.label, at):
                cut = shared_prefix(child.label, key[at:])
                upper = Node(child.label[:cut])
                child.label = child.label[cut:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                child = upper
            at += len(child.label)
            node = child
        if node.owner is None:
            node.owner = Owner(id_, n_best, rows, tag)
            return self.NODE_BYTES
        node.owner.merge(id_, n_best, rows, self.largest)
        return 0

    def _walk(self, top: Node, prefix: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(top, prefix)]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.owner is not None:
                yield path, node.owner
            stack += [(x, path) for x in node.children.values()]

    def _spill(self) -> None:
        worst = max((b for b in self.bytes_of if b >= 0), key=self.bytes_of.get, default=None)
        if worst is None:
            return
        path = f"{self.folder}/spill-{uuid.uuid4().hex}"
        fs, p = open_fs(path)
        fs.create_dir(open_fs(self.folder)[1], recursive=True)
        sink = fs.open_output_stream(p)
        # The part above the root is the same for all strings here; any of them tells it.
        for key, o in self._walk(self.root.children.pop(worst), self.prefix):
            pickle.dump((key, o.id, o.n_best, o.rows, o.tag), sink)
        self.spilled[worst] = path, sink
        self.spills += 1
        self.total -= self.bytes_of.pop(worst)

    prefix = b""

    def items(self) -> Iterator[tuple[bytes, Owner]]:
        yield from self._walk(self.root, self.prefix)
        self.root = Node(b"")
        for path, sink in self.spilled.values():
            sink.close()
            yield from self._rebuilt(path)
            fs, p = open_fs(path)
            fs.delete_file(p)

    def _rebuilt(self, path: str) -> Iterator[tuple[bytes, Owner]]:
        def entries() -> Iterator[tuple]:
            fs, p = open_fs(path)
            with fs.open_input_file(p) as source:
                while True:
                    try:
                        yield pickle.load(source)
                    except EOFError:
                        return

        lead = None
        for key, *_ in entries():
            lead = key if lead is None else lead[: shared_prefix(lead, key)]
        below = PatriciaTrie(self.largest, self.budget, self.folder, len(lead or b""))
        below.prefix = lead or b""
        for entry in entries():
            below.insert(*entry)
        yield from below.items()
        self.spills += below.spills


ENTRY = "n_bytes long, sha string, content binary, best_id long, n_best long, n_rows long"


def _merge_batches(batches: Iterable, largest: bool, budget: int, folder: str, content: bool, partial: bool) -> Iterator:
    """Entries of Arrow batches through a trie. partial: rather than spill, hand out what is there."""
    import pyarrow as pa

    def out(trie: PatriciaTrie) -> Iterator:
        rows, size = [], 0
        for key, o in trie.items():
            rows.append((len(key), o.tag, key if content else None, o.id, o.n_best, o.rows))
            size += len(key) if content else 0
            if size > 4 << 20 or len(rows) >= 20_000:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    names = ["n_bytes", "sha", *(["content"] if content else []), "best_id", "n_best", "n_rows"]
    types = {"n_bytes": pa.int64(), "sha": pa.string(), "content": pa.binary(), "best_id": pa.int64(), "n_best": pa.int64(), "n_rows": pa.int64()}

    def batch(rows: list):
        cols = dict(zip(("n_bytes", "sha", "content", "best_id", "n_best", "n_rows"), zip(*rows), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[n], types[n]) for n in names], names=names)

    trie = PatriciaTrie(largest, budget if not partial else 1 << 62, folder)
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("content", "best_id", "n_best", "n_rows", "sha")]
        for row in zip(*cols, strict=True):
            trie.insert(*row)
        if partial and trie.total > budget:
            yield from out(trie)
            trie = PatriciaTrie(largest, 1 << 62)
    yield from out(trie)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "largest", partitions: int | None = None, budget: int = 192 << 20) -> DataFrame:
    """One row for each distinct text: n_bytes, sha, best_id (the id that stays), n_best
    (rows with that id), n_rows. keep: 'largest' or 'smallest' id."""
    spark = docs.sparkSession
    ship(spark)
    largest = {"largest": True, "smallest": False}[keep]
    text = text_of(text_col)
    rows = docs.select(
        F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), F.encode(text, "UTF-8").alias("content"),
        F.col(id_col).cast("long").alias("best_id"), F.lit(1).cast("long").alias("n_best"), F.lit(1).cast("long").alias("n_rows"),
    )
    folder = scratch(spark, "exact-spill")
    local = rows.mapInArrow(lambda it: _merge_batches(it, largest, budget // 3, folder, True, True), ENTRY)
    dealt = local.repartition(partitions or scan_partitions(spark), "n_bytes", "sha")
    return dealt.mapInArrow(lambda it: _merge_batches(it, largest, budget, folder, False, False), ENTRY.replace("content binary, ", ""))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, carry: tuple[str, ...] | None = None, **how) -> DataFrame:
    """The columns in carry (all, by default) and a struct column `exact`: keep_id,
    group_size, kept, sha. Rows meet their owner by content hash in a join that adaptive
    execution splits where one text is very frequent."""
    own = materialise(owners(docs, id_col, text_col, **how), "exact-owners")
    carry = tuple(docs.columns) if carry is None else carry
    sha, osha, uid, oid, nb, nr, pos = fresh(docs, "sha", "owner_sha", "uid", "best_id", "n_best", "n_rows", "pos")
    rows = docs.withColumn(sha, F.sha2(text_of(text_col), 256))
    rows = rows.select(*dict.fromkeys((*carry, id_col)), sha)
    own_renamed = own.select(F.col("sha").alias(osha), F.col("best_id").alias(oid), F.col("n_best").alias(nb), F.col("n_rows").alias(nr))
    df = rows.join(own_renamed, F.col(sha) == F.col(osha), "inner")
    best = F.col(id_col).eqNullSafe(F.col(oid))
    if not own.where("n_best > 1").isEmpty():
        # Rows tied in text and id: number them; all others are groups of their own.
        df = df.withColumn(uid, F.monotonically_increasing_id().cast("string"))
        tied = best & (F.col(nb) > 1)
        from pyspark.sql import Window

        df = df.withColumn(pos, F.row_number().over(Window.partitionBy(F.when(tied, F.col(sha)).otherwise(F.col(uid))).orderBy(uid)))
        best = best & (F.col(pos) == 1)
    return df.select(*carry, F.struct(F.col(oid).alias("keep_id"), F.col(nr).alias("group_size"), best.alias("kept"), F.col(sha).alias("sha")).alias(free_name(docs, "exact", carry)))


def op8_query(spark, sf_dir: str) -> DataFrame:
    m = mark(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return m.select("doc_id", "exact.keep_id", "exact.group_size", "exact.kept", F.col("exact.sha").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each distinct text, columns unchanged."""
    name = free_name(docs, "exact")
    return mark(docs).where(f"{name}.kept").drop(name)
