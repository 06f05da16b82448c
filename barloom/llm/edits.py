"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A text is cut before each single space that a non-space follows: no token spans such a cut,
whatever stands on its sides. The pieces are the leaves of a tree whose nodes sum code points
and tokens. An edit finds its leaves by descending the tree, re-encodes them with one leaf of
context on either side, cuts the new text into leaves again and updates the sums on the paths
above. Leaves that become free stay as empty places; where there are too few, the tree gets new
places without encoding anything else. A tree is kept between runs as the sizes of its leaves
(keep_tree, tree): later edits start from it and encode only what they touch.

Defined results: a null text counts as empty; an empty text has one empty leaf; an edit beyond
the end acts at the end; null edits, or none, leave the count as it is; a tree that doesn't fit
its text raises ValueError; ids are integers (others raise); repeated rows are counted each; an
empty table gives an empty result; columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table, text_of
from .tokens import PieceEncoder, encoder, public_path


class CountTree:
    def __init__(self, enc: PieceEncoder, text: str, kept: list[int] | None = None):
        """kept: code points and tokens of each leaf in turn, as sizes() gives them."""
        self.enc = enc
        if kept is None:
            head, tail = enc.cut(text)
            leaves = [head, *(" " + p for p in tail)]
            tokens = [len(x) // 4 for x in enc.lookup(head, tail)]
        else:
            at, leaves, tokens = 0, [], list(kept[1::2])
            for n in kept[::2]:
                leaves.append(text[at : at + n])
                at += n
            if at != len(text):
                raise ValueError("the tree is not of this text")
        self._grow(leaves, tokens)
        self.encoded = 0

    def _grow(self, leaves: list[str], tokens) -> None:
        import numpy as np

        self.leaves = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2, 2 * self.size), np.int64)
        self.sums[0, self.size : self.size + len(leaves)] = tokens
        self.sums[1, self.size : self.size + len(leaves)] = [len(x) for x in leaves]
        width = self.size
        while width > 1:
            level = self.sums[:, width : 2 * width]
            self.sums[:, width // 2 : width] = level[:, ::2] + level[:, 1::2]
            width //= 2

    def sizes(self) -> list[int]:
        held = self.sums[:, self.size : self.size + len(self.leaves)]
        return held[::-1].T.ravel().tolist()

    @property
    def tokens(self) -> int:
        return int(self.sums[0, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at`, and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[1, node])
            if at >= start + left:
                start, node = start + left, node + 1
        return min(node - self.size, len(self.leaves) - 1), start

    def _put(self, first: int, last: int, leaves: list[str], tokens: list[int]) -> None:
        """Put new leaves in the places first to last, and update the sums above them."""
        free = last - first + 1 - len(leaves)
        if free < 0:
            old = self.sums[0, self.size : self.size + len(self.leaves)].tolist()
            self._grow([*self.leaves[:first], *leaves, *self.leaves[last + 1 :]], [*old[:first], *tokens, *old[last + 1 :]])
            return
        self.leaves[first : last + 1] = [*leaves, *[""] * free]
        low, high = first + self.size, last + self.size
        self.sums[0, low : high + 1] = [*tokens, *[0] * free]
        self.sums[1, low : high + 1] = [len(x) for x in self.leaves[first : last + 1]]
        while low > 1:
            low, high = low // 2, high // 2
            level = self.sums[:, 2 * low : 2 * high + 2]
            self.sums[:, low : high + 1] = level[:, ::2] + level[:, 1::2]

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf that isn't empty, or the last on that side."""
        while 0 < leaf + step < len(self.leaves):
            leaf += step
            if self.leaves[leaf]:
                return leaf
        return max(0, min(leaf + step, len(self.leaves) - 1))

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Put `insert` in place of `remove` code points from `at`."""
        at = max(0, min(at, self.chars))
        stop = max(at, min(at + remove, self.chars))
        first, _ = self._leaf(max(0, min(at, self.chars - 1)))
        last, _ = self._leaf(max(0, min(stop, self.chars - 1)))
        first, last = self._beside(first, -1), self._beside(last, 1)
        start = self._start(first)
        old = "".join(self.leaves[first : last + 1])
        new = old[: at - start] + insert + old[stop - start :]
        head, tail = self.enc.cut(new)
        ids = self.enc.lookup(head, tail)
        leaves = [head, *(" " + p for p in tail)]
        if not head and tail:
            leaves, ids = leaves[1:], ids[1:]
        self.encoded += len(ids)
        self._put(first, last, leaves, [len(x) // 4 for x in ids])

    def _start(self, leaf: int) -> int:
        """Code points before a leaf: sums of the left siblings on its path."""
        node, total = leaf + self.size, 0
        while node > 1:
            if node & 1:
                total += int(self.sums[1, node - 1])
            node //= 2
        return total


EDIT = "array<struct<at:long,remove:long,insert:string>>"
RESULT = "n_tokens long, n_tokens_after long, n_pieces long, n_encoded long"


def _count(batches: Iterable, path: str, keep_text: bool, keep_tree: bool) -> Iterator:
    import pyarrow as pa

    enc = encoder(path)
    names = ["n_tokens", "n_tokens_after", "n_pieces", "n_encoded"]
    for b in batches:
        out: list[tuple] = []
        for text, edits, kept in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            tree = CountTree(enc, text, kept)
            before, n = tree.tokens, len(tree.leaves)
            for e in edits or ():
                if e is not None:
                    tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
            out.append((before, tree.tokens, n, tree.encoded, tree.text() if keep_text else None, tree.sizes() if keep_tree else None))
        if out:
            cols = list(zip(*out, strict=True))
            more = [("text", pa.string(), keep_text), ("tree", pa.list_(pa.int64()), keep_tree)]
            arrays = [pa.array(c, t) for c, (_, t, wanted) in zip(cols[4:], more, strict=True) if wanted]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *arrays], names=["doc_id", *names, *(n for n, _, wanted in more if wanted)])


def count(docs: DataFrame, edits: Column, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, keep_text: bool = False, keep_tree: bool = False, tree: Column | None = None) -> DataFrame:
    """doc_id, tokens before and after a document's edits, its pieces, the pieces that the
    edits re-encoded, and on request the edited text and its tree. edits: an EDIT column of docs;
    each edit is in code points of the text as the edits before it left it. tree: a column that
    an earlier run kept for these texts; null starts anew."""
    ship(docs.sparkSession)
    kept = (F.lit(None) if tree is None else tree).cast("array<long>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), edits.cast(EDIT).alias("edits"), kept.alias("kept"))
    schema = f"doc_id long, {RESULT}" + (", text string" if keep_text else "") + (", tree array<long>" if keep_tree else "")
    return rows.mapInArrow(lambda it: _count(it, tokenizer_path, keep_text, keep_tree), schema)


def trial_edits(text_col: str = "text", id_col: str = "doc_id") -> Column:
    """Three edits of each document, at hashed places: an insertion, a deletion of twelve code
    points, and a replacement of five."""
    n = F.length(text_of(text_col)).cast("long")
    at = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), n + 1)
    edit = lambda k, remove, insert: F.struct(at(k).alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(edit(1, 0, " an inserted phrase, "), edit(2, 12, ""), edit(3, 5, "re placed\n"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"), trial_edits(), public_path("byte_bpe_50k.json"))
