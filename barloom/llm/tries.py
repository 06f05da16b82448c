"""Radix tries over byte strings: counted in a task, cut into prefix ranges, merged, walked in order.

An edge holds a run of bytes, so a node has a term or at least two children. A leaf is a node with a
number, under which it has counters: documents, and one count for each source. Counters lie in arrays: what
is added is kept as it came, and summed when there is twice as much of it as sums. A walk takes
children by their byte, hence gives terms in the order of their bytes, which for UTF-8 is the order of
code points.
"""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    __slots__ = ("label", "kids", "leaf")

    def __init__(self, label: bytes):
        self.label = label
        self.kids: dict[int, Node] | None = None
        self.leaf = -1


class Trie:
    def __init__(self, sources: int):
        import numpy as np

        self.root, self.terms, self.sources = Node(b""), 0, sources
        self.docs = np.zeros(1024, np.int64)
        #: Sums by leaf * sources + source, and what came since.
        self.sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.late: list[tuple] = []
        self.n_late = 0

    def leaf(self, term: bytes, number: int | None = None) -> int:
        """The number of a term's leaf, made where there is none; a new one gets the given number, by
        default the next."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            if node.kids is None:
                node.kids = {}
            child = node.kids.get(term[at])
            if child is None:
                child = node.kids[term[at]] = Node(term[at:])
                at = end
            elif term.startswith(child.label, at):
                at += len(child.label)
            else:
                child = self._cut(node, child, term, at)
                at += len(child.label)
            node = child
        if node.leaf < 0:
            node.leaf = self.terms if number is None else number
            self.terms += 1
        return node.leaf

    @staticmethod
    def _cut(node: Node, child: Node, term: bytes, at: int) -> Node:
        """Cut the edge to child where term leaves it; the node that now stands there."""
        label, n = child.label, 0
        most = min(len(label), len(term) - at)
        while n < most and label[n] == term[at + n]:
            n += 1
        mid = Node(label[:n])
        child.label = label[n:]
        mid.kids = {child.label[0]: child}
        node.kids[label[0]] = mid
        return mid

    def add_docs(self, leaves, n) -> None:
        """Add to the documents of leaves; a leaf may come again."""
        import numpy as np

        if len(self.docs) < self.terms:
            self.docs = np.concatenate([self.docs, np.zeros(2 * self.terms - len(self.docs), np.int64)])
        np.add.at(self.docs, leaves, n)

    def add_counts(self, leaves, sources, n) -> None:
        self.late.append((leaves * self.sources + sources, n))
        self.n_late += len(n)
        if self.n_late > 65_536 + 2 * len(self.sums[0]):
            self.settle()

    def settle(self) -> None:
        import numpy as np

        parts = [self.sums, *self.late]
        self.late, self.n_late = [], 0
        self.sums = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    @property
    def counters(self) -> int:
        return len(self.sums[0]) + self.n_late

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf) in the order of the bytes."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node.leaf >= 0:
                yield prefix, node.leaf
            if node.kids:
                for byte in sorted(node.kids, reverse=True):
                    child = node.kids[byte]
                    stack.append((prefix + child.label, child))

    def columns(self) -> tuple:
        """terms, docs, sizes, sources, counts of the walk: of each term its documents and how many of
        the (source, count) pairs are its own."""
        import numpy as np

        self.settle()
        self.add_docs(np.zeros(0, np.int64), 0)
        walked = list(self.walk())
        order = np.array([leaf for _, leaf in walked], np.int64)
        place = np.empty(self.terms, np.int64)
        place[order] = np.arange(len(order))
        leaf, source = np.divmod(self.sums[0], self.sources)
        leaf = place[leaf]
        by = np.lexsort((source, leaf))
        return [t for t, _ in walked], self.docs[order], np.bincount(leaf, minlength=len(order)), source[by], self.sums[1][by]


def summed(keys, n):
    """Distinct keys in order, with the sums of n."""
    import numpy as np

    if not len(keys):
        return keys, n
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def tallied(keys):
    """Distinct keys in order, and how often each is there."""
    import numpy as np

    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else keys
    return keys[first], np.diff(np.r_[first, len(keys)])
