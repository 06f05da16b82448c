"""The audit of sources against a plain count, and its tries."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("barloom.llm")

from barloom.llm import divergence  # noqa: E402
from barloom.llm.tries import Trie  # noqa: E402

from .data import SCHEMA, corpus  # noqa: E402

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_docs, top):
    """rows: (text, lang, source)."""
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(lower(text or ""))
        counts[lang, source].update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        q = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(pairs)] + [(lang, s, "term", t, -v, k + 1) for k, (v, t) in enumerate(terms)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_trie():
    import numpy as np

    r = random.Random(3)
    words = [bytes(r.choice(b"ab\xc3\xe6z") for _ in range(r.randint(1, 6))) for _ in range(3000)]
    trie, want = Trie(3), defaultdict(Counter)
    for k, w in enumerate(words):
        leaf = np.array([trie.leaf(w)])
        trie.add_docs(leaf, 1)
        trie.add_counts(leaf, np.array([k % 3]), np.array([2]))
        want[w][k % 3] += 2
    terms, docs, sizes, sids, counts = trie.columns()
    assert terms == sorted(want) and trie.terms == len(want)
    assert docs.tolist() == [sum(want[t].values()) // 2 for t in terms]
    assert sizes.tolist() == [len(want[t]) for t in terms]
    assert list(zip(sids.tolist(), counts.tolist(), strict=True)) == [x for t in terms for x in sorted(want[t].items())]


@pytest.mark.parametrize("budget", [1 << 20, 50])
def test_divergence(spark, budget, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 1 << 21 if budget > 50 else 100)
    rows = corpus(5) + [(900 + k, "Straße naïve NAÏVE \x00x_y İ日本", "en", "b") + (None,) * 4 for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = result(divergence.divergence(docs, min_docs=2, top=7, budget=budget))
    assert got == plain([(x[1], x[2], x[3]) for x in rows], 2, 7)
    assert any(x[2] == "term" for x in got) and any(x[2] == "pair" and x[4] > 0 for x in got)


def test_ties_and_groups_without_terms(spark):
    rows = [(1, "b a c", "en", "x"), (2, "a b c", "en", "x"), (3, None, "en", None), (4, "...", None, "y"), (5, "a", None, "z"), (6, "d e", "en", "y"), (7, "e d", "en", "y")]
    docs = spark.createDataFrame([(*r, 0, None, None, 1) for r in rows], SCHEMA)
    got = result(divergence.divergence(docs, min_docs=2, top=2))
    assert got == plain([(x[1], x[2], x[3]) for x in rows], 2, 2)
    assert [x[3] for x in got if x[:3] == ("en", "x", "term")] == ["a", "b"]  # equal values: by bytes
    assert [x[4] for x in got if x[0] == ""] == [0, 0]


def test_empty(spark):
    assert result(divergence.divergence(spark.createDataFrame([], SCHEMA))) == []


def test_large_counts_do_not_overflow():
    import numpy as np

    n = np.array([[0, 7_000_000_000_000_000, 123_456_789_012_345]])
    total = np.int64(9_000_000_000_000_000)
    assert divergence.scaled(n, total).tolist() == [[1 + 10**9 * (int(x) + 5) // int(total) for x in n[0]]]
