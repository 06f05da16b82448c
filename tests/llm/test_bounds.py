"""Sizes beyond the usual: long words, headers, vocabularies and many short documents."""

import random
import struct
import time

import pytest

pytest.importorskip("barloom.llm")

from barloom.llm import jaccard, packing, records, tokens, warc  # noqa: E402
from barloom.llm.common import scratch  # noqa: E402

from .test_operators import brute_components  # noqa: E402


def test_long_words(spark):
    place = lambda a, b: "".join("a" if i in a else "b" if i in b else "x" for i in range(256))
    one, other = place({0, 192}, {64, 128}), place({64, 128}, {0, 192})
    assert jaccard.shingles(one).tolist() != jaccard.shingles(other).tolist()
    r = random.Random(4)
    words = ["".join(r.choice("日本語漢字abc") for _ in range(r.randint(60, 400))) for _ in range(6)]
    runs = [words[0][k : k + 64] for k in range(0, 256, 64)]
    words += ["".join(r.sample(runs, len(runs))) for _ in range(6)] + [one, other]
    tail = " ".join(f"w{k}" for k in range(5))
    rows = [(k, f"{w} {tail}") for k, w in enumerate(words)] + [(100 + k, w) for k, w in enumerate(words)] + [(200, f"{one} {tail}")]
    rows += [(300 + k, " ".join(r.choice(words) for _ in range(40))) for k in range(4)]
    rows += [(310 + k, rows[-4 + k][1] + " end") for k in range(4)]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(rows))
    alone = {w: tuple(jaccard.shingles(w).tolist()) for w in words}
    assert len(set(alone.values())) == len(set(words))
    mixed = " ".join(words)  # a word's hash doesn't depend on its neighbours
    assert tuple(jaccard.shingles(" ".join(words[:5])).tolist())[0] in jaccard.shingles(mixed).tolist()


def test_long_header(spark):
    pages = [(1, "http://x/" + "é" * 400_000, "a page"), (2, "u", "a page"), (3, "v", "other")]
    manifest = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), scratch(spark, "w"))
    got = warc.read(manifest).collect()
    assert sorted((r.page_id, r.record_type) for r in got if r.kind == "record") == [(1, "response"), (2, "revisit"), (3, "response")]
    assert not [r for r in got if r.kind == "gap"]
    plain = warc.build(1, "x" * (3 << 20), b"p") + warc.build(2, "u", b"q")
    assert [type(x) for x in warc.salvage(plain)] == [warc.Record, warc.Record]


def test_wide_ids():
    ids = struct.pack("<3I", 1, 70_000, 2)
    assert records.ids_of(records.payload_of(5, ids, 4)) == (5, ids)
    with pytest.raises(ValueError, match="70000"):
        records.payload_of(5, ids, 2)


def test_width_follows_the_vocabulary(spark, tmp_path):
    import json

    vocab = {f"w{k}": k for k in range(100_000)} | {"[UNK]": 100_000}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}}
    path = tmp_path / "words.json"
    path.write_text(json.dumps(spec))
    assert tokens.largest_id(str(path)) == 100_000


def test_many_short_documents():
    packer = packing.TierPacker((256, 512, 1024, 2048, 4096), 1 << 20, 1 << 16)
    began, total, sizes = time.process_time(), 0, set()
    for k in range(1_000_000):
        for size, _, pieces in packer.add(k, 1):
            total += sum(n for _, _, n in pieces)
            sizes.add(size)
    for size, _, pieces in packer.finish():
        total += sum(n for _, _, n in pieces)
        sizes.add(size)
    assert time.process_time() - began < 10 and total == 1_000_000
    assert all(s & (s - 1) == 0 for s in sizes)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_the_cache_of_pieces_is_bounded(name):
    path = tokens.public_path(name)
    small, whole = tokens.PieceEncoder(path, limit=60), tokens.PieceEncoder(path)
    r = random.Random(8)
    for _ in range(60):
        text = " ".join("".join(r.choice("abcdé!.\n") for _ in range(r.randint(1, 5))) for _ in range(12)) + " the end"
        assert small.encode(text) == whole.encode(text)
        held = [small.first, small.marks, *([] if small.rest is small.first else [small.rest])]
        assert sum(len(c) + len(c.old) for c in held) <= 60 + 2 * 40
