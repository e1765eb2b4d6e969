"""Packing: every id in one piece, no overlap, little padding; the tree against plain first-fit."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm.packing import first_fit_decreasing, pack, pack_documents, padding

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(sizes, capacity):
    free, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(capacity)
        free[b] -= sizes[i]
        bins[i] = b
    return bins


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 700])
def test_first_fit_decreasing(n):
    rng = random.Random(n)
    sizes = np.array([rng.randint(1, 1024) for _ in range(n)], np.int64)
    assert first_fit_decreasing(sizes).tolist() == plain(sizes.tolist(), 1024)


@pytest.mark.parametrize("n, high", [(1, 5), (9, 1023), (400, 1023), (3000, 60), (500, 600)])
def test_pack_is_whole_and_tight(n, high):
    rng = random.Random(n)
    sizes = np.array([rng.randint(1, high) for _ in range(n)], np.int64)
    pieces = pack(sizes)
    bins, items = {}, {}
    for item, start, length, b, offset in pieces:
        bins.setdefault(b, []).append((offset, length))
        items.setdefault(item, []).append((start, length))
    for i, parts in items.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:], strict=False)) and sum(p[1] for p in parts) == sizes[i]
    assert set(items) == set(range(n)) and set(bins) == set(range(len(bins)))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:], strict=False)) and sum(p[1] for p in parts) <= 1024
    assert len(bins) <= -(-int(sizes.sum()) // 1024) + 1


def test_rows(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = [None, "", "a", "<|endoftext|> x", "word " * 40_000, *(" ".join(rng.choice(["the", "über", "ingly", "42,"]) for _ in range(rng.randint(1, 1500))) for _ in range(60))]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1), (None, "null id", 1), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = pack_documents(spark, docs, PATH, group=16).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lost = 0
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:], strict=False))
        fill = sum(p[1] for p in parts)
        assert fill <= 1024
        lost += padding(fill)
    assert lost < 0.05 * sum(r.length for r in got)
    for i, t in enumerate(texts):
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        times = 2 if i == 5 else 1
        assert all(r.doc_tokens == len(own) for r in got if r.doc_id == i)
        assert sum(p[1] for p in parts) == times * len(own)
        assert all(zlib.crc32(own[a : a + n]) == c for a, n, c in parts)
    assert sum(r.length for r in got if r.doc_id is None) == 2 * (len(library.encode("null id", add_special_tokens=False).ids) + 1)
    assert pack_documents(spark, docs.limit(0), PATH).count() == 0


def test_large_ids_beside_nulls_and_words_that_share_a_hash(spark):
    from tests.llm.test_bpe import TWINS

    library = Tokenizer.from_file(PATH)
    rows = [(None, "x"), ((1 << 60) + 1, "a b"), ((1 << 60) + 3, "a b"), *(((1 << 61) + i, t) for i, t in enumerate(TWINS))]
    got = pack_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    for doc, text in rows:
        own = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        parts = [r for r in got if r.doc_id == doc]
        assert sum(r.length for r in parts) == len(own) and all(zlib.crc32(own[r.start : r.start + r.length]) == r.ids_crc32 for r in parts)


def test_a_row_repeated_very_often_spreads_over_the_groups(spark):
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "'again and again' AS text")
    got = pack_documents(spark, docs, PATH, group=1000).selectExpr("sequence_id >> 32 AS g").groupBy("g").count().collect()
    assert len(got) == 100 and max(r["count"] for r in got) < 1500 and sum(r["count"] for r in got) >= 100_000
