"""Suffix deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import suffix_dedup as S


def brute(rows, length=100):
    """rows: (doc_id, text), in the order of documents."""
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length, alphabet, start", [(28, 2, 7), (28, 30, 28), (100, 2, 28), (57, 3, 56)])
def test_repeated_as_brute_force(length, alphabet, start):
    rng = np.random.default_rng(length)
    base = rng.integers(0, alphabet, 400)
    texts = []
    for _ in range(60):
        a = rng.integers(0, 300)
        t = base[a : a + rng.integers(0, 160)].copy()
        if len(t) and rng.random() < 0.5:
            t[rng.integers(0, len(t))] = 255
        texts.append(t)
    data = np.concatenate(texts).astype(np.uint8)
    ends = np.r_[0, np.cumsum([len(t) for t in texts])]
    places = {}
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        for i in range(a, b - length + 1):
            places.setdefault(data[i : i + length].tobytes(), []).append(int(i))
    want = sorted(p for p in places.values() if len(p) > 1)
    group, place = S.repeated(data, ends, length, start)
    got = {}
    for g, p in zip(group.tolist(), place.tolist(), strict=True):
        got.setdefault(g, []).append(p)
    assert sorted(sorted(p) for p in got.values()) == want
    assert want or length == 57


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(40) for _ in range(5)]
    rows = []
    for i in range(120):
        kind = i % 8
        text = [prose(60), prose(20) + passages[i % 5] + prose(30), rows[-2][1] if len(rows) > 2 else "", prose(3), "x" * rng.randint(90, 400), (rows[-3][1] or "") + "!" if len(rows) > 3 else "y", ("line of text, " * 3 + "\n") * 12, None][kind]
        if kind == 5 and text and len(text) > 200:
            cut = rng.randrange(len(text))
            text = text[:cut] + "#" + text[cut + 1 :]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_as_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    shuffled = random.Random(0).sample(rows, len(rows))
    docs = spark.createDataFrame([(*r, 1) for r in shuffled], "doc_id long, text string, n_bytes int").repartition(4)
    assert sorted(map(tuple, S.suffix_dedup(spark, docs).collect())) == brute(rows)


@pytest.mark.parametrize("crowded, piece", [(1, 1 << 18), (2, 400), (4, 1500), (10**6, 300), (10**6, 1 << 18)])
def test_blocks_flushes_pieces_and_crowded_anchors(monkeypatch, crowded, piece):
    monkeypatch.setattr(S, "BLOCK", 700)
    monkeypatch.setattr(S, "FLUSH", 50)
    monkeypatch.setattr(S, "CROWDED", crowded)
    monkeypatch.setattr(S, "PIECE", piece)
    rows = [*corpus(3)[:40], (1000, " ".join(t or "" for _, t in corpus(4)[:60]))]
    batches = [S.pa.RecordBatch.from_pydict({"__key": [r[0] for r in rows], "__text": [r[1] for r in rows]})]
    scanned = S.pa.Table.from_batches(list(S._scan(3)(iter(batches)))).sort_by("bucket")
    table = S.pa.Table.from_batches(list(S._resolve(iter(scanned.to_batches(7))))).to_pandas()
    lists = [[(r.kind, r.anchor, r.start, r.stop) for r in table[(table.key == k) & table.kind.isin([S.STRINGS, S.APART])].itertuples()] for k, _ in rows]
    struct = S.pa.list_(S.pa.struct([("kind", S.pa.int32()), ("anchor", S.pa.int64()), ("start", S.pa.int64()), ("stop", S.pa.int64())]))
    batch = S.pa.RecordBatch.from_arrays([S.pa.array([r[0] for r in rows]), S.pa.array([r[1] for r in rows]), S.pa.array([[dict(zip(("kind", "anchor", "start", "stop"), x, strict=True)) for x in lst] for lst in lists], struct)], names=["__key", "__text", "list"])
    fetched = S.pa.Table.from_batches(list(S._fetch(iter([batch])))).to_pylist()
    assert any(r["kind"] == S.APART for r in fetched) == (crowded < 10**6)
    covered = [(k, a, b) for t in [table[table.kind == S.REPEATS]] for k, a, b in zip(t.key, t.start, t.stop, strict=True)]
    strings, first = [r for r in fetched if r["kind"] == S.STRINGS], {}
    for r in sorted((r for r in fetched if r["kind"] == S.APART), key=lambda r: (r["key"], r["start"])):
        if first.setdefault((r["anchor"], r["string"]), r) is not r:
            covered.append((r["key"], r["start"], r["start"] + len(r["string"]) - S.LENGTH + 1))
    strings = sorted([*strings, *first.values()], key=lambda r: r["anchor"])
    found = list(S._expand(iter(S.pa.Table.from_pylist([{c: r[c] for c in ("anchor", "key", "start", "string")} for r in strings]).to_batches(5))))
    covered += [(k, a, b) for f in found for k, a, b in zip(*(f.column(i).to_pylist() for i in range(3)), strict=True)]
    gone = {k: np.zeros(len((t or "").encode()), bool) for k, t in rows}
    for k, a, b in covered:
        gone[k][a : b - 1 + S.LENGTH] = True
    assert [int(gone[k].sum()) for k, _ in rows] == [r[2] for r in brute(rows)]


def test_pieces_stay_small(monkeypatch):
    """One anchor with many distinct strings goes through transforms of bounded size, and nothing is lost."""
    monkeypatch.setattr(S, "PIECE", 20_000)
    rng = random.Random(9)
    gram = "common thirty-two byte long gram"
    strings = [("".join(rng.choice("abcd") for _ in range(60)) + gram + "".join(rng.choice("abcd") for _ in range(60))).encode() for _ in range(800)]
    strings += [s[:110] + b"!" * 42 for s in strings[:300]]
    sizes, real = [], S.repeated
    monkeypatch.setattr(S, "repeated", lambda data, ends: (sizes.append(len(data)), real(data, ends))[1])
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.r_[0, np.cumsum([len(s) for s in strings])]
    n = len(strings)
    found = list(S._compared(np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), data, ends))
    got = {(int(k), w) for key, a, b in found for k, x, y in zip(key, a, b, strict=True) for w in range(x, y)}
    seen, want = set(), set()
    for k, s in enumerate(strings):
        for i in range(len(s) - 99):
            if s[i : i + 100] in seen:
                want.add((k, i))
            seen.add(s[i : i + 100])
    assert got == want and want and max(sizes) < 60_000 < len(data)


def test_a_text_beyond_a_block_through_spark(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    long = prose(250_000) + passage + prose(190_000) + passage[5:]
    assert len(long) > S.BLOCK + 1000
    twins = ["".join(x[i.bit_count() & 1] for i in range(4096)) for x in ("ab", "ba")]
    rows = [(1, prose(20) + passage + prose(9)), (2, long), (3, long[S.BLOCK - 300 : S.BLOCK + 300]), (4, twins[0]), (5, twins[1]), (6, prose(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, S.suffix_dedup(spark, docs).collect())) == brute(rows)


def test_rows_with_crowded_anchors(spark, monkeypatch):
    """A passage quoted by most documents, in other surroundings each time."""
    rng = random.Random(7)
    passage = " ".join(f"word{i}" for i in range(30))
    rows = [(i, " ".join(str(rng.random()) for _ in range(rng.randint(3, 20))) + passage + " ".join(str(rng.random()) for _ in range(9))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, S.suffix_dedup(spark, docs).collect())) == brute(rows)


def test_null_and_repeated_ids_and_empty_table(spark, tmp_path):
    rows = [(None, "p" * 150), (5, "q" * 120), (5, "q" * 120), (5, "p" * 150), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = sorted(((r[0], r[1], r[2]) for r in S.suffix_dedup(spark, spark.read.parquet(str(tmp_path / "d"))).collect()), key=str)
    assert got == sorted([(None, 150, got_removed(rows, 0)), (5, 120, got_removed(rows, 1)), (5, 120, 120), (5, 150, 150), (None, 0, 0)], key=str)
    assert S.suffix_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def got_removed(rows, i):
    return brute([rows[i]])[0][2]
