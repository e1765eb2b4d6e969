"""SimHash fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(1)
    words = ["Alpha", "beta", "GAMMA", "é", "delta x", "a"]
    for n in (0, 1, 2, 3, 4, 30, 500):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t  ", "\x0b"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("n, spread", [(40, 2), (300, 4), (1500, 6)])
def test_stars_link_as_brute_force(n, spread):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = centre[rng.integers(0, 6, n)]
    for _ in range(spread):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fps = np.unique(fps)
    u, v = simhash.stars(np.zeros(len(fps), np.int64), fps)
    label = {int(x): int(x) for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        label[root(a)] = root(b)
    mine = [root(int(x)) for x in fps]
    true = brute_components([int(x) for x in fps], list(range(len(fps))))
    assert len(set(zip(mine, true, strict=True))) == len(set(mine)) == len(set(true))


def test_any_number_of_blocks_gives_the_same_components(spark, tmp_path):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = centre[rng.integers(0, 40, 600)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    fps = np.unique(fps)
    classes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    true = brute_components([int(x) for x in fps], list(range(len(fps))))
    want = {}
    for x, c in zip(fps.view(np.int64).tolist(), true, strict=True):
        want.setdefault(c, []).append(x)
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    for m in (5, 6, 7, 8):
        got = {}
        for node, root in components(spark, simhash.links(spark, classes, m=m), str(tmp_path / str(m))).collect():
            got.setdefault(root, []).append(node)
        assert sorted(sorted(v) for v in got.values()) == want, m
    assert [simhash.blocks(n) for n in (0, 10**6, 1 << 33, 1 << 39, 1 << 60)] == [5, 5, 5, 6, 8]


def test_components_of_a_long_chain_and_a_star(spark, tmp_path):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    found = dict(components(spark, spark.createDataFrame(edges, "u long, v long"), str(tmp_path)).collect())
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark, spark.createDataFrame([], "u long, v long"), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("tile", [4096, 4])
def test_op8_as_brute_force(spark, tmp_path, tile):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(80)] for _ in range(5)]
    rows = [(None, "x y z", 1), (900, None, 1), (901, "", 1), (902, " \n", 1), (901, "", 1)]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = "zz"
        rows.append((i, " ".join(words), 1))
    rows.append((800, "w " * 60_000, 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    frame.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = sorted(map(tuple, simhash.simhash_dedup(spark, docs, tile=tile).collect()), key=str)
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows]), strict=True)), key=str)
    assert got == want
    kept = simhash.drop_near_copies(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r[0] is None else r[0] for r in kept.collect()) == sorted({-1 if c is None else c for _, _, c in want})


def test_op8_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string").filter(F.lit(True))
    assert simhash.simhash_dedup(spark, empty).count() == 0
