"""Near copies by five-word shingles at a similarity of 0.8 against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import near_copies as N


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, least=0.8):
    """The number of the group of each text."""
    sets = [brute_set(t) for t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and len(a & b) >= least * len(a | b)):
                group[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def kept(texts, ids):
    """The places of the rows that stay: of each group the one with the smallest id, nulls first."""
    best = {}
    for i, g in enumerate(brute_groups(texts)):
        key = (ids[i] is not None, ids[i] or 0)
        best[g] = min(best.get(g, (key, i)), (key, i))
    return {i for _, i in best.values()}


def corpus(rng, n, share):
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 400))] for _ in range(8)]
    out = []
    for _ in range(n):
        if rng.random() < share:
            text = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        out.append(" ".join(text))
    return out


def test_prints_are_majorities():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 254, 255, 256, 700, 40_000):
        hashes = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        own = N.wide_print(hashes, 4)
        first = sum(1 << b for b in range(64) if 2 * int((hashes + np.uint64(0) >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes)) if n else 0
        mixed = hashes.copy()
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        want = sum(1 << b for b in range(64) if 2 * int((mixed >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
        assert int(own[0]) == want and first >= 0 and (N.wide_print(hashes, 8)[:4] == own).all()


@pytest.mark.parametrize("size", [30, 300, 1500])
def test_a_forest_joins_what_brute_force_joins(size):
    rng = np.random.default_rng(size)
    centre = rng.integers(0, 2**63, (5, 4), dtype=np.uint64)
    fps = centre[rng.integers(0, 5, size)]
    for _ in range(14):
        fps[np.arange(size), rng.integers(0, 4, size)] ^= np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64)
    groups = rng.integers(0, 2, size)
    limits = (8, 16, 24)
    a, b = N.forest(groups, fps, limits)
    assert (groups[a] == groups[b]).all() and (np.bitwise_count(fps[a] ^ fps[b]).sum(1) <= 24).all()

    def parts(pairs):
        label = list(range(size))

        def root(i):
            while label[i] != i:
                i = label[i]
            return i

        for x, y in pairs:
            label[root(x)] = root(y)
        return [root(i) for i in range(size)]

    near = [(i, j) for i in range(size) for j in np.flatnonzero((np.bitwise_count(fps ^ fps[i]).sum(1) <= 24) & (groups == groups[i])).tolist() if j < i]
    mine, true = parts(zip(a.tolist(), b.tolist(), strict=True)), parts(near)
    assert len(set(zip(mine, true, strict=True))) == len(set(mine)) == len(set(true)) and len(a) == size - len(set(true)), "a forest has no link too many"


def test_shapes():
    assert [N.shape(n) for n in (0, 1000, 10**6, 1 << 24, 1 << 28, 1 << 40)] == [(8, 4), (8, 4), (14, 4), (17, 8), (20, 16), (28, 64)]


@pytest.mark.parametrize("tile, most, share, shape", [(4096, 1000, 0.5, None), (16, 0, 0.9, None), (4096, 1000, 0.7, (17, 8))])
def test_as_brute_force(spark, tmp_path, monkeypatch, tile, most, share, shape):
    if shape:
        monkeypatch.setattr(N, "shape", lambda n: shape)
    rng = random.Random(tile)
    texts = [*corpus(rng, 300, share), None, "", " \n", "one two", "one  TWO", "a b c d e f", "a b c d e f g", "long " * 50_000, "long " * 50_001]
    ids = [None if i % 41 == 0 else 1000 - i for i in range(len(texts))]
    rows = [(ids[i], t, i, "x") for i, t in enumerate(texts)]
    rows += [(ids[3], texts[3], 9000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, place long, node string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = N.drop_near_copies(spark, docs, tile=tile, most=most)
    assert out.columns == docs.columns
    got = {r.place for r in out.collect()}
    want = {rows[i][2] for i in kept([r[1] for r in rows], [r[0] for r in rows])}
    assert got >= want, "no row goes without a copy that stays"
    assert len(got - want) <= 0.02 * (len(rows) - len(want)), "rows that should go stay"


def barely(rng, n):
    """n texts and, of each, a copy that is just similar enough."""
    out = []
    for _ in range(n):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(94, 104))]
        copy = list(text)
        for at in (rng.randint(5, 40), rng.randint(50, 85)):
            copy[at] = "other"
        out += [" ".join(text), " ".join(copy)]
    return out


@pytest.mark.parametrize("shape, tile, most", [(N.shape(1000), 4096, 1000), (N.shape(10**6), 4096, 1000), (N.shape(1 << 24), 16, 0), ((32, 4), 4096, 1000)])
def test_the_number_of_texts_does_not_change_the_result(spark, tmp_path, monkeypatch, shape, tile, most):
    monkeypatch.setattr(N, "shape", lambda n: shape)
    rng = random.Random(22)
    texts = corpus(rng, 150, 0.8) + barely(rng, 300) + [None, "", "a b", "a  B", "one line again " * 40, "one line again " * 41]
    ids = rng.sample(range(1000), len(texts))
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id for r in N.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "d")), tile=tile, most=most).collect()}
    assert got == {ids[i] for i in kept(texts, ids)}


def test_similar_sets_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(23)
    for _ in range(2000):
        rank = np.zeros(N.SLOTS, np.int32)
        rank[rng.integers(0, N.SLOTS, 1000)] = 1
        both, more, less = rng.integers(1, 60), rng.integers(0, 9), rng.integers(0, 9)
        hashes = rng.integers(0, 2**63, both + more + less, dtype=np.uint64)
        rank[N._slot(hashes[rng.random(len(hashes)) < 0.5])] = 2
        one, two = np.sort(hashes[: both + more]), np.sort(np.r_[hashes[:both], hashes[both + more :]])
        assert not N.similar(one, two) or len(np.intersect1d(N.prefix(one, rank), N.prefix(two, rank)))


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(24)
    ruled_out = 0
    for size in (1, 5, 60, 130, 900, 5000):
        for _ in range(100):
            both = int(rng.integers(1, size + 1))
            more, less = (int(rng.integers(0, max(2, size // 4))) for _ in range(2))
            hashes = np.unique(rng.integers(0, 2**63, both + more + less, dtype=np.uint64))
            one, two = np.sort(hashes[: both + more]), np.sort(np.r_[hashes[:both], hashes[both + more :]])
            may = N.may_hold(np.array([len(one) + len(two)] * 2), [N.sketch(one), N.sketch(two)], [N.sketch(two), N.sketch(one)])
            assert may[0] == may[1] and (may[0] or not N.similar(one, two))
            ruled_out += not may[0]
    assert ruled_out > 100 and not len(N.may_hold(np.zeros(0, np.int64), [], []))
    assert N.may_hold(np.array([0]), [N.sketch(hashes[:0])], [N.sketch(hashes[:0])]).all()


def passages(rng, n, pool):
    """n texts of some 300 words, each of which has three of the pool's passages of 50 words."""
    common = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(50)) for _ in range(pool)]
    out = []
    for _ in range(n):
        parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 60))) for _ in range(3)]
        out.append(" ".join(x for pair in zip(parts, rng.sample(common, 3), strict=True) for x in pair))
    return out


@pytest.mark.parametrize("crowd", [16, 1000])
def test_sets_of_texts_that_only_share_passages_are_not_shuffled(spark, tmp_path, monkeypatch, crowd):
    rows = {}

    def keep(spark, frame, path, own=N.keep):
        out = own(spark, frame, path)
        rows["/".join(path.rsplit("/", 2)[1:]) if "/missed/" in path else path.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(N, "keep", keep)
    monkeypatch.setattr(N, "CROWD", crowd)
    monkeypatch.setattr(N, "fullest", lambda rows: np.zeros(0, np.int64))  # the passages' shingles do not come last
    rng = random.Random(25)
    texts = passages(rng, 200, 12) + barely(rng, 20)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id for r in N.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == kept(texts, range(len(texts)))
    assert rows["missed/sets"] <= 40, rows
    assert rows["missed/links"] > 1000 if crowd > 200 else rows["missed/links"] <= 40, "in crowded buckets no pair arises that sketches rule out"
    assert rows["merged"] < rows["met"] / 3, "shingles that the same sets have are one bucket"


def test_common_shingles_are_told_from_rare_ones_however_many_there_are(monkeypatch):
    monkeypatch.setattr(N, "SLOTS", 64)  # each has far more rare shingles than any common one has sets
    rng = random.Random(26)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(200)) for _ in range(300)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{x} {passage}" if i % 10 == 0 else x for i, x in enumerate(texts)]
    for counted in (N.COUNTED, 7000):
        monkeypatch.setattr(N, "COUNTED", counted)
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["__text"])
        found = [dict(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)) for x in N._counted(iter([batch]))]
        want = {int(x) for x in N.shingles(passage.encode()).view(np.int64)}
        assert set().union(*found) == want
        assert all(sum(x.get(h, 0) for x in found) in ((30,) if counted > 7000 else range(3, 31)) for h in want)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.drop_near_copies(spark, empty).count() == 0
