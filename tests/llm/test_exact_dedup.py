"""Exact deduplication: streamed state against brute force, collisions, several micro-batches."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup as D


def table():
    rng = random.Random(5)
    texts = ["", None, "a", "A", "a ", "é", "é", "x" * 90_000, *(f"text {i}" for i in range(20))]
    rows = [(i if i % 29 else None, rng.choice(texts), "clash", i) for i in range(400)]
    return [*rows, rows[7], rows[8]]


def want(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((d, max(ids, default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(table(), "doc_id long, text string, best string, n int").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def check(found, rows):
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("batches, most", [(1, 0), (6, 100)])
def test_as_brute_force(spark, docs, batches, most):
    check(D.exact_dedup(spark, docs, batches=batches, most=most), table())


@pytest.mark.parametrize("most", [0, 100])
def test_digests_that_collide_are_told_apart_by_bytes(spark, docs, most):
    weak = lambda text: F.substring(D.sha256(text), 1, 1)
    _, found = D.resolve(spark, docs, digest=lambda t: F.when(F.length(t) > 3, F.unhex(F.lit("00"))).otherwise(weak(t)), most=most)
    rows = found.select(F.col("__id"), F.col("best.id"), F.col("n"), ((F.col("__file") == F.col("best.file")) & (F.col("__row") == F.col("best.row"))).alias("kept")).collect()
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=str) == sorted((w[:3] for w in want(table())), key=str)
    assert sum(r.kept for r in rows) == len({t or "" for _, t, *_ in table()})


@pytest.mark.parametrize("most", [0, 1000])
def test_drop_copies_keeps_columns_and_one_row_of_each(spark, docs, most):
    kept = D.drop_copies(spark, docs, most=most)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in table()})


def test_texts_without_copies_are_not_shuffled(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 50) AS text").write.parquet(str(tmp_path / "d"))
    written = []
    monkeypatch.setattr(D, "keep", lambda s, frame, path, real=D.keep: written.append((path, frame)) or real(s, frame, path))
    rows = spark.read.parquet(str(tmp_path / "d"))
    assert D.exact_dedup(spark, rows).filter("kept").count() == 2000
    check_ = next(f for p, f in written if p.endswith("collisions"))
    assert "BroadcastHashJoin" in check_._jdf.queryExecution().sparkPlan().toString()


def test_rows_not_read_from_files_and_empty_table(spark):
    rows = [(1, "x"), (2, "x"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(D.exact_dedup(spark, frame), rows)
    assert D.exact_dedup(spark, frame.limit(0)).count() == 0
