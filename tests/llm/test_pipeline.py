"""The pipeline's stages against brute force on a small corpus."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_near_copies import kept
from tests.llm.test_quality import brute as quality

sys.setrecursionlimit(10_000)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(120):
        kind = i % 6
        text = " ".join(rng.choice(words) for _ in range(rng.randint(80, 200)))
        if kind == 1 and i > 12:
            text = rows[-6][1]
        elif kind == 2 and i > 12:
            text = (rows[-6][1] or "") + " tail"
        elif kind == 3:
            text = ["too short", None, "again and again we say so " * 9][i % 3]
        elif kind == 4:
            text += f' token = "{rng.getrandbits(128):032x}"'
        rows.append((i, text, "en", f"s{i % 3}", len(text or "")))
    return rows


def test_stages_as_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left, frames = rows, []
    for number, (name, stage) in enumerate(P.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.schema(COLUMNS).parquet(str(tmp_path / str(number)))
        frames.append(sorted(map(tuple, docs.collect())))
        if number == 0:
            left = [r for r in left if not quality(r[1])[5]]
        elif number == 1:
            last = {r[1]: r[0] for r in left}
            left = [r for r in left if last[r[1]] == r[0]]
        elif number == 2:
            stay = kept([r[1] for r in left], [r[0] for r in left])
            left = [r for i, r in enumerate(left) if i in stay]
        else:
            assert all("token" not in r[1] for r in frames[-1]) and any("[secret]" in r[1] for r in frames[-1])
            assert all(r[4] == len(r[1]) for r in frames[-1])
        assert [r[0] for r in frames[-1]] == [r[0] for r in left], name
    packed = P.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text, *_ in frames[-1]:
        own = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted((r.start, r.length, r.ids_crc32) for r in packed if r.doc_id == doc)
        assert sum(p[1] for p in parts) == len(own) and all(zlib.crc32(own[a : a + n]) == c for a, n, c in parts)
    assert {r.doc_id for r in packed} == {r[0] for r in frames[-1]}


def test_nulls_repeated_rows_long_texts_and_other_columns(spark, tmp_path):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same, long, plain = prose(120), prose(60_000), prose(100)
    rows = [
        (None, same, None, None, None, "a"), (7, same, "en", "s", 1, "b"), (8, long, "en", "s", 1, None), ((1 << 60) + 1, plain, None, None, None, "c"),
        (9, None, "en", "s", 0, "d"), (10, "", "en", "s", 0, "e"), (None, prose(90), "de", None, 5, "f"), (None, None, None, None, None, None),
    ]
    rows += [rows[3], rows[6], rows[6]]
    docs = spark.createDataFrame(rows, COLUMNS + ", place string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for number, (_, stage) in enumerate(P.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.schema(COLUMNS).parquet(str(tmp_path / str(number)))
        assert docs.columns == P.COLUMNS
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(7, same), (8, long), ((1 << 60) + 1, plain), (0, rows[6][1])])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in (same, long, plain, rows[6][1]))
    packed = P.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == total and {r.doc_id for r in packed} == {None, 7, 8, (1 << 60) + 1}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
