"""Batch BPE and chunk reuse against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm.bpe import BatchEncoder
from tidelog.llm.chunked_bpe import ChunkEncoder, decode_ids, digest_round_trip, encode_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", " ", "  ", "\n", "\t", "\r\n", "a", "bc", "É", "1", "23", "²", "½", "!", "?!", "\xa0", "　", "\x85", "\x1c", "\x0b", "​", "᠎", "日本", "🎉", "é", "́", "'S", " 's", "<|endoftext|>", "\0", "ß", "١", "Ⅷ", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, number, length):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, length))) for _ in range(number)]


def prose(seed, number):
    rng = random.Random(seed)
    words = ["the", "thand", "ertion", "é", "über", "it's", "42", "x" * 40, "ingly,", "end."]
    shared = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(4)]
    return [" ".join([*(rng.choice(words) for _ in range(rng.randint(0, 100))), rng.choice(shared), *(rng.choice(words) for _ in range(50))]) for _ in range(number)]


@pytest.mark.parametrize("size", [14, 200])
def test_batch_encoder_as_library(library, size):
    own = BatchEncoder(PATH)
    some = texts(size, 2000, size)
    ids, ends = own.encode(some)
    for i, t in enumerate(some):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.decode(ids, ends) == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False).encode() for t in some]


def test_decode_of_malformed_ids(library):
    own = BatchEncoder(PATH)
    rng = random.Random(0)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 6))]
        assert own.decode(np.array(ids), np.array([0, len(ids)])) == [library.decode(ids, skip_special_tokens=False).encode()]


def thue_morse(letters, n):
    """Words whose polynomial hashes modulo 2**64 are those of their complements, whatever the base."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


TWINS = [thue_morse(x, n) for n in (1024, 2048, 4096, 8192) for x in ("ab", "ba")]


def test_words_that_share_a_hash(library):
    want = [library.encode(t, add_special_tokens=False).ids for t in TWINS]
    own = BatchEncoder(PATH)
    for texts_ in (TWINS, TWINS[::-1], [f"{t} {t[::-1]} " for t in TWINS] * 2):
        ids, ends = own.encode(texts_)
        for i, t in enumerate(texts_):
            assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
    assert own.odd, "some words did share a hash"
    raw = [t.encode() for t in TWINS]
    ends = np.r_[0, np.cumsum([len(r) for r in raw])]
    assert [x.tolist() for x in ChunkEncoder(own).encode(np.frombuffer(b"".join(raw), np.uint8), ends)] == want


def test_a_window_that_disagrees_grows(library):
    own = ChunkEncoder(BatchEncoder(PATH), 5)
    text = prose(11, 1)[0]
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.array([0, len(raw)])
    own.encode(raw, ends)
    for chunk, (ids, mark, places) in own.known.items():
        own.known[chunk] = (ids[::-1].copy() if mark else ids, mark, places)
    assert own.encode(raw, ends)[0].tolist() == library.encode(text, add_special_tokens=False).ids and own.grown


@pytest.mark.parametrize("bits", [2, 5, 9])
def test_chunks_as_library(library, bits):
    own = ChunkEncoder(BatchEncoder(PATH), bits, max_ids=4000)
    for seed in range(3):
        some = [*texts(seed, 60, 400), *prose(seed, 40), "", "w" * 5000, " " * 3000, "a b " * 2000]
        raw = [t.encode() for t in some]
        ends = np.r_[0, np.cumsum([len(r) for r in raw])]
        for t, ids in zip(some, own.encode(np.frombuffer(b"".join(raw), np.uint8), ends), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:200])
    assert own.reused and own.repaired and not own.grown


def test_op4_rows(spark, library):
    some = [*texts(5, 20, 300), *prose(5, 20), None, "", "", "long " * 100_000, *TWINS]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 7) for i, t in enumerate(some)], "doc_id long, text string, n_tokens int")
    want = []
    for i, t in enumerate(some):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i % 9 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r)[:4] for r in digest_round_trip(docs, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = decode_ids(encode_texts(docs, PATH), PATH).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(i if i % 9 else None), t or "") for i, t in enumerate(some))
    assert digest_round_trip(docs.limit(0), PATH).count() == 0
