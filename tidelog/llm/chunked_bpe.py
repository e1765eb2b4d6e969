"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the text's bytes cuts it into chunks, so that passages shared by several documents give the
same chunks wherever they stand. A chunk is encoded once in each Python worker, which keeps the ids of chunks
by their bytes over all of its tasks (up to a bound, so memory does not grow with the input). Where two chunks meet,
their ids may be wrong. A window around each join, from the second last word boundary of the left chunk to the second of the
right one, is encoded again and has to agree with the chunks on the words at its two ends; if one does not,
the window grows to the whole document, which agrees with itself. No row leaves its task: there is no shuffle.

Defined results: a null text counts as empty (no ids, digests of the empty string); a null doc_id stays null; repeated rows
give repeated results; a text of any length is encoded whole, alone in its slice of a batch; an empty table gives an empty
result; columns beyond the two named have no effect, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bpe import PIECE, BatchEncoder, encoder
from tidelog.llm.common import documents, slices, utf8

#: A chunk has 2**CUT_BITS bytes on average. Its end depends on the SPAN bytes before it.
CUT_BITS = 9
SPAN = 32
#: Ids that a worker keeps (4 bytes each).
MAX_IDS = 4 << 20


def chunk_ends(data: np.ndarray, ends: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Where chunks end in the concatenated texts: at the texts' ends and at content-defined cuts between characters."""
    if not len(data):
        return ends[:0]
    gear = np.random.default_rng(SPAN).integers(0, 1 << 32, 256, dtype=np.uint32)
    # Sum of gear[byte] << age over the last SPAN bytes, by doubling.
    h = gear[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
    cut = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    for _ in range(3):
        inside = cut < len(data)
        cut = np.where(inside & (data[np.minimum(cut, len(data) - 1)] & 0xC0 == 0x80), cut + 1, cut)
    text = np.searchsorted(ends, cut, "right") - 1
    cut = cut[cut < len(data)]
    text = text[: len(cut)]
    cut = cut[cut - ends[text] >= SPAN]
    return np.unique(np.concatenate([cut, ends[1:][np.diff(ends) > 0]]))


class ChunkEncoder:
    def __init__(self, base: BatchEncoder, bits: int = CUT_BITS, max_ids: int = MAX_IDS) -> None:
        self.base, self.bits, self.max_ids = base, bits, max_ids
        self.known: OrderedDict[bytes, tuple] = OrderedDict()
        self.kept = 0
        self.encoded = self.reused = self.repaired = self.grown = 0
        self.size = base.table[2]

    def _learn(self, fresh: dict[bytes, list | None]) -> dict[bytes, tuple]:
        """Encodes new chunks: ids, and for (h1, h2, t2, t1), word boundaries in bytes, their places in the ids."""
        ids, ends = self.base.encode([c.decode() for c in fresh])
        out = {}
        for (chunk, mark), a, b in zip(fresh.items(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = ids[a:b].copy()
            places = np.searchsorted(np.cumsum(self.size[own]), mark).tolist() if mark else None
            out[chunk] = (own, mark, [p + 1 for p in places] if mark else None)
        self.encoded += len(out)
        return out

    def _keep(self, fresh: dict[bytes, tuple]) -> None:
        for key, x in fresh.items():
            self.known[key] = x
            self.kept += len(x[0])
        while self.kept > self.max_ids and self.known:
            self.kept -= len(self.known.popitem(last=False)[1][0])

    def encode(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of each text data[ends[i]:ends[i + 1]]."""
        whole = data.tobytes()
        stops = chunk_ends(data, ends, self.bits)
        starts = np.r_[0, stops[:-1]] if len(stops) else stops
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        solid = ~blank
        solid[128:] = False
        # A boundary between words whatever surrounds it: an ASCII character, then ASCII white space.
        safe = np.flatnonzero(solid[data[:-1]] & blank[data[1:]]) + 1 if len(data) > 1 else np.zeros(0, np.int64)
        low, high = np.searchsorted(safe, starts, "right"), np.searchsorted(safe, stops)
        enough = high - low >= 2
        at = np.stack([low, low + 1, high - 2, high - 1])
        marks = (safe[np.clip(at, 0, max(0, len(safe) - 1))] - starts if len(safe) else np.zeros_like(at)).T.tolist()

        keys, fresh = [], OrderedDict()
        found: dict[bytes, tuple] = {}
        for a, b, ok, mark in zip(starts.tolist(), stops.tolist(), enough.tolist(), marks, strict=True):
            chunk = whole[a:b]
            keys.append(chunk)
            if chunk in found or chunk in fresh:
                self.reused += 1
            elif chunk in self.known:
                self.known.move_to_end(chunk)
                found[chunk] = self.known[chunk]
                self.reused += 1
            else:
                fresh[chunk] = mark if ok else None
        learned = self._learn(fresh) if fresh else {}
        found.update(learned)
        self._keep(learned)

        # Per text its parts: slices of chunks' ids, and windows (number, first and last chunk, or None at a text's limit).
        first = np.searchsorted(stops, ends[:-1], "right").tolist()
        last = np.searchsorted(stops, ends[1:], "right").tolist()
        starts, stops = starts.tolist(), stops.tolist()
        windows: list[str] = []
        plans = []
        for i, j in zip(first, last, strict=True):
            if j - i <= 1:
                plans.append([(i, j)] if i < j else [])
                continue
            # Chunks with two word boundaries at least stand by themselves; all others belong to windows.
            firm = [k for k in range(i, j) if found[keys[k]][1]]
            plan, left = [], None
            for right in [*firm, None]:
                if left is None and right == i:
                    plan.append((None, right, None))
                else:
                    a = starts[i] if left is None else starts[left] + found[keys[left]][1][2]
                    b = stops[j - 1] if right is None else starts[right] + found[keys[right]][1][1]
                    if left is not None and left == j - 1:
                        plan.append((left, None, None))
                    else:
                        plan.append((left, right, len(windows)))
                        windows.append(whole[a:b].decode())
                left = right
            plans.append((i, j, plan))
        wids, wends = self.base.encode(windows)
        self.repaired += len(windows)
        out = []
        for text, plan in enumerate(plans):
            if isinstance(plan, tuple):
                own = self._join(keys, found, plan[2], wids, wends)
                if own is None:
                    self.grown += 1
                    own = self.base.encode([whole[ends[text] : ends[text + 1]].decode()])[0]
                out.append(own)
            else:
                out.append(found[keys[plan[0][0]]][0] if plan else np.zeros(0, np.int32))
        return out

    def _join(self, keys: list[bytes], found: dict[bytes, tuple], plan: list[tuple], wids: np.ndarray, wends: np.ndarray) -> np.ndarray | None:
        """The ids of a text from its windows and chunks; None where a window does not agree with its chunks."""
        parts, begin = [], 0
        for left, right, number in plan:
            if number is None:
                if left is not None:
                    parts.append(found[keys[left]][0][begin:])
                begin = 0
                continue
            own = wids[wends[number] : wends[number + 1]]
            a, b = 0, len(own)
            if left is not None:
                ids, _, (_, _, t2, t1) = found[keys[left]]
                a = t1 - t2
                if not np.array_equal(own[:a], ids[t2:t1]):
                    return None
                parts.append(ids[begin:t1])
            if right is not None:
                ids, _, (h1, h2, _, _) = found[keys[right]]
                b -= h2 - h1
                if not np.array_equal(own[b:], ids[h1:h2]):
                    return None
                begin = h1
            if b < a:
                return None
            parts.append(own[a:b])
        return np.concatenate(parts)


_chunkers: dict[str, ChunkEncoder] = {}


def chunker(path: str) -> ChunkEncoder:
    """This worker's chunk encoder for a tokenizer file."""
    if path not in _chunkers:
        _chunkers[path] = ChunkEncoder(encoder(path))
    return _chunkers[path]


def encode_texts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunker(tokenizer).encode
        for batch in slices(batches, "__text", PIECE):
            ids = encode(*utf8(batch.column(1)))
            size = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(size), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(tokenizer).decode
        for batch in batches:
            lists = batch.column(1)
            ends = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))]
            texts = decode(np.asarray(lists.flatten()), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks: encoding and decoding in one pass, digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, decode = chunker(tokenizer), encoder(tokenizer).decode
        for batch in slices(batches, "__text", PIECE):
            data, limits = utf8(batch.column(1))
            ids = chunks.encode(data, limits)
            ends = np.r_[0, np.cumsum([len(x) for x in ids])]
            texts = decode(np.concatenate(ids), ends)
            stops = chunk_ends(data, limits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                    pa.array(np.diff(np.searchsorted(stops, limits, "right")), pa.int64()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_round_trip(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
