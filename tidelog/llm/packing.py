"""Packing of token sequences: first-fit decreasing over a tournament tree, in random groups of documents.

A document's ids, with the separator behind them, fill whole sequences first; only what is left over is packed.
Documents are dealt into groups by a hash, and each group packs its remainders alone: largest first, each into
the first sequence with room, which a tournament tree over the sequences' free space finds in O(log n).
A sequence whose length is a power of two is never padded, and any other is padded to the full length; so that
little is lost, the least filled sequences of a group are taken apart at the end and their pieces, cut where
needed, fill the gaps of the others.

Defined results: a null text counts as empty (its document is the separator alone); a null doc_id stays null, and any other
keeps all its digits; repeated rows are packed as often as they occur; documents of equal sizes are taken in the order of a hash
of their places; a text of any length is encoded whole and fills as many sequences as it needs; an empty table gives
an empty result; columns beyond the two named have no effect, whatever their names. A row's group follows from its place (file and
row), so repeated rows spread over all groups and a task that is run again gives the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bpe import PIECE, encoder
from tidelog.llm.common import documents, shared_dir, slices
from tidelog.llm.exact_dedup import located

LENGTH = 1024
SEPARATOR = 0
#: Documents in a group on average.
GROUP = 4096
SEED = 20_240_601


class Tournament:
    """First bin with room for a size: a tree whose inner nodes hold the largest free space below them."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with at least `size` free, less that much from now on."""
        free, i = self.free, 1
        while i < self.leaves:
            i *= 2
            if free[i] < size:
                i += 1
        bin_ = i - self.leaves
        free[i] -= size
        i //= 2
        while i:
            top = free[2 * i] if free[2 * i] >= free[2 * i + 1] else free[2 * i + 1]
            if free[i] == top:
                break
            free[i] = top
            i //= 2
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int = LENGTH) -> np.ndarray:
    """The bin of each size (1 to capacity)."""
    order = np.argsort(-sizes, kind="stable")
    tree, bins = Tournament(max(1, len(sizes)), capacity), np.zeros(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        bins[i] = tree.take(size)
    return bins


def padding(fill: int, capacity: int = LENGTH) -> int:
    """What a sequence of this length is padded by."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill


def pack(sizes: np.ndarray, capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, bin, offset) of items of the given sizes, bins numbered from 0.

    First-fit decreasing gives every item a bin. Then the least filled bins are dissolved for as long as their
    contents fit the gaps of the others; an item may be cut for that.
    """
    if not len(sizes):
        return []
    bins = first_fit_decreasing(sizes, capacity)
    fill = np.bincount(bins, sizes).astype(np.int64)
    order = np.argsort(fill, kind="stable")
    gaps = capacity - fill
    lost, room, dissolved = 0, int(gaps.sum()), 0
    for b in order.tolist():
        if lost + fill[b] > room - gaps[b]:
            break
        lost, room, dissolved = lost + int(fill[b]), room - int(gaps[b]), dissolved + 1
    gone = np.zeros(len(fill), bool)
    gone[order[:dissolved]] = True
    number = np.cumsum(~gone) - 1
    used = np.zeros(len(fill), np.int64)
    out = []
    for i in np.flatnonzero(~gone[bins]).tolist():
        b = int(bins[i])
        out.append((i, 0, int(sizes[i]), int(number[b]), int(used[b])))
        used[b] += sizes[i]
    # Wide gaps first: fewer cuts.
    open_ = [b for b in order[dissolved:].tolist() if gaps[b]]
    at = 0
    for i in np.flatnonzero(gone[bins]).tolist():
        start = 0
        while start < sizes[i]:
            b = open_[at]
            length = int(min(sizes[i] - start, capacity - used[b]))
            out.append((i, start, length, int(number[b]), int(used[b])))
            used[b] += length
            start += length
            at += int(used[b] == capacity)
    return out


def _counted(rows: DataFrame, tokenizer: str, length: int) -> DataFrame:
    """Rows (doc_id, place, __text) to doc_id, place, doc_tokens, crcs of the whole sequences, and the remainder's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in slices(batches, "__text", PIECE):
            ids, ends = encode([x or "" for x in batch.column(2).to_pylist()])
            tokens, crcs, rests = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.append(ids[a:b], SEPARATOR).astype("<u4")
                whole = len(own) // length
                tokens.append(len(own))
                crcs.append([zlib.crc32(own[k * length : (k + 1) * length]) for k in range(whole)])
                rests.append(own[whole * length :].astype("<u2").tobytes() if own.max() < 1 << 16 else own[whole * length :].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())], names=["doc_id", "place", "doc_tokens", "crcs", "rest"]
            )

    return rows.mapInArrow(run, "doc_id long, place long, doc_tokens long, crcs array<long>, rest binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row for each piece of a document: PIECES."""
    groups = max(1, -(-docs.count() // group))
    rows = located(spark, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text")), shared_dir(spark))
    rows = rows.select("doc_id", F.xxhash64("__file", "__row", F.lit(SEED)).alias("place"), "__text")
    rows = _counted(rows, tokenizer, length).withColumn("group", F.pmod("place", F.lit(groups)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        total = np.asarray(table["doc_tokens"])
        crcs, rests = table["crcs"], table["rest"]
        whole = total // length
        left = total - whole * length
        items = np.flatnonzero(left)
        out, bins = [], 0
        for item, start, size, bin_, offset in pack(left[items], length):
            i = int(items[item])
            raw = rests[i].as_py()
            own = np.frombuffer(raw, "<u2" if len(raw) == 2 * left[i] else "<u4").astype("<u4")
            out.append((i, int(whole[i]) * length + start, size, zlib.crc32(own[start : start + size]), bin_, offset))
            bins = max(bins, bin_ + 1)
        for i in np.flatnonzero(whole).tolist():
            for k, crc in enumerate(crcs[i].as_py()):
                out.append((i, k * length, length, crc, bins, 0))
                bins += 1
        index, start, size, crc, bin_, offset = np.array(out, np.int64).reshape(-1, 6).T
        sequence = (key[0].as_py() << 32) + bin_
        columns = [table["doc_id"].take(pa.array(index)), *map(pa.array, (start, size, crc, total[index], sequence, offset))]
        return pa.table(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return rows.groupBy("group").applyInArrow(run, PIECES)


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
