"""Removal of repeated 100-byte strings by interval expansion on a Burrows-Wheeler transform.

1. Every 100-byte window of a text has an anchor, its least GRAM-byte string by hash (the leftmost of equal ones), so equal
   windows have equal anchors. Successive windows with one anchor form a segment. Equal segments, told by a 128-bit digest of their
   bytes, are combined within each task; all but the first of them are repeats whatever else there is. What is left is
   dealt out by anchor.
2. For each anchor, equal segments are combined again. Anchors with one distinct segment are done. The distinct segments of the
   others are fetched from their texts as strings. An anchor with very many distinct segments (a passage that much of the corpus
   quotes, each time in other surroundings) would be too much for one task: it is not gathered, but its segments are dealt out by
   two anchors, their windows' least and second least GRAM-byte strings, which equal windows share as well. Equal strings
   among these are combined by their bytes.
3. The strings of an anchor are taken together, a bounded piece of whole anchors at a time; an anchor beyond that is split by the next
   least GRAM-byte string. The suffixes of a piece are sorted, the transform is taken, and the expansion starts from the intervals of
   suffixes that share START symbols. Breadth first, each interval is extended backwards by every symbol
   before its suffixes; the intervals of the next length are those with two suffixes at least. This stops at
   LENGTH: each interval then is a string that occurs more than once, and all its places but the first are repeats.
4. The repeats of a text, as ranges, meet the text again and are cut out.

All tables between the steps are written to the shared folder. A document's texts and ranges are the largest things a row holds. There are as
many buckets as the texts have PART bytes, so what a task holds does not grow with the input.

Defined results: a null text counts as empty; documents of one doc_id are ordered by file and row, a null doc_id comes
first; repeated rows are documents of their own, all but the first of which go but for what is shorter than LENGTH; a text of any length is
read whole, in blocks that overlap by a window less one byte; an empty table gives an empty result; columns beyond the two
named have no effect, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bpe import powers
from tidelog.llm.common import documents, keep, ragged, release, shared_dir, slices, trim, utf8
from tidelog.llm.exact_dedup import located

LENGTH = 100
GRAM = 32
#: Bits of the keys that order strings within a block of text, and a block's bytes.
PLACE_BITS = 24
BLOCK = 1 << 21
#: Segments that a task holds before it combines and emits them.
FLUSH = 1_000_000
#: Symbols packed into the first sort key; doubling leads from there past LENGTH.
PACKED = 7
START = 28
#: Bytes of text for each bucket.
PART = 8 << 20
#: Distinct segments of an anchor, among those a task holds at once or in its bucket, from which it is dealt out by two anchors.
CROWDED = 256
#: Bytes of strings that go through one transform; beyond them an anchor is split, by up to so many least strings.
PIECE = 3 << 18
MAX_DEPTH = 12


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of each string of `size` bytes. It only orders strings; whether they are equal is never told by it."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    gear = np.random.default_rng(size).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(gear[data] * up[: len(data)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values, from running minima of blocks in both directions."""
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, digest (two words), first window, windows of each segment of the texts in `data` (at most 2 * BLOCK bytes)."""
    if len(data) < LENGTH:
        return (*(np.zeros(0, np.uint64),) * 3, *(np.zeros(0, np.int64),) * 2)
    h = _hashes(data, GRAM)
    place = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (_slide((h & ~place) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & place).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    begin, stop = ends[:-1], ends[1:] - LENGTH + 1
    long = stop > begin
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, stop[long], -1)
    valid = np.cumsum(edge[: len(anchor)]) > 0
    change = np.ones(len(anchor), bool)
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    change[1:] |= valid[1:] != valid[:-1]
    change[begin[long]] = True
    at = np.flatnonzero(change)
    size = np.diff(np.r_[at, len(anchor)])
    real = valid[at]
    at, size = at[real], size[real]
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    own = b"".join([digest(raw[x:y]) for x, y in zip(at.tolist(), (at + size + (LENGTH - 1)).tolist(), strict=True)])
    high, low = np.frombuffer(own, np.uint64).reshape(-1, 2).T
    return h[anchor[at]], high, low, at, size


def finer(data: np.ndarray, start: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Runs of windows [start, stop) of `data` by the `depth` least strings of each window: a key for these, first window, windows, and the
    number of the run it is part of. Equal windows have equal keys."""
    h = _hashes(data, GRAM)
    ranks = h >> np.uint64(PLACE_BITS)
    width = LENGTH - GRAM + 1
    spread = np.lib.stride_tricks.sliding_window_view(ranks, width) if len(ranks) >= width else np.zeros((0, width), np.uint64)
    place = ragged(start, stop - start)
    run = np.repeat(np.arange(len(start)), stop - start)
    key, least = np.zeros(len(place), np.uint64), np.zeros((depth, len(place)), np.int64)
    for i in range(0, len(place), 1 << 13):
        some = spread[place[i : i + (1 << 13)]]
        rows = np.arange(len(some))
        mixed = np.zeros(len(some), np.uint64)
        for k in range(depth):
            found = some.argmin(axis=1)
            least[k, i : i + len(some)] = place[i : i + (1 << 13)] + found
            mixed = (mixed ^ ranks[place[i : i + (1 << 13)] + found]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            some[rows, found] = np.iinfo(np.uint64).max
        key[i : i + len(some)] = mixed
    new = np.ones(len(place), bool)
    new[1:] = (run[1:] != run[:-1]) | (least[:, 1:] != least[:, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return key[at], place[at], np.diff(np.r_[at, len(place)]), run[at]


def merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges [start, stop) by key, overlapping and touching ones joined."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    first = np.r_[True, key[1:] != key[:-1]]
    # Running maximum of the stops within each key.
    group = np.cumsum(first) - 1
    lift = group * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift) - lift
    new = first.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return key[at], start[at], reach[np.r_[at[1:], len(key)] - 1]


#: Anchor, digest (two words), key, first window, windows.
KINDS = ("<u8", "<u8", "<u8", "<i8", "<u4", "u1")
ROW = sum(int(k[-1]) for k in KINDS)


def _pack(columns: tuple[np.ndarray, ...]) -> bytes:
    return b"".join(x.astype(k).tobytes() for x, k in zip(columns, KINDS, strict=True))


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n, out, at = len(raw) // ROW, [], 0
    for kind in KINDS:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * int(kind[-1])
    return tuple(out)


def _combine(columns: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The first of each equal segments, sorted by anchor, and the ranges of windows of the others."""
    high, key, start, size = columns[1], *columns[3:]
    order = np.lexsort((start, key, high, columns[0]))
    columns = tuple(x[order] for x in columns)
    anchor, high, low, key, start, size = columns
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    rest = ~first
    start = start.astype(np.int64)
    return tuple(x[first] for x in columns), merged(key[rest], start[rest], start[rest] + size[rest])


def _times(anchor: np.ndarray) -> np.ndarray:
    """How often each element's value occurs in a sorted array."""
    change = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
    times = np.diff(np.r_[change, len(anchor)])
    return np.repeat(times, times)


#: What _scan gives by bucket: segments, ranges of repeats, crowded anchors, and their segments.
SEGMENTS, RANGES, MARKS, LOOSE = range(4)


def _scan(parts: int):
    """Texts (key, text) to rows (bucket, kind, blob): packed segments by anchor, ranges of repeats found here, marks of crowded
    anchors and the ranges of their segments."""

    def rows(kind: int, bucket: np.ndarray, pack) -> Iterator[tuple[int, int, bytes]]:
        order = np.argsort(bucket, kind="stable")
        limits = np.searchsorted(bucket[order], np.arange(parts + 1))
        for b in np.flatnonzero(np.diff(limits)).tolist():
            yield b, kind, pack(order[limits[b] : limits[b + 1]])

    def emit(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        first, repeats = _combine(tuple(map(np.concatenate, zip(*held, strict=True))))
        crowded = _times(first[0]) >= CROWDED
        by = (first[0] % np.uint64(parts)).astype(np.int64)
        plain = np.flatnonzero(~crowded)
        found = list(rows(SEGMENTS, by[plain], lambda i: _pack(tuple(x[plain[i]] for x in first))))
        if crowded.any():
            marks = np.unique(first[0][crowded])
            found += rows(MARKS, (marks % np.uint64(parts)).astype(np.int64), lambda i: marks[i].tobytes())
            start = first[4][crowded].astype(np.int64)
            loose = merged(first[3][crowded], start, start + first[5][crowded])
            found += rows(LOOSE, loose[0] % parts, lambda i: np.stack([x[i] for x in loose]).astype("<i8").tobytes())
        if len(repeats[0]):
            found.append((int(repeats[0][0]) % parts, RANGES, np.stack(repeats).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in slices(batches, "__text", BLOCK):
            data, ends = utf8(batch.column(1))
            keys = np.asarray(batch.column(0))
            # A text beyond a block is taken in blocks that overlap by a window less one byte.
            for low in range(0, max(1, len(data)), BLOCK) if len(keys) == 1 else (0,):
                part = data[low : low + BLOCK + LENGTH - 1] if len(keys) == 1 else data
                limits = np.array([0, len(part)]) if len(keys) == 1 else ends
                anchor, high, digest, at, size = segments(part, limits)
                text = np.searchsorted(limits, at, "right") - 1
                held.append((anchor, high, digest, keys[text], at - limits[text] + low, size.astype(np.uint8)))
                count += len(anchor)
                if count >= FLUSH:
                    yield from emit(held)
                    held, count = [], 0
        if count:
            yield from emit(held)

    return run


#: What _resolve gives: ranges of repeats, segments to compare as strings, and segments to deal out by two anchors.
REPEATS, STRINGS, APART = range(3)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some buckets, bucket by bucket, to (kind, anchor, key, start, stop)."""

    def out(held: list, ranges: list, loose: list, marks: list) -> Iterator[pa.RecordBatch]:
        parts = []
        if held:
            first, found = _combine(tuple(map(np.concatenate, zip(*held, strict=True))))
            ranges.append(np.stack(found))
            times = _times(first[0])
            apart = times >= CROWDED
            if marks:
                apart |= np.isin(first[0], np.concatenate(marks))
            for kind, some in ((STRINGS, (times > 1) & ~apart), (APART, apart)):
                anchor, _, _, key, start, size = (x[some] for x in first)
                start = start.astype(np.int64)
                parts.append((kind, anchor.view(np.int64), key, start, start + size))
        for kind, some in ((APART, loose), (REPEATS, ranges)):
            key, start, stop = merged(*np.concatenate([*some, np.zeros((3, 0), np.int64)], axis=1))
            parts.append((kind, np.zeros(len(key), np.int64), key, start, stop))
        for kind, *columns in parts:
            for i in range(0, len(columns[0]), 1 << 16):
                some = [x[i : i + (1 << 16)] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), kind, np.int32)), *map(pa.array, some)], names=["kind", "anchor", "key", "start", "stop"])

    bucket, own = None, ([], [], [], [])
    for batch in batches:
        for b, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != bucket:
                yield from out(*own)
                bucket, own = b, ([], [], [], [])
            raw = blob.as_buffer()
            if kind == SEGMENTS:
                own[0].append(_unpack(raw))
            elif kind == MARKS:
                own[3].append(np.frombuffer(raw, "<u8"))
            else:
                own[1 if kind == RANGES else 2].append(np.frombuffer(raw, "<i8").reshape(3, -1))
    yield from out(*own)
    trim()


def repeated(texts: np.ndarray, ends: np.ndarray, length: int = LENGTH, start: int = START) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal strings of `length` symbols in the concatenated texts: a number for each place, and the place.

    Only strings with two places at least are given. `start` must be PACKED doubled some times, and at most `length`.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(texts):
        return none
    # Symbol 0 ends each text.
    n = len(texts) + len(ends) - 1
    symbol = np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    symbol[np.arange(len(texts)) + text] = texts.astype(np.int64) + 1
    rank = np.zeros(n, np.int64)
    for k in range(PACKED):
        rank <<= 9
        rank[: n - k] |= symbol[k:]
    width = PACKED
    at_start = None
    while True:
        order = np.argsort(rank, kind="quicksort")
        sorted_ = rank[order]
        step = np.r_[False, sorted_[1:] != sorted_[:-1]]
        if width == start:
            at_start = rank
        if width >= length:
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if width == start:
            at_start = rank
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank = rank * (n + 1) + after
        width *= 2
    before = symbol[order - 1]
    before[order == 0] = 0
    next_ = np.empty(n, np.int64)
    next_[np.argsort(before.astype(np.uint16), kind="stable")] = np.arange(n)
    run = np.cumsum(np.r_[False, before[1:] != before[:-1]])
    # Intervals of suffixes that share `start` symbols; those that reach a text's end can't grow to `length`.
    shared = at_start[order]
    low = np.flatnonzero(np.r_[True, shared[1:] != shared[:-1]])
    size = np.diff(np.r_[low, n])
    stop = np.flatnonzero(symbol == 0)
    room = stop[np.searchsorted(stop, order[low])] - order[low]
    keep_ = (size > 1) & (room >= start)
    low, size = low[keep_], size[keep_]
    for _ in range(length - start):
        whole = run[low] == run[low + size - 1]
        a, b = low[whole], size[whole]
        go = before[a] != 0
        a, b = next_[a[go]], b[go]
        c, d = low[~whole], size[~whole]
        if len(c):
            at = ragged(c, d)
            by = np.repeat(np.arange(len(c)), d) * 512 + before[at]
            inner = np.argsort(by, kind="stable")
            by, at = by[inner], at[inner]
            first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            count = np.diff(np.r_[first, len(by)])
            good = (count > 1) & (by[first] % 512 != 0)
            a, b = np.r_[a, next_[at[first[good]]]], np.r_[b, count[good]]
        low, size = a, b
    place = order[ragged(low, size)]
    place = place - np.searchsorted(stop, place)
    return np.repeat(np.arange(len(low)), size), place


def _strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of runs of windows, one after the other, and their limits."""
    long = size + (LENGTH - 1)
    return data[ragged(start, long)], np.r_[0, np.cumsum(long)]


def _later(key: np.ndarray, start: np.ndarray, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of the windows in strings (of text `key`, from its window `start` on) that occur earlier in these strings."""
    group, place = repeated(data, ends)
    text = np.searchsorted(ends, place, "right") - 1
    where = start[text] + place - ends[text]
    order = np.lexsort((where, key[text], group))
    rest = order[np.r_[False, group[order][1:] == group[order][:-1]]] if len(order) else order
    return merged(key[text[rest]], where[rest], where[rest] + 1)


def _pieces(anchor: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Successive strings, sorted by anchor, in runs of whole anchors and of up to `most` bytes, unless one anchor has more."""
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(ends[edge], ends[edge[i]] + most, "right")) - 1)
        yield int(edge[i]), int(edge[j])
        i = j


def _compared(anchor: np.ndarray, key: np.ndarray, start: np.ndarray, data: np.ndarray, ends: np.ndarray, depth: int = 3) -> Iterator[tuple[np.ndarray, ...]]:
    """The ranges of repeats in strings sorted by anchor, from pieces of bounded size. `depth`: of a larger anchor's next split."""
    for a, b in _pieces(anchor, ends, PIECE):
        if b - a == 1 or anchor[a] != anchor[b - 1] or ends[b] - ends[a] <= PIECE or depth > MAX_DEPTH:
            if b - a > 1:
                yield _later(key[a:b], start[a:b], data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            continue
        own, limits = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        sub, at, size, run = finer(own, limits[:-1], limits[1:] - (LENGTH - 1), depth)
        order = np.argsort(sub, kind="stable")
        sub, at, size, run = sub[order], at[order], size[order], run[order]
        yield from _compared(sub, key[a:b][run], start[a:b][run] + at - limits[run], *_strings(own, at, size), depth + 1)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct strings (anchor, key, start, string), sorted by anchor, to ranges of windows that occur earlier."""

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        data, ends = _bytes(table["string"].combine_chunks())
        for found in _compared(*(np.asarray(table[c]) for c in ("anchor", "key", "start")), data, ends):
            for i in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in found], names=["key", "start", "stop"])

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in slices(batches, "string", PIECE):
        anchor = np.asarray(batch.column(0))
        if not len(anchor):
            continue
        # Where an anchor begins, all before it is complete.
        edge = np.flatnonzero(np.r_[bool(held) and anchor[0] != last, anchor[1:] != anchor[:-1]])
        if len(edge) and size + batch.nbytes >= PIECE:
            cut = int(edge[-1])
            yield from out([*held, batch.slice(0, cut)])
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size, last = size + batch.nbytes, anchor[-1]
    if held:
        yield from out(held)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and each row's limits in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their segments to strings (kind, anchor, key, start, string); those of crowded anchors are split by two anchors."""

    def rows(kind: int, anchor: np.ndarray, key: np.ndarray, start: np.ndarray, data: np.ndarray, limits: np.ndarray) -> pa.RecordBatch:
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), *map(pa.array, (anchor, key, start)), strings.cast(pa.binary())], names=["kind", "anchor", "key", "start", "string"])

    for batch in slices(batches, "__text"):
        data, ends = utf8(batch.column(1))
        lists = batch.column(2)
        text = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
        kind, anchor, start, stop = (np.asarray(x) for x in lists.flatten().flatten())
        keys = np.asarray(batch.column(0))
        apart = kind == APART
        begin, upto = ends[text[apart]] + start[apart], ends[text[apart]] + stop[apart]
        # Block by block, so that the hashes of a long text take bounded memory.
        for low in range(0, len(data), BLOCK) if apart.any() else ():
            a, b = np.maximum(begin, low), np.minimum(upto, low + BLOCK)
            here = a < b
            if here.any():
                part = data[low : low + BLOCK + LENGTH - 1]
                sub, at, size, run = finer(part, a[here] - low, b[here] - low, 2)
                of = text[apart][here][run]
                yield rows(APART, sub.view(np.int64), keys[of], at + low - ends[of], *_strings(part, at, size))
        text, anchor, start, stop = (x[~apart] for x in (text, anchor, start, stop))
        yield rows(STRINGS, anchor, keys[text], start, *_strings(data, ends[text] + start, stop - start))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the ranges of windows to remove to the digest of what is left."""
    for batch in slices(batches, "__text"):
        data, ends = utf8(batch.column(1))
        lists = batch.column(2)
        rows = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(lists.value_lengths(), 0)))
        start, stop = (np.asarray(x) for x in lists.flatten().flatten()) if len(rows) else (np.zeros(0, np.int64),) * 2
        row, start, stop = merged(rows, start, stop + LENGTH - 1)
        gone = np.zeros(len(data) + 1, np.int32)
        np.add.at(gone, ends[row] + start, 1)
        np.add.at(gone, ends[row] + stop, -1)
        kept = np.cumsum(gone[:-1]) == 0
        left = data[kept].tobytes()
        limits = np.r_[0, np.cumsum(kept)][ends]
        n = np.diff(ends)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n),
                pa.array(n - np.diff(limits)),
                pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)),
                pa.array([hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _keyed(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """__key (unique, in the order of documents), doc_id, __text. Where doc_id is unique it is the key."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if twice.isEmpty():
        return rows.withColumn("__key", F.col("doc_id"))
    rows = located(spark, rows, path)
    order = rows.select("doc_id", "__file", "__row").repartitionByRange(F.col("doc_id").asc_nulls_first(), "__file", "__row")
    order = order.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__file", "__row").withColumn("__key", F.monotonically_increasing_id())
    order = keep(spark, order.select("__file", "__row", "__key"), f"{path}/order")
    return keep(spark, rows.join(order, ["__file", "__row"]).select("doc_id", "__text", "__key"), f"{path}/keyed")


def suffix_dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    path = shared_dir(spark)
    rows = _keyed(spark, docs, doc_id, text, path)
    texts = rows.select("__key", "__text")
    size = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART)
    found = texts.mapInArrow(_scan(parts), "bucket long, kind int, blob binary").repartitionById(parts, F.col("bucket").cast("int"))
    found = keep(spark, found.mapInArrow(_resolve, "kind int, anchor long, key long, start long, stop long"), f"{path}/segments")
    release(spark)
    wanted = found.filter(F.col("kind").isin(STRINGS, APART)).groupBy("key").agg(F.collect_list(F.struct("kind", "anchor", "start", "stop")).alias("list"))
    fetched = texts.join(wanted, F.col("__key") == F.col("key")).select("__key", "__text", "list").mapInArrow(_fetch, "kind int, anchor long, key long, start long, string binary")
    fetched = keep(spark, fetched, f"{path}/fetched")
    release(spark)
    # Equal strings of crowded anchors: all but the first are repeats. They are combined before they are shuffled.
    loose = fetched.filter(F.col("kind") == APART).drop("kind")
    first = loose.groupBy("anchor", "string").agg(F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("first"))
    first = keep(spark, first, f"{path}/first")
    again = loose.join(first.filter("n > 1"), ["anchor", "string"]).filter(F.struct("key", "start") != F.col("first"))
    again = again.select("key", "start", (F.col("start") + F.octet_length("string") - (LENGTH - 1)).alias("stop"))
    strings = fetched.filter(F.col("kind") == STRINGS).select("anchor", "key", "start", "string").unionByName(first.select("anchor", "first.key", "first.start", "string"))
    more = strings.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_expand, "key long, start long, stop long")
    more = keep(spark, more, f"{path}/expanded")
    ranges = found.filter(F.col("kind") == REPEATS).select("key", "start", "stop").unionByName(more).unionByName(again)
    ranges = ranges.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("list"))
    whole = rows.join(ranges, F.col("__key") == F.col("key"), "left").select("doc_id", "__text", "list")
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, documents(spark, sf_dir, "doc_id", "text"))


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
x AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM x),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
t AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM t),
r AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS z, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
