"""Near copies at a similarity of shingle sets, by wide SimHash fingerprints in the Gray-order index and an exact check.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is SIMILARITY at least; a group is what such pairs
join. Which pairs are found does not depend on the number of texts, nor on what else is in the table: the fingerprints find most of them, and
steps 5 and 6 find all the others.

1. A fingerprint has 256 bits or more (`shape`: as many as the number of texts asks for). Texts of one set of shingles (128-bit digest) are a class.
2. Classes meet in buckets, each named by a window of a fingerprint's bits; windows start at every STRIDE bits, as in a ring. Two near copies
   agree in one window at least with a probability of 0.98 (similarity 0.8, measured at 256 bits) to 1. Large buckets are tiled.
3. In a bucket, the index (simhash.GrayIndex) finds who differs in few bits, at LEVELS of rising distance, and leaves groups of what is joined
   already. Only the links that join two parts of the bucket come out, nearest first: a forest, no pairs.
4. Each link is checked by the texts' own sets. What the links that hold join has one root.
5. All shingles have one order, the rare ones first. Two near copies share a shingle among the first fifth (and one) of each of their sets, so classes
   meet at these shingles (those that one set alone has there go first; of those that the same sets have, one is enough), and pairs of different roots go on if sizes and places in the order allow the similarity. What has one root is not compared again.
6. These pairs are checked like the links; those that hold join roots. The order sets costs alone: any order gives the same groups.

Checks go in two steps, so that few sets are shuffled. A class has a sketch, the parities of how many of its shingles fall into each of as many
slots as it has shingles or up to twice that, a 64th to a 32nd of the set. Two sets differ in a shingle at least for each slot that differs, so sketches
that differ in more slots than the similarity allows rule a pair out for sure; only the others meet by their sets.

Defined results: a null text counts as empty; words are as in simhash; a text of less than five words is one shingle, texts without a
word are copies of one another; of a group the row with the smallest doc_id stays (a null doc_id before all others), then the first by file and
row; repeated rows are one group; a text of any length is read whole; an empty table gives an empty result. All columns are kept;
names that start with two underscores are this module's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import keep, ragged, release, shared_dir, slices, trim, utf8
from tidelog.llm.components import components
from tidelog.llm.exact_dedup import BROADCAST_ROWS, located, without
from tidelog.llm.simhash import BLOCK, SEED, SMALL, TILE, GrayIndex, bits, dealt

SIZE = 5
SIMILARITY = 0.8
STRIDE = 8
#: A bucket has 2**FREE classes on average, up to 2**20 texts.
FREE = 6
#: Shares of differing bits up to which links are looked for, one after the other. Near copies at 0.8 differ in 0.15, give or take 0.02 at 256 bits.
LEVELS = (0.07, 0.11, 0.15, 0.18, 0.22)
#: Words of a fingerprint that distances are taken from.
COMPARED = 4
#: Votes are summed in bytes over so many shingles at once.
BYTE = 255
#: Shingles have so many slots in the order, a power of two; those of so many of the commonest shingles come last.
SLOTS = 1 << 22
COMMON = 1 << 19
#: Shingles are counted in runs of so many; a run tells of those that OFTEN of its sets have at least.
COUNTED = 1 << 22
OFTEN = 2
#: A shingle in a prefix: its low 40 bits, half the digest of the set, its place in the order (or 65,535). Shingles that are confused are told apart by the check.
PLACE = np.dtype([("key", "u1", 5), ("set", "<i8"), ("place", "<u2")])
#: Entries that one part of them has on average.
ENTRIES = 1 << 20
#: Pairs of a bucket that are looked at in one go.
PAIRS = 1 << 20
#: In buckets of more classes than this, pairs are compared by sketches at once; the others have at most half as many pairs for each row.
CROWD = 16
#: Bytes of sketches that are compared in one go.
COMPARED_BYTES = 4 << 20
#: Rounding of products with the similarity, on the side of looking at more.
SLACK = 1e-6


def shape(n: int) -> tuple[int, int]:
    """Bits of a window and words of a fingerprint for n texts. Wider windows keep buckets small; more windows make up for that.

    A text has a row of some 50 bytes for each window: 32 windows for up to a million texts, 64 for 2**24, 256 for 2**36. Buckets grow
    from 2**FREE texts on average to 2**11 there, which balances what is compared with what is shuffled.
    """
    size = math.log2(max(2, n))
    width = max(8, math.ceil(size - FREE - max(0.0, (size - 20) / 3)))
    return width, COMPARED << max(0, math.ceil((width - 14) / 4))


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct shingles of a text in UTF-8, as sorted 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter((digest(x, SEED) for x in parts), np.uint64))


def wide_print(hashes: np.ndarray, words: int) -> np.ndarray:
    """The majority of the hashes' bits, `words` words of them; those behind the first come from mixing the hash anew."""
    votes = np.zeros(64 * words, np.int64)
    if not len(hashes):
        return np.zeros(words, np.uint64)
    for at in range(0, len(hashes), BYTE * 64):
        some = hashes[at : at + BYTE * 64]
        mixed = some[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        full = np.zeros((-(-len(some) // BYTE) * BYTE, words), ">u8")
        full[: len(some)] = mixed
        each = np.unpackbits(full.view(np.uint8), axis=1).reshape(-1, BYTE, 64 * words)
        votes += each.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).view(">u8").astype(np.uint64)


def _hashes(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sets of the texts in the batch's last column."""
    data, ends = utf8(batch.column(batch.num_columns - 1))
    whole = data.tobytes()
    return [shingles(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _short(x: np.ndarray) -> np.ndarray:
    """The low 40 bits, as five bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _long(x: np.ndarray) -> np.ndarray:
    full = np.zeros((len(x), 8), np.uint8)
    full[:, :5] = x
    return full.view("<i8")[:, 0]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__text) to shingle, n: how many sets of a run have a shingle, where these are OFTEN at least."""
    run, filled = np.empty(COUNTED, np.uint64), 0

    def often(some: np.ndarray) -> pa.RecordBatch:
        some.sort()
        same = np.r_[False, some[1:] == some[:-1], False]
        first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        n = last - first + 1
        first, n = first[n >= OFTEN], n[n >= OFTEN]
        return pa.RecordBatch.from_arrays([pa.array(some[first].view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])

    for batch in slices(batches, "__text"):
        for own in _hashes(batch):
            # A set has a shingle once, so parts of a long one may go to different runs.
            while len(own):
                part, own = own[: COUNTED - filled], own[COUNTED - filled :]
                run[filled : filled + len(part)] = part
                filled += len(part)
                if filled == COUNTED:
                    yield often(run)
                    filled = 0
    if filled:
        yield often(run[:filled])
    trim()


def fullest(rows: DataFrame) -> np.ndarray:
    """The slots of the shingles that most sets have, the least common first."""
    counts = rows.select("__text").mapInArrow(_counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow()
    return _slot(np.array(found.column(0), np.int64).view(np.uint64))[::-1].astype(np.int32)


def prefix(hashes: np.ndarray, rank: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first of a set's shingles in the order by the rank of their slot, then hash: so many that two similar sets share one of them."""
    if not len(hashes):
        return hashes
    order = np.lexsort((hashes, rank[_slot(hashes)]))
    return hashes[order[: len(hashes) - math.ceil(least * len(hashes) - SLACK) + 1]]


def _digest(hashes: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """For each slot the parity of how many of a set's shingles are in it. Slots are a power of two, 64 or as many as shingles at least."""
    slots = 1 << max(6, (len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def may_hold(sizes: np.ndarray, ones: list[bytes], twos: list[bytes], least: float = SIMILARITY) -> np.ndarray:
    """Which pairs of sketches may be of sets whose similarity is `least` at least; sizes: how many shingles both sets have together."""
    good = np.zeros(len(sizes), bool)
    lengths = np.array([[len(x) for x in ones], [len(x) for x in twos]], np.int64).reshape(2, -1)
    for one, two in np.unique(lengths, axis=1).T.tolist():
        at = np.flatnonzero((lengths[0] == one) & (lengths[1] == two))
        words = min(one, two) // 8
        # A sketch with half the slots is one half of the wider one added to the other, without carry.
        halves = [np.bitwise_xor.reduce(np.frombuffer(b"".join([x[i] for i in at]), np.uint64).reshape(len(at), -1, words), axis=1) for x in (ones, twos)]
        good[at] = bits(halves[0] ^ halves[1]) <= (1 - least) / (1 + least) * sizes[at] + SLACK
    return good


def wide_prints(rows: DataFrame, words: int) -> DataFrame:
    """Rows (__id, __file, __row, __text) to __id, __file, __row, the words w0, w1, ... of the fingerprint, the digest d0, d1 of the set,
    its size and its sketch."""
    names = [*(f"w{k}" for k in range(words)), "d0", "d1", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found, sketches = np.empty((batch.num_rows, words + 3), np.uint64), []
            for i, own in enumerate(_hashes(batch)):
                found[i, :words], found[i, words:-1], found[i, -1] = wide_print(own, words), _digest(own), len(own)
                sketches.append(sketch(own))
            columns = [*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found.T), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[*batch.schema.names[:3], *names, "sketch"])

    schema = rows.drop("__text").withColumns({k: F.lit(0).cast("long") for k in names} | {"sketch": F.lit(b"")}).schema
    return rows.select("__id", "__file", "__row", "__text").mapInArrow(run, schema)


def windows(width: int, words: int) -> list:
    """A bucket's key for each window of `width` bits, out of the columns w0, w1, ..."""
    out = []
    for number, at in enumerate(range(0, 64 * words, STRIDE)):
        word, low = divmod(at, 64)
        value = F.shiftrightunsigned(f"w{word}", low)
        if low + width > 64:
            value = value.bitwiseOR(F.shiftleft(f"w{(word + 1) % words}", 64 - low))
        out.append(F.lit(number << 32) + value.bitwiseAND(F.lit((1 << width) - 1)))
    return out


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Labels after the links a-b, nearest first, and which of the links joined two parts."""
    apart = np.flatnonzero(label[a] != label[b])
    apart = apart[np.argsort(far[apart], kind="stable")]
    up: dict[int, int] = {}
    taken = []
    for i, x, y in zip(apart.tolist(), label[a[apart]].tolist(), label[b[apart]].tolist(), strict=True):
        while x in up:
            x = up[x]
        while y in up:
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            taken.append(i)
    if up:
        old = np.fromiter(sorted(up), np.int64, len(up))
        new = []
        for x in old.tolist():
            while x in up:
                x = up[x]
            new.append(x)
        at = np.searchsorted(old, label)
        at[at == len(old)] = 0
        label = np.where(old[at] == label, np.array(new, np.int64)[at], label)
    return label, taken


def forest(groups: np.ndarray, fps: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in `fps`) that join what lies within the last limit in each group, nearest first as the limits go."""
    index = GrayIndex(groups, fps)
    group_of = np.repeat(np.arange(len(index.first)), index.sizes)
    small = np.flatnonzero((index.sizes > 1) & (index.sizes <= SMALL))
    links = [np.zeros((2, 0), np.int64)]
    label = np.arange(len(fps))
    work = np.cumsum(index.sizes[small].astype(np.int64) ** 2)
    parts = np.split(small, np.searchsorted(work, np.arange(1 << 18, work[-1], 1 << 18))) if len(small) else []
    for part in parts:
        inside = np.flatnonzero(np.isin(group_of, part))
        if not len(inside):
            continue
        # One search gives all that any of the limits allows.
        a, b = index.search(inside, group_of[inside], limits[-1])
        once = a < b
        a, b = a[once], b[once]
        label, taken = _joined(label, a, b, bits(index.fps[a] ^ index.fps[b]))
        links.append(np.stack([a[taken], b[taken]]))
    for g in np.flatnonzero(index.sizes > SMALL):
        begin, size = index.first[g], index.sizes[g]
        own = GrayIndex(np.zeros(size, np.int8), index.fps[begin : begin + size])
        mine = np.arange(size)
        for limit in limits:
            for i in range(0, size, BLOCK):
                queries = np.arange(i, min(size, i + BLOCK))
                a, b = own.search(queries, np.zeros(len(queries), np.int64), limit, mine)
                mine, taken = _joined(mine, a, b, bits(own.fps[a] ^ own.fps[b]))
                links.append(begin + own.order[np.stack([a[taken], b[taken]])])
    a, b = index.order[np.concatenate(links, axis=1)]
    return a, b


def _buckets(batches: Iterator[pa.RecordBatch], longs: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (key, tile, ...) of longs, in order, to the rows of whole buckets, transposed, the numbers of their buckets, and what a
    column behind so many longs holds."""

    def whole(rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return rows, np.cumsum(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]), own

    rest, held = None, np.empty(0, object)
    for batch in batches:
        more = np.stack([np.asarray(x) for x in batch.columns[:longs]])
        rest = more if rest is None else np.concatenate([rest, more], axis=1)
        if longs is not None:
            own = np.empty(batch.num_rows, object)
            own[:] = batch.column(longs).to_pylist()
            held = np.concatenate([held, own])
        change = np.flatnonzero((rest[0, 1:] != rest[0, :-1]) | (rest[1, 1:] != rest[1, :-1]))
        if len(change):
            at = change[-1] + 1
            yield whole(rest[:, :at], held[:at])
            rest, held = rest[:, at:], held[at:]
    if rest is not None and rest.shape[1]:
        yield whole(rest, held)
    trim()


def _ordered(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _linker(words: int):
    limits = tuple(round(x * 64 * words) for x in LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets (key, tile, node, w0, ...), in order, to links u, v."""
        for rows, groups, _ in _buckets(batches):
            a, b = forest(groups, np.ascontiguousarray(rows[3:].T).view(np.uint64), limits)
            yield _ordered(rows[2, a], rows[2, b])

    return run


def _dealer(slots: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(__text) to part, entries: the shingles of the prefixes, dealt out by a hash of them, as PLACE."""
        rank = np.zeros(SLOTS, np.uint8)
        rank[slots] = 1 + 255 * np.arange(len(slots)) // max(1, len(slots))
        for batch in slices(batches, "__text"):
            found, owner = [], []
            for own in _hashes(batch):
                found.append(prefix(own, rank))
                owner.append(_digest(own)[0])
            counts = np.array([len(x) for x in found], np.int64)
            keys = np.concatenate(found)
            entries = np.empty(len(keys), PLACE)
            entries["key"] = _short(keys)
            entries["set"] = np.repeat(np.array(owner, np.uint64).view(np.int64), counts)
            entries["place"] = np.minimum(ragged(np.zeros(len(counts), np.int64), counts), 0xFFFF)
            part = ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
            blobs = [x.tobytes() for x in np.split(entries, first[1:])] if len(first) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "entries"])

    return run


def _shared(parts: int):
    def out(part: int, blobs: list[bytes]) -> pa.RecordBatch:
        entries = np.frombuffer(b"".join(blobs), PLACE)
        keys, owner, place = _long(entries["key"]), entries["set"].copy(), entries["place"].astype(np.int64)
        order = np.lexsort((place, owner, keys))
        keys, owner, place = keys[order], owner[order], place[order]
        # Of a set's copies, one is enough; keys of one set go.
        once = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]
        keys, owner, place = keys[once], owner[once], place[once]
        same = keys[1:] == keys[:-1]
        good = np.r_[False, same] | np.r_[same, False]
        return pa.RecordBatch.from_arrays([pa.array(keys[good] * parts + part), pa.array(owner[good]), pa.array(place[good])], names=["key", "set", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, entries), in order, to key, set, place: the entries of shingles that several sets have in their prefixes."""
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and blobs:
                    yield out(now, blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield out(now, blobs)
        trim()

    return run


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets (key, tile, node, root, size, place, sketch), in order, to the pairs u, v of different roots that may be similar."""
    for rows, groups, sketches in _buckets(batches, 6):
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        mixed = np.minimum.reduceat(rows[3], first) != np.maximum.reduceat(rows[3], first)
        inside = np.repeat(mixed, np.diff(np.r_[first, len(groups)]))
        if not inside.any():
            continue
        rows, groups, sketches = rows[2:, inside], groups[inside], sketches[inside]
        order = np.lexsort((rows[2], groups))
        (node, root, size, place), groups, sketches = rows[:, order], groups[order], sketches[order]
        crowd = np.array([x is not None for x in sketches], bool)
        widest = max((len(x) for x in sketches[crowd]), default=1)
        # Behind a row come the sets of its bucket that are as large or larger, up to the size that the similarity allows.
        most = np.floor(size / SIMILARITY + SLACK).astype(np.int64)
        number = np.cumsum(np.r_[False, groups[1:] != groups[:-1]])
        scale = int(max(size.max(), most.max())) + 1
        count = np.searchsorted(number * scale + size, number * scale + most, "right") - np.arange(len(size)) - 1
        ends = np.cumsum(count)
        start = 0
        while start < len(size):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(start, stop), count[start:stop])
            b = ragged(np.arange(start + 1, stop + 1), count[start:stop])
            # At the first shingle that two sets share, all they share is yet to come in both.
            left = np.minimum(size[a] - place[a], size[b] - place[b])
            good = (root[a] != root[b]) & (left >= SIMILARITY / (1 + SIMILARITY) * (size[a] + size[b]) - SLACK)
            at = np.flatnonzero(good & crowd[a])
            step = max(1, COMPARED_BYTES // widest)
            for some in np.split(at, np.arange(step, len(at), step)):
                good[some] = may_hold(size[a[some]] + size[b[some]], sketches[a[some]].tolist(), sketches[b[some]].tolist())
            pairs = np.unique(np.sort(np.stack([node[a[good]], node[b[good]]]), axis=0), axis=1)
            if pairs.shape[1]:
                yield _ordered(*pairs)
            start = stop


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, __text) to (node, shingles)."""
    for batch in slices(batches, "__text"):
        data, ends = utf8(batch.column(1))
        whole = data.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(whole[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], names=["node", "shingles"])


def similar(one: np.ndarray, two: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets is `least` at least. Empty sets are equal."""
    if not len(one) or not len(two):
        return len(one) == len(two)
    if min(len(one), len(two)) < least * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= least * (len(one) + len(two) - both)


def _may_hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v, size, one, two), size of both sets together, the last two being sketches, to those that may hold."""
    for batch in batches:
        good = may_hold(np.asarray(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist())
        yield batch.select([0, 1]).take(pa.array(np.flatnonzero(good), pa.int64()))


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v, one, two), the last two being sets, to those that hold."""
    for batch in batches:
        one, two = batch.column(2), batch.column(3)
        good = [i for i in range(batch.num_rows) if similar(np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(two[i].as_buffer(), np.uint64))]
        yield batch.select([0, 1]).take(pa.array(good, pa.int64()))


def holding(spark: SparkSession, rows: DataFrame, classes: DataFrame, found: DataFrame, path: str, most: int) -> DataFrame:
    """Those of the links `found` (u, v) whose texts are similar."""
    found = keep(spark, found.distinct(), f"{path}/links")
    one = classes.select(F.col("node").alias("u"), F.col("size").alias("size_u"), F.col("sketch").alias("one"))
    two = classes.select(F.col("node").alias("v"), F.col("size").alias("size_v"), F.col("sketch").alias("two"))
    sketched = found.join(one, "u").join(two, "v").select("u", "v", (F.col("size_u") + F.col("size_v")).alias("size"), "one", "two")
    found = keep(spark, sketched.mapInArrow(_may_hold, "u long, v long"), f"{path}/likely")
    # The texts' sets of both ends of each link.
    ends = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    places = keep(spark, classes.join(ends, "node").select("node", "first.__file", "first.__row"), f"{path}/ends")
    texts = rows.join(F.broadcast(places) if places.count() <= most else places, ["__file", "__row"])
    sets = keep(spark, texts.select("node", "__text").mapInArrow(_sets, "node long, shingles binary"), f"{path}/sets")
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("two"))
    checked = found.join(one, "u").join(two, "v").select("u", "v", "one", "two").mapInArrow(_hold, "u long, v long")
    return keep(spark, checked, f"{path}/checked")


def possible(spark: SparkSession, rows: DataFrame, rooted: DataFrame, sketches: DataFrame, path: str, tile: int) -> DataFrame:
    """All pairs (u, v) of classes with different roots that may be similar, by the prefixes of their sets."""
    parts = max(16, math.ceil((1 - SIMILARITY) * (rooted.agg(F.sum("size")).first()[0] or 0) / ENTRIES))
    dealt_out = rows.select("__text").mapInArrow(_dealer(fullest(rows), parts), "part long, entries binary")
    shared = dealt_out.repartition("part").sortWithinPartitions("part").mapInArrow(_shared(parts), "key long, set long, place long")
    shared = keep(spark, shared, f"{path}/shared")
    owner = rooted.select(F.col("d0").alias("set"), "node", "root", "size")
    met = keep(spark, shared.join(owner, "set").select("key", "node", "root", "size", "place"), f"{path}/met")
    # Keys with a single root have nothing to compare. Of keys that the same classes have (128-bit digest), as in a passage that they share, one
    # stands for all, with a class's first place among them: where two sets share it, all they share is yet to come.
    nodes = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    mixed = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *nodes).filter("low <> high")
    first = F.min("key").over(Window.partitionBy("n", "x0", "x1"))
    mixed = keep(spark, mixed.select("key", first.alias("first"), (F.col("n") > CROWD).alias("crowd")), f"{path}/mixed")
    each = [F.any_value(c).alias(c) for c in ("root", "size", "crowd")]
    met = met.join(mixed, "key").groupBy(F.col("first").alias("key"), "node").agg(F.min("place").alias("place"), *each)
    met = keep(spark, met, f"{path}/merged")
    # Only rows of crowded keys get their sketch.
    few = met.filter("not crowd").withColumn("sketch", F.lit(None).cast("binary"))
    many = met.filter("crowd").join(sketches, "node")
    met = dealt(spark, few.unionByName(keep(spark, many, f"{path}/crowded")), "node", tile)
    return met.select("key", "tile", "node", "root", "size", "place", "sketch").mapInArrow(_possible, "u long, v long")


def _near(spark: SparkSession, rows: DataFrame, classes: DataFrame, width: int, words: int, path: str, tile: int, most: int) -> DataFrame:
    """The classes with the root of what the fingerprints find."""
    # All words make windows; the first ones are enough to compare by, so that a row does not grow with the number of windows.
    columns = [f"w{k}" for k in range(COMPARED)]
    keyed = classes.select(F.explode(F.array(*windows(width, words))).alias("key"), "node", *columns)
    found = dealt(spark, keyed, "node", tile).select("key", "tile", "node", *columns).mapInArrow(_linker(COMPARED), "u long, v long")
    stars = components(spark, holding(spark, rows, classes, found, f"{path}/near", most), f"{path}/components")
    rooted = classes.join(stars, "node", "left").select("node", "d0", "d1", "n", "size", "first", F.coalesce("root", "node").alias("root"))
    return keep(spark, rooted, f"{path}/rooted")


def near_copies(spark: SparkSession, rows: DataFrame, path: str, tile: int = TILE, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (__id, __file, __row, __text) to the places (__file, __row) of those that go."""
    width, words = shape(rows.count())
    columns = [f"w{k}" for k in range(words)]
    prints = keep(spark, wide_prints(rows, words), f"{path}/prints")
    each = [F.any_value(w).alias(w) for w in (*columns, "size", "sketch")]  # equal sets have equal fingerprints
    classes = prints.groupBy("d0", "d1").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__file", "__row")).alias("first"), *each)
    # The numbers are read back from the table, so they are the same whoever asks.
    classes = keep(spark, classes.withColumn("node", F.monotonically_increasing_id()), f"{path}/classes")
    rooted = _near(spark, rows, classes, width, words, path, tile, most)
    release(spark)

    # What the fingerprints have missed, as links of roots.
    missed = holding(spark, rows, classes, possible(spark, rows, rooted, classes.select("node", "sketch"), path, tile), f"{path}/missed", most)
    root = rooted.select("node", "root")
    missed = missed.join(root.toDF("u", "one"), "u").join(root.toDF("v", "two"), "v").select(F.col("one").alias("u"), F.col("two").alias("v"))
    joined = components(spark, missed, f"{path}/joined").toDF("root", "all")
    rooted = rooted.join(joined, "root", "left").withColumn("root", F.coalesce("all", "root"))

    # Only classes of several rows or in a component can have rows that go.
    groups = rooted.groupBy("root").agg(F.min("first").alias("stay"), F.sum("n").alias("all")).filter(F.col("all") > 1).select("root", "stay")
    busy = keep(spark, rooted.select("d0", "d1", "root").join(groups, "root").select("d0", "d1", "stay"), f"{path}/busy")
    member = prints.select("d0", "d1", "__file", "__row").join(busy, ["d0", "d1"])
    return member.filter((F.col("__file") != F.col("stay.__file")) | (F.col("__row") != F.col("stay.__row"))).select("__file", "__row")


def drop_near_copies(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE, most: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` with one row of each group of near copies."""
    path, names = shared_dir(spark), docs.columns
    rows = located(spark, docs, path)
    bare = rows.select(F.col(doc_id).alias("__id"), "__file", "__row", F.col(text).cast("string").alias("__text"))
    out = without(spark, rows, near_copies(spark, bare, path, tile, most), most)
    if "_metadata" in names:
        out = out.withColumnRenamed("__own_metadata", "_metadata")
    return out.select(*names)
