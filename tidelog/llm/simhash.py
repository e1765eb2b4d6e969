"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

1. A document's fingerprint is the majority vote of the bits of its shingles' XXH64 values.
2. Equal fingerprints become one class. Classes that may link meet in buckets: of five blocks of bits, two
   fingerprints that differ in at most three bits agree in two at least, so each class goes to the ten buckets
   named by two blocks and their bits. For very many classes there are more blocks (three of six agree, and so on), so that buckets
   stay small. Buckets with more than TILE classes are split into tiles, every two parts of the bucket meeting in one tile, so
   that no task gets an unbounded bucket.
3. Within its bucket a class is searched for in the index: fingerprints sorted by Gray rank, so that
   neighbours share most bits; groups of FAN neighbours get a node which holds the bits that all below it
   share and that no node above holds. A search adds up differences from the root down and leaves a whole
   group as soon as their sum exceeds the limit, or when all of it is linked to the class already.
4. Each bucket gives a star for each of its components, never all pairs; the stars' components are joined.

Defined results: null text counts as empty; a text without a word has the fingerprint zero; null doc_ids are
left out of the smallest doc_id of a component unless it has no other; repeated rows are one class; a text of any length
is read whole, its shingles' votes being counted in blocks; an empty table gives an empty result; columns beyond the two
named have no effect, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, keep, shared_dir, slices, utf8
from tidelog.llm.components import components
from tidelog.llm.exact_dedup import located, without

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Blocks of a fingerprint. Of so many, all but MAX_BITS agree in two fingerprints that link. More blocks make narrower buckets and more of them.
BLOCKS = 5
FAN = 16
TILE = 4096
#: Groups up to this size are searched together, larger ones in blocks of queries.
SMALL = 256
BLOCK = 64
#: Keys of buckets to be tiled are broadcast up to this number (16 bytes each).
BROADCAST_KEYS = 100_000
#: Texts of a task whose fingerprints are remembered, so that copies are computed once.
REMEMBERED = 50_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text in UTF-8."""
    words = text.lower().split()  # of bytes: A-Z only, and 0x20, 0x09-0x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    hashes = np.fromiter((digest(x, SEED) for x in shingles), np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str, carried: dict[str, Column], size: int = SHINGLE) -> DataFrame:
    """The carried columns and `fp`, the fingerprint as a signed long."""
    rows = docs.select(*[c.alias(k) for k, c in carried.items()], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, "__text"):
            data, ends = utf8(batch.column(batch.num_columns - 1))
            whole, found = data.tobytes(), np.empty(batch.num_rows, np.uint64)
            for i in range(batch.num_rows):
                body = whole[ends[i] : ends[i + 1]]
                key = xxhash.xxh3_128_digest(body)
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = fingerprint(body, size)
                found[i] = known[key]
            columns = [*batch.columns[:-1], pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "fp"])

    schema = rows.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, schema)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray code."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(groups: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """The order by group and Gray rank. Fingerprints of several words, the first one highest, have a row each."""
    if fps.ndim == 1:
        return np.lexsort((gray_rank(fps), groups))
    ranks, odd = [], np.zeros(len(fps), bool)
    for word in fps.T:
        # After an odd number of bits the code runs backwards.
        ranks.append(gray_rank(word) ^ np.where(odd, ~np.uint64(0), np.uint64(0)))
        odd ^= np.bitwise_count(word) % 2 == 1
    return np.lexsort((*reversed(ranks), groups))


def bits(x: np.ndarray) -> np.ndarray:
    """How many bits are set in each fingerprint."""
    count = np.bitwise_count(x)
    return count if x.ndim == 1 else count.sum(axis=1, dtype=np.int64)


class GrayIndex:
    """The hierarchical index over fingerprints of one word or several; every group (bucket) has a root of its own."""

    def __init__(self, groups: np.ndarray, fps: np.ndarray) -> None:
        self.order = gray_order(groups, fps)
        self.fps = fps[self.order]
        groups = groups[self.order]
        n = len(fps)
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        self.first, self.sizes = first, np.diff(np.r_[first, n])
        inside = np.arange(n) - np.repeat(first, self.sizes)
        self.starts = [np.arange(n)]
        width = 1
        while len(self.starts[-1]) > len(first):
            width *= FAN
            self.starts.append(np.flatnonzero(inside % width == 0))
        full = ~np.uint64(0)
        self.value, shared = [], []
        for starts in self.starts:
            low, high = np.bitwise_and.reduceat(self.fps, starts, axis=0), np.bitwise_or.reduceat(self.fps, starts, axis=0)
            self.value.append(low)
            shared.append(~(low ^ high) & full)
        self.child, self.mask = [], []
        for k, starts in enumerate(self.starts):
            above = np.searchsorted(self.starts[k + 1], starts, "right") - 1 if k + 1 < len(self.starts) else None
            self.mask.append(shared[k] if above is None else shared[k] & ~shared[k + 1][above])
            self.child.append(np.r_[np.searchsorted(self.starts[k - 1], starts), len(self.starts[k - 1])] if k else None)

    def search(self, queries: np.ndarray, roots: np.ndarray, limit: int, linked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) within `limit` bits. linked: labels of leaves; what has the query's label is left out."""
        node, far = roots, np.zeros(len(queries), np.int64)
        for k in range(len(self.starts) - 1, -1, -1):
            far = far + bits((self.fps[queries] ^ self.value[k][node]) & self.mask[k][node])
            stay = far <= limit
            if linked is not None:
                low = np.minimum.reduceat(linked, self.starts[k])[node]
                high = np.maximum.reduceat(linked, self.starts[k])[node]
                stay &= (low != high) | (low != linked[queries])
            queries, node, far = queries[stay], node[stay], far[stay]
            if k:
                count = self.child[k][node + 1] - self.child[k][node]
                base = np.repeat(self.child[k][node] - (np.cumsum(count) - count), count)
                node = base + np.arange(count.sum())
                queries, far = np.repeat(queries, count), np.repeat(far, count)
        return queries, node


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest member) after linking a to b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def stars(groups: np.ndarray, fps: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, its component's first) within the groups; whole components, no pairs."""
    if len(fps) < 2:
        return fps[:0], fps[:0]
    index = GrayIndex(groups, fps)
    label = np.arange(len(fps))
    group_of = np.repeat(np.arange(len(index.first)), index.sizes)
    small = np.flatnonzero((index.sizes > 1) & (index.sizes <= SMALL))
    if len(small):
        work = np.cumsum(index.sizes[small].astype(np.int64) ** 2)
        for part in np.split(small, np.searchsorted(work, np.arange(1 << 21, work[-1], 1 << 21))):
            if len(part):
                queries = np.flatnonzero(np.isin(group_of, part)) if len(part) < len(index.first) else np.arange(len(fps))
                label = _union(label, *index.search(queries, group_of[queries], limit))
    for g in np.flatnonzero(index.sizes > SMALL):
        begin, size = index.first[g], index.sizes[g]
        own = GrayIndex(np.zeros(size, np.int8), index.fps[begin : begin + size])
        mine = np.arange(size)
        for i in range(0, size, BLOCK):
            queries = np.arange(i, min(size, i + BLOCK))
            mine = _union(mine, *own.search(queries, np.zeros(len(queries), np.int64), limit, mine))
        label[begin + own.order] = begin + own.order[mine]
    far = np.flatnonzero(label != np.arange(len(fps)))
    return index.fps[far], index.fps[label[far]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, in order of (key, tile), to links u, v."""

    def out(rows: np.ndarray) -> pa.RecordBatch:
        change = np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]
        u, v = stars(np.cumsum(change), rows[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    rest = np.zeros((3, 0), np.int64)
    for batch in batches:
        rest = np.concatenate([rest, np.stack([np.asarray(x) for x in batch.columns])], axis=1)
        change = np.flatnonzero((rest[0, 1:] != rest[0, :-1]) | (rest[1, 1:] != rest[1, :-1]))
        if len(change):
            ready, rest = rest[:, : change[-1] + 1], rest[:, change[-1] + 1 :]
            yield out(np.ascontiguousarray(ready))
    if rest.shape[1]:
        yield out(np.ascontiguousarray(rest))


def dealt(spark: SparkSession, rows: DataFrame, by: str, tile: int = TILE) -> DataFrame:
    """`rows` (key, `by`, ...) dealt out by `key` and a new column `tile`, and sorted by them. Keys of one row go. A key with more
    than `tile` rows is split into parts by a hash of `by`, any two of which meet in a tile."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    full = sizes.filter(F.col("size") > tile).withColumn("parts", F.ceil(2 * F.col("size") / F.lit(tile)).cast("long")).select("key", "parts")
    full = keep(spark, full, f"{shared_dir(spark)}/full")
    number = full.count()
    if number:
        rows = rows.join(F.broadcast(full) if number <= BROADCAST_KEYS else full, "key", "left")
        part = F.pmod(F.xxhash64(by), F.col("parts"))
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = rows.withColumn("part", part).withColumn("other", other)
        rows = rows.withColumn("tile", F.coalesce(F.least("part", "other") * F.col("parts") + F.greatest("part", "other"), F.lit(0).cast("long"))).drop("part", "other", "parts")
    else:
        rows = rows.withColumn("tile", F.lit(0).cast("long"))
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile")


def blocks(classes: int) -> int:
    """How many blocks a fingerprint is cut into, so that a bucket of so many classes has a sixteenth of a tile on average, if eight do."""
    return next((m for m in range(BLOCKS, 8) if classes >> (64 * (m - MAX_BITS) // m) <= TILE // 16), 8)


def bucket_keys(m: int) -> list[Column]:
    """The buckets of `fp` cut into m blocks: one for every m - MAX_BITS of them, told by their number and bits."""
    edges = [64 * i // m for i in range(m + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(m), m - MAX_BITS)):
        key = F.lit(number).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return keys


def links(spark: SparkSession, classes: DataFrame, tile: int = TILE, m: int | None = None) -> DataFrame:
    """Stars (u, v) over the distinct fingerprints `fp` of classes that differ in at most MAX_BITS bits."""
    m = blocks(classes.count()) if m is None else m
    rows = dealt(spark, classes.select("fp", F.explode(F.array(*bucket_keys(m))).alias("key")), "fp", tile)
    return rows.select("key", "tile", "fp").mapInArrow(_link, "u long, v long")


def near_classes(spark: SparkSession, prints: DataFrame, path: str, tile: int = TILE) -> DataFrame:
    """`prints` (__id, fp, ...) to fp, component_id: the smallest __id of the fingerprint's component."""
    classes = keep(spark, prints.groupBy("fp").agg(F.min("__id").alias("first")), f"{path}/classes")
    stars = components(spark, links(spark, classes, tile), f"{path}/components")
    member = stars.join(classes, F.col("node") == F.col("fp"))
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    member = keep(spark, stars.join(least, "root").select(F.col("node").alias("fp"), "least"), f"{path}/members")
    return classes.join(member, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint, component_id."""
    path = shared_dir(spark)
    prints = keep(spark, fingerprints(docs, text, {"__id": F.col(doc_id)}), f"{path}/prints")
    found = prints.join(near_classes(spark, prints, path, tile), "fp")
    return found.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each component, that with the smallest doc_id (then file and row)."""
    path, names = shared_dir(spark), docs.columns
    rows = located(spark, docs, path)
    prints = keep(spark, fingerprints(rows, text, {"__id": F.col(doc_id), "__file": F.col("__file"), "__row": F.col("__row")}), f"{path}/prints")
    # Components are told apart by a representative fingerprint, since a doc_id may be null or repeat.
    classes = keep(spark, prints.groupBy("fp").agg(F.min(F.struct("__id", "__file", "__row")).alias("first")), f"{path}/classes")
    stars = components(spark, links(spark, classes.select("fp")), f"{path}/components")
    rooted = classes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    stay = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("stay")), "root").select("fp", "stay")
    gone = prints.join(stay, "fp").filter((F.col("__file") != F.col("stay.__file")) | (F.col("__row") != F.col("stay.__row")))
    out = without(spark, rows, gone)
    if "_metadata" in names:
        out = out.withColumnRenamed("__own_metadata", "_metadata")
    return out.select(*names)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark, documents(spark, sf_dir, "doc_id", "text"))
