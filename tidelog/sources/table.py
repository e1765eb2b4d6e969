"""A versioned table: Parquet segments, delete files and a commit log."""

from __future__ import annotations

import copy
import datetime
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from enum import IntEnum
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.keys import KeyFilter
from tidelog.functions.schema import LSN
from tidelog.operators import lookup as L
from tidelog.operators import stats as S
from tidelog.operators.cdc import locate
from tidelog.operators.prune import All, Compare, Predicate, prune
from tidelog.sources.log import Conflict, Files, Log

PLACE = ["seg_id", "__file", "__row"]
#: How often a commit is tried before it fails.
RETRIES = 200
#: How often a compaction starts anew because of deletes that came in between.
OVERTAKEN = 5
#: Bytes up to which compaction joins segments.
COMPACTED = 1 << 30
#: Keys that the bloom filter of a table is sized for at most (about 1.2 bytes each).
MAX_FILTERED = 1 << 26


class EmptyBatch(ValueError):
    pass


class Tier(IntEnum):
    """How durable an acknowledged write is."""

    MEMORY = 0
    DISK = 1
    OBJECT_STORAGE = 2
    COMMITTED = 3


@dataclass(frozen=True)
class Ack:
    lsn: int
    tier: Tier
    micros: int
    error: str | None = None


@dataclass(frozen=True)
class Watermarks:
    next: int
    flushed: int
    committed: int
    pending_flush: int
    pending_commit: int


class Table:
    """One batch is one LSN and one segment. Readers see whole log entries only."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, primary_key: list[str] | None = None, durability: str = "Durable", indexed: bool = True) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.primary_key, self.durability, self.indexed = list(primary_key or []), durability, indexed
        self.files = Files(spark, self.path)
        self.log = Log(self.files, f"{self.path}/_log")
        self._filter: tuple[int, KeyFilter] | None = None

    # Ingest

    def _conform(self, batch: DataFrame) -> DataFrame:
        if LSN in batch.columns:
            batch = batch.drop(LSN)
        missing = [f.name for f in self.schema.fields if f.name not in batch.columns and not f.nullable]
        extra = [c for c in batch.columns if c not in self.schema.names]
        if missing or extra:
            raise ValueError(f"the batch lacks {missing} and has unknown columns {extra}")
        return batch.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema.fields]))

    def _stage(self, rows: DataFrame) -> dict:
        """Writes one segment aside, once for a call however often its commit is tried; its statistics are gathered by the same pass.

        The column for the LSN counts from the LSN of the entry (from 0 in a compacted segment), which the folder's name will tell.
        """
        if LSN not in rows.columns:
            rows = rows.withColumn(LSN, F.lit(0).cast("long"))
        folder = f"{self.path}/_staged/{uuid.uuid4().hex}"
        required = [f.name for f in self.schema.fields if not f.nullable]
        absent = F.count_if(reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in required), F.lit(False))).alias("absent")
        seen = Observation()
        rows = rows.observe(seen, absent, *S.ranges(rows.schema), *S.bounds(rows.schema))
        writer = rows.write.option("parquet.bloom.filter.adaptive.enabled", "true")
        for key in self.primary_key if self.indexed else ():
            # Lookups skip row groups by these.
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        try:
            writer.parquet(folder)
            found = seen.get
            if found.pop("absent"):
                raise ValueError(f"nulls in {required}")
        except BaseException:
            self.files.delete(folder)
            raise
        plain = {k: v if isinstance(v, (int, float, str, type(None))) else str(v) for k, v in found.items()}
        return {"path": folder, "bytes": self.files.size(folder), "created_at": time.time(), "committed": False, "durability": self.durability} | plain

    def _numbered(self, seg: dict, seg_id: int, lsn: int) -> dict:
        """A staged segment under the numbers that a commit is tried with; `seg` is told where its files are."""
        to = f"{self.path}/data/seg-{seg_id}-{lsn}-{uuid.uuid4().hex}"
        self.files.move(seg["path"], to)
        seg["path"] = to
        names = ("min_lsn", "max_lsn", f"min_{LSN}", f"max_{LSN}")
        return seg | {"seg_id": seg_id} | {n: seg[n] + lsn for n in names if seg.get(n) is not None}

    def _next_segment(self) -> int:
        state = self.log.state
        return max([0, *state.segments, *(r["segment"]["seg_id"] for r in state.retired)]) + 1

    def _commit(self, make, txn: str | None = None, staged: list[dict] | None = None) -> int:
        """Publishes the entry that `make(lsn, seg_id)` returns, again with later numbers if another writer was first. What was staged
        for it, and delete files of attempts that lost, are removed unless they are part of the log in the end."""
        done = False
        try:
            for attempt in range(RETRIES):
                state = self.log.refresh()
                if txn and txn in state.transactions:
                    return int(state.transactions[txn])
                lsn = state.next
                entry = {"lsn": lsn, "txn": txn} | make(lsn, self._next_segment())
                try:
                    self.log.publish(entry)
                    done = True
                    return lsn
                except Conflict:
                    if entry.get("deletes"):
                        self.files.delete(entry["deletes"])
                    if self.log.refresh().next == lsn:
                        # Somebody's entry can't be read yet.
                        time.sleep(min(0.5, 0.01 * 2**attempt))
            raise Conflict(f"no entry could be published in {RETRIES} attempts")
        finally:
            for seg in [] if done else staged or []:
                self.files.delete(seg["path"])

    def _known(self, txn: str | None) -> int | None:
        found = self.log.refresh().transactions.get(txn) if txn else None
        return None if found is None else int(found)

    def append(self, batch: DataFrame, idempotency_key: str | None = None) -> list[Ack]:
        """Appends a batch; an acknowledgement for each tier it has reached. An empty batch is an error, and so is a null in a column that
        must not have any."""
        batch = self._conform(batch)
        lsn = self._known(idempotency_key)
        if lsn is None:
            seg = self._stage(batch)
            if not seg["rows"]:
                self.files.delete(seg["path"])
                raise EmptyBatch("an empty batch can't be appended")
            lsn = self._commit(lambda lsn, seg_id: {"kind": "append", "segments": [self._numbered(seg, seg_id, lsn)]}, idempotency_key, [seg])
        return [Ack(lsn, tier, time.time_ns() // 1000) for tier in (Tier.MEMORY, Tier.DISK)]

    def append_many(self, batches: list[DataFrame], idempotency_key: str | None = None) -> list[int]:
        """Appends several batches as one segment, each under an LSN of its own; empty ones are left out. Their LSNs."""
        batches = [b for b in map(self._conform, batches) if not b.isEmpty()]
        if not batches:
            return []
        first = self._known(idempotency_key)
        if first is None:
            seg = self._stage(reduce(DataFrame.unionByName, [b.withColumn(LSN, F.lit(i).cast("long")) for i, b in enumerate(batches)]))
            first = self._commit(lambda lsn, seg_id: {"kind": "append", "last_lsn": lsn + len(batches) - 1, "segments": [self._numbered(seg, seg_id, lsn)]}, idempotency_key, [seg])
        return list(range(first, first + len(batches)))

    # Reads

    def head(self) -> int:
        return self.log.refresh().commit

    def _read(self, segments: list[dict]) -> DataFrame:
        schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in self.schema.fields], T.StructField(LSN, T.LongType())])
        if not segments:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({"seg_id": F.lit(0).cast("long"), "__file": F.lit(""), "__row": F.lit(0).cast("long")})
        rows = self.spark.read.schema(schema).parquet(*[s["path"] for s in segments])
        number = lambda k: F.regexp_extract("_metadata.file_path", r"/seg-(\d+)-(\d+)-[0-9a-f]{32}/", k).cast("long")
        return rows.withColumns({LSN: F.col(LSN) + number(2), "seg_id": number(1), "__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})

    def _deletes(self, lsn: int, segments: list[dict]) -> DataFrame | None:
        """The deletes that such segments have as of an LSN; those of segments that compaction has replaced are not read any more."""
        ids = {s["seg_id"] for s in segments}
        paths = [d["path"] for d in self.log.state.deletes if d["lsn"] <= lsn and not ids.isdisjoint(d["touched"])]
        return self.spark.read.parquet(*paths) if paths else None

    def _live(self, lsn: int) -> list[dict]:
        """The segments that make up the table as of an LSN."""
        state = self.log.state
        live = [s for s in state.segments.values() if s["min_lsn"] <= lsn]
        # A snapshot older than a compaction reads the segments that were there then, not their successor.
        newer = {s["seg_id"] for s in live if s.get("since", 0) > lsn}
        live = [s for s in live if s["seg_id"] not in newer]
        return live + [r["segment"] for r in state.retired if r["lsn"] > lsn and r["segment"]["min_lsn"] <= lsn and r["segment"].get("since", 0) <= lsn]

    def _visible(self, lsn: int, where: Predicate | None = None) -> DataFrame:
        """Rows as of an LSN with their places; segments that can't matter are not opened."""
        live = self._live(lsn)
        if where is not None and live:
            kept = {r.seg_id for r in prune(self._frame(live), where).select("seg_id").collect()}
            live = [s for s in live if s["seg_id"] in kept]
        rows = self._read(live).where(F.col(LSN) <= lsn)
        gone = self._deletes(lsn, live)
        if gone is not None:
            rows = rows.join(gone.select(*PLACE), PLACE, "left_anti")
        return rows if where is None else rows.where(where.rows())

    def snapshot(self, as_of: int | None = None) -> DataFrame:
        """All rows as of an LSN, at most the last committed one."""
        head = self.head()
        return self._visible(head if as_of is None else min(as_of, head)).select(*self.schema.names, LSN)

    def scan(self, where: Predicate | None = None, columns: list[str] | None = None, limit: int | None = None, as_of: int | None = None) -> DataFrame:
        head = self.head()
        rows = self._visible(head if as_of is None else min(as_of, head), where).select(*(columns or [*self.schema.names, LSN]))
        return rows if limit is None else rows.limit(limit)

    def at(self, session: SparkSession, as_of: int, where: Predicate | None = None) -> DataFrame:
        """The rows of `where` as of an LSN, in another session."""
        other = copy.copy(self)
        other.spark = session
        return other._visible(as_of, where).select(*self.schema.names, LSN)

    def view(self, name: str, where: Predicate | None = None) -> None:
        """Makes the current snapshot a temporary view for SQL."""
        self.scan(where).createOrReplaceTempView(name)

    # Change data

    def _need_key(self) -> list[str]:
        if not self.primary_key:
            raise ValueError("the table has no primary key")
        return self.primary_key

    def _delete_entry(self, keys: DataFrame, lsn: int, target_lsn: int | None, strict: bool) -> dict:
        """Writes the places of the newest rows of the keys: a folder, if there are any, and the segments it touches."""
        names = self._need_key()
        found = locate(self._visible(self.log.state.commit), keys, names, PLACE)
        if target_lsn is not None:
            found = found.where(F.col(LSN) == target_lsn)
        rows = found.select(*PLACE, F.col(LSN).alias("target_lsn"), F.lit(lsn).cast("long").alias("delete_lsn"))
        folder = f"{self.path}/_deletes/lsn-{lsn}-{uuid.uuid4().hex}"
        seen = Observation()
        rows.observe(seen, F.count("*").alias("n")).write.parquet(folder)
        n = seen.get["n"]
        if strict and n != keys.select(*names).distinct().count():
            self.files.delete(folder)
            raise KeyError(f"{n} of the keys have a row" + (f" of LSN {target_lsn}" if target_lsn is not None else ""))
        if not n:
            self.files.delete(folder)
            return {}
        return {"deletes": folder, "touched": sorted(r.seg_id for r in self.spark.read.parquet(folder).select("seg_id").distinct().collect())}

    def _once(self, rows: DataFrame) -> None:
        """One change a key, else which of them is the last would not be known."""
        if not rows.groupBy(*self._need_key()).count().where("count > 1").isEmpty():
            raise ValueError("several changes of one key")

    def delete(self, keys: DataFrame, target_lsn: int | None = None) -> int:
        """Deletes the newest row of each key, which must have `target_lsn` if that is given. A failure uses up an LSN."""
        lsns = []

        def make(lsn: int, _: int) -> dict:
            lsns.append(lsn)
            return {"kind": "delete"} | self._delete_entry(keys, lsn, target_lsn, True)

        try:
            return self._commit(make)
        except KeyError:
            self._commit(lambda lsn, _: {"kind": "gap"})
            raise

    def delete_key(self, *values, target_lsn: int | None = None) -> int:
        names = self._need_key()
        return self.delete(self.spark.createDataFrame([values], T.StructType([self.schema[n] for n in names])), target_lsn)

    def update(self, rows: DataFrame, target_lsn: int | None = None) -> int:
        """Replaces the newest row of each key: a delete and an append under one LSN."""
        rows = self._conform(rows)
        self._once(rows)
        seg = self._stage(rows)

        def make(lsn: int, seg_id: int) -> dict:
            gone = self._delete_entry(rows, lsn, target_lsn, True)
            return {"kind": "update", "segments": [self._numbered(seg, seg_id, lsn)]} | gone

        return self._commit(make, staged=[seg])

    def apply_changes(self, changes: DataFrame, op: str = "op", idempotency_key: str | None = None) -> int:
        """Applies inserts, updates and deletes (column `op`), one change a key, under one LSN."""
        self._once(changes)
        known = self._known(idempotency_key)
        if known is not None:
            return known
        seg = self._stage(self._conform(changes.where(F.col(op) != "delete").drop(op)))

        def make(lsn: int, seg_id: int) -> dict:
            gone = self._delete_entry(changes.where(F.col(op) != "insert"), lsn, None, False)
            return {"kind": "changes", "segments": [self._numbered(seg, seg_id, lsn)] if seg["rows"] else []} | gone

        return self._commit(make, idempotency_key, [seg])

    def compact(self, target: int = COMPACTED) -> int | None:
        """Joins successive segments into ones of up to `target` bytes, without their deleted rows; larger segments stay unless rows of them
        are deleted. Older snapshots still read the segments that were replaced. None if there is nothing to do."""
        for _ in range(OVERTAKEN):
            state = self.log.refresh()
            head, known = state.commit, len(state.deletes)
            touched = {i for d in state.deletes for i in d["touched"]}
            groups, size = [], 0
            for s in sorted(state.segments.values(), key=lambda s: s["seg_id"]):
                if groups and size + s["bytes"] <= target:
                    groups[-1].append(s)
                else:
                    groups.append([s])
                    size = 0
                size += s["bytes"]
            groups = [g for g in groups if len(g) > 1 or g[0]["seg_id"] in touched]
            if not groups:
                return None
            staged, removed = [], [s["seg_id"] for g in groups for s in g]

            def make(lsn: int, seg_id: int) -> dict:
                now = self.log.state
                if len(now.deletes) != known or any(i not in now.segments for i in removed):
                    raise Conflict("the segments have changed")
                fresh = [self._numbered(s, seg_id + i, 0) | {"since": lsn} for i, s in enumerate(x for x in staged if x["rows"])]
                return {"kind": "compact", "segments": fresh, "removed": removed}

            try:
                for group in groups:
                    rows = self._read(group)
                    gone = self._deletes(head, group)
                    rows = rows if gone is None else rows.join(gone.select(*PLACE), PLACE, "left_anti")
                    staged.append(self._stage(rows.select(*self.schema.names, LSN)))
            except BaseException:
                for s in staged:
                    self.files.delete(s["path"])
                raise
            try:
                lsn = self._commit(make, staged=staged)
            except Conflict:
                continue  # a delete came in between: again, from what is there now
            for s in staged:
                if not s["rows"]:
                    self.files.delete(s["path"])
            return lsn
        raise Conflict("compaction was overtaken again and again")

    # Places

    def migrate(self, root: str, age_seconds: float = 0.0) -> int | None:
        """Copies segments of some age to another place (an object store, say), from where they are read from then on; the LSN of that.
        What they were before stays until `vacuum`. None if there is nothing to move."""
        root, now = root.rstrip("/"), time.time()
        other = Files(self.spark, root)
        moved = {}
        for s in self.log.refresh().segments.values():
            if now - s["created_at"] >= age_seconds and not s["path"].startswith(f"{root}/"):
                moved[str(s["seg_id"])] = to = f"{root}/{s['path'].rsplit('/', 1)[1]}"
                self.files.copy(s["path"], other, to)
        if not moved:
            return None

        def make(lsn: int, _: int) -> dict:
            # What compaction has replaced meanwhile is left where it is.
            return {"kind": "move", "moved": {k: v for k, v in moved.items() if int(k) in self.log.state.segments}}

        return self._commit(make)

    def vacuum(self, age_seconds: float = 7 * 86400.0) -> list[str]:
        """Deletes folders that the log does not know, if they are older than that: what writers have left that died, or that moved away."""
        state = self.log.refresh()
        known = {s["path"] for s in state.segments.values()} | {r["segment"]["path"] for r in state.retired} | {d["path"] for d in state.deletes}
        gone = []
        for part in ("_staged", "data", "_deletes"):
            for name in self.files.names(f"{self.path}/{part}"):
                path = f"{self.path}/{part}/{name}"
                if path not in known and self.files.age(path) >= age_seconds:
                    self.files.delete(path)
                    gone.append(path)
        return gone

    # Keys

    def _fits(self, values: tuple) -> bool:
        """Whether the values are as many as the key's columns and of their kinds. Others have no rows; they are not cast."""
        kinds = {"string": str, "boolean": bool, "double": float, "float": float, "date": datetime.date, "binary": (bytes, bytearray)} | dict.fromkeys(("tinyint", "smallint", "int", "bigint"), int)
        names = self._need_key()
        if len(values) != len(names):
            return False
        for name, value in zip(names, values, strict=True):
            kind = kinds.get(self.schema[name].dataType.simpleString())
            if value is None or (kind and (not isinstance(value, kind) or (kind is int and isinstance(value, bool)))):
                return False
        return True

    def lookup(self, *values) -> DataFrame:
        """The newest row of a key. Only segments whose statistics may have the key are opened, and in them the row groups whose bloom
        filter may. A key of other types than the key's columns, or with a null, has no row."""
        names = self._need_key()
        if not self._fits(values):
            return self.snapshot(0).limit(0)
        where = All(tuple(Compare(k, "=", v) for k, v in zip(names, values, strict=True)))
        return L.lookup(self._visible(self.head(), where).select(*self.schema.names, LSN), names, values)

    def exists(self, *values) -> bool:
        """Exact. The bloom filter answers for most keys that are absent."""
        return self.might_exist(*values) and not self.lookup(*values).isEmpty()

    def might_exist(self, *values) -> bool:
        names, head = self._need_key(), self.head()
        if not self._fits(values):
            return False
        if self._filter is None or self._filter[0] != head:
            rows = sum(s["rows"] for s in self._live(head))
            self._filter = head, KeyFilter.build(self.snapshot(), names, min(MAX_FILTERED, max(1000, rows)))
        probe = self.spark.createDataFrame([values], T.StructType([T.StructField(n, self.schema[n].dataType) for n in names]))
        return self._filter[1].might_contain(probe, names)[0]

    def index_stats(self) -> DataFrame:
        return L.index_stats(self.snapshot(), self._need_key())

    def key_index(self) -> DataFrame:
        """The newest place of each key."""
        return L.key_index(self._visible(self.head()), self._need_key(), PLACE)

    # Segments

    def _frame(self, segments: list[dict]) -> DataFrame:
        """Segments and their statistics, typed as the table's columns."""
        whole = T.StructType([*[T.StructField(f.name, f.dataType) for f in self.schema.fields], T.StructField(LSN, T.LongType())])
        kinds = {"seg_id": "long", "path": "string", "rows": "long", "bytes": "long", "created_at": "double", "committed": "boolean", "min_lsn": "long", "max_lsn": "long"}
        time_ = next((self.schema[n].dataType.simpleString() for n in [S.time_column(self.schema.names)] if n), "timestamp_ntz")
        kinds |= {"min_time": time_, "max_time": time_}
        for f in whole.fields:
            if S.comparable(f.dataType):
                kinds |= {f"min_{f.name}": f.dataType.simpleString(), f"max_{f.name}": f.dataType.simpleString(), f"nulls_{f.name}": "long"}
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                kinds[f"nans_{f.name}"] = "long"
        rows = [[None if s.get(k) is None else str(s[k]) for k in kinds] for s in sorted(segments, key=lambda s: s["seg_id"])]
        frame = self.spark.createDataFrame(rows, T.StructType([T.StructField(k, T.StringType()) for k in kinds]))
        return frame.select(*[F.col(f"`{k}`").cast(v).alias(k) for k, v in kinds.items()])

    def segments(self) -> DataFrame:
        return self._frame(list(self.log.refresh().segments.values()))

    def segments_by_time(self, start, end) -> DataFrame:
        return self.segments().where(S.overlaps_time(F.lit(start), F.lit(end)))

    def segments_by_lsn(self, lsn: int) -> DataFrame:
        return self.segments().where(S.contains_lsn(lsn))

    def uncommitted(self) -> DataFrame:
        return self.segments().where(~F.col("committed"))

    def prunable(self, age_seconds: float) -> DataFrame:
        return self.segments().where(F.col("committed") & (F.lit(time.time()) - F.col("created_at") >= age_seconds))

    def mark_committed(self, *seg_ids: int) -> bool:
        """Marks segments as committed to the lakehouse; False if one is absent."""
        state = self.log.refresh()
        if any(s not in state.segments for s in seg_ids):
            return False
        high = max(state.segments[s]["max_lsn"] for s in seg_ids)
        self._commit(lambda lsn, _: {"kind": "mark", "mark": list(seg_ids), "committed_lsn": high})
        return True

    def totals(self) -> DataFrame:
        return S.totals(self.segments())

    def watermarks(self) -> Watermarks:
        s = self.log.refresh()
        return Watermarks(s.next, s.flushed, s.committed, max(0, s.next - s.flushed), max(0, s.flushed - s.committed))

    def reached(self, lsn: int) -> Tier | None:
        """How durable an LSN is by now; None if it is not in the log. On a local file system nothing reaches an object store."""
        state = self.log.refresh()
        if lsn > state.commit:
            return None
        if lsn <= state.committed:
            return Tier.COMMITTED
        return Tier.DISK if self.files.local else Tier.OBJECT_STORAGE

    def wait(self, lsn: int, tier: Tier, timeout: float, every: float = 0.1) -> bool:
        """Waits until an LSN has reached a tier; whether it has."""
        end = time.monotonic() + timeout
        while True:
            now = self.reached(lsn)
            if now is not None and now >= tier:
                return True
            if time.monotonic() >= end:
                return False
            time.sleep(every)

    def subscribe(self, told: Callable[[Watermarks], None], every: float = 0.1) -> Callable[[], None]:
        """Calls `told` with the watermarks now and whenever they have moved, whoever writes; returns what ends the subscription."""
        stop, own = threading.Event(), copy.copy(self)
        own.log = Log(self.files, self.log.folder, self.log.grace)

        def watch() -> None:
            last = None
            while not stop.is_set():
                now = own.watermarks()
                if now != last:
                    last = now
                    told(now)
                stop.wait(every)

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()

        def end() -> None:
            stop.set()
            thread.join()

        return end
