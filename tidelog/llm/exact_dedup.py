"""Exact deduplication by a stateful stream whose keyed state lives on disk and never expires.

A stream over the content keys of all documents groups them by digest. Its state (RocksDB, checkpointed to
the shared folder) holds for every digest the stable identifier of the document that stays, that
document's content locator (file and row) and the number of rows so far. Spark combines the rows of a digest
within each task before it shuffles them, so that a digest with a third of all rows costs no more than others.
Wherever the state reports a hit, full bytes are compared with the content that the locator names; texts
that share a digest but not their bytes are grouped anew by the text itself. Texts without a hit are not looked at again.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, a null
doc_id being smaller than any other, and of repeated rows with that doc_id the one that is last by file and row;
texts of any length are compared whole, one to a row; an empty table gives an empty result. drop_copies keeps all columns; names
that start with two underscores are this module's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, keep, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Micro-batches that a finite input is cut into.
BATCHES = 4
#: Megabytes that the state stores of an executor take outside the heap.
STATE_MB = 128
#: Digests with hits, and places of dropped rows, that are broadcast (up to some 200 bytes each); more of them are joined.
BROADCAST_ROWS = 200_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """`docs` with __file and __row, where a row's content lies. What isn't read from files is written first."""
    if "_metadata" in docs.columns:
        docs = docs.withColumnRenamed("_metadata", "__own_metadata")
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return keep(spark, docs, f"{path}/content").select("*", *place)


def dedup_stream(keys: DataFrame) -> DataFrame:
    """Streaming `keys` (__sha, __id, __file, __row) to their groups so far: __sha, n, best (id, file, row)."""
    best = F.max(F.struct(F.col("__id").alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row")))
    return keys.groupBy("__sha").agg(F.count("*").alias("n"), best.alias("best"))


def registry(spark: SparkSession, keys: DataFrame, path: str, batches: int = BATCHES) -> DataFrame:
    """Runs the stream over the written table `keys` to its end; the groups as the state has them at last."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # A store reserves megabytes ahead otherwise, whatever it holds.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # All stores of an executor share so much memory outside the heap; what is beyond lies on disk.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STATE_MB))
    files = max(1, -(-len(keys.inputFiles()) // batches))
    stream = session.readStream.schema(keys.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/keys")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")

    query = dedup_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not keys.inputFiles() or query.lastProgress is None:
        return spark.createDataFrame([], dedup_stream(keys).schema)
    updates = spark.read.parquet(f"{path}/updates")
    # A group's count only grows, so its latest state is the one with the largest count.
    latest = updates.groupBy("__sha").agg(F.max(F.struct("n", "best")).alias("s"))
    return keep(spark, latest.select("__sha", "s.n", "s.best"), f"{path}/registry")


def resolve(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, batches: int = BATCHES, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` with __file and __row, and what becomes of each: __id, __file, __row, __sha, n, best."""
    path = shared_dir(spark)
    rows = located(spark, docs, path)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = rows.withColumn("__text", body).withColumn("__sha", digest(F.col("__text")))
    keys = keep(spark, rows.select("__sha", F.col(doc_id).alias("__id"), "__file", "__row"), f"{path}/keys")
    groups = registry(spark, keys, path, batches)

    # Full bytes of every hit: rows of a digest that have the very text at the state's locator are all the state has
    # counted, unless another text shares the digest. Texts without a hit stay where they are, unless the hits are too many
    # to broadcast. Equal texts are combined before the shuffle, so that only one row of each in a task is sent; what
    # then meets the state is a count, whether the locator's row is among them, and no text.
    locator = F.xxhash64("__file", "__row")
    hits = groups.filter("n > 1").select("__sha", "n", F.xxhash64("best.file", "best.row").alias("at"))
    hit = rows.join(F.broadcast(hits.select("__sha")), "__sha", "left_semi") if hits.count() <= most else rows
    texts = hit.groupBy("__sha", "__text").agg(F.count("*").alias("same"), F.max(locator).alias("high"), F.min(locator).alias("low"))
    differs = (F.col("same") < F.col("n")) | ~F.col("at").between(F.col("low"), F.col("high"))
    other = keep(spark, texts.drop("__text").join(hits, "__sha").filter(differs).select("__sha").distinct(), f"{path}/collisions")
    found = keys.join(groups, "__sha")
    if not other.isEmpty():
        again = rows.join(other, "__sha", "left_semi").withColumnRenamed(doc_id, "__id").select("__sha", "__text", "__id", "__file", "__row")
        best = F.max(F.struct(F.col("__id").alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row")))
        exact = again.groupBy("__sha", "__text").agg(F.count("*").alias("n"), best.alias("best"))
        exact = again.join(exact, ["__sha", "__text"]).drop("__text")
        found = found.join(other, "__sha", "left_anti").unionByName(exact)
    return rows, found


def exact_dedup(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    _, found = resolve(spark, docs, **options)
    kept = (F.col("__file") == F.col("best.file")) & (F.col("__row") == F.col("best.row"))
    return found.select(F.col("__id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"))


def without(spark: SparkSession, rows: DataFrame, gone: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` without those whose places (__file, __row) are in `gone`. Texts are shuffled only where these are too many to broadcast;
    places are unique, so nothing is skewed then."""
    gone = keep(spark, gone.select("__file", "__row"), f"{shared_dir(spark)}/gone")
    return rows.join(F.broadcast(gone) if gone.count() <= most else gone, ["__file", "__row"], "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, most: int = BROADCAST_ROWS, **options) -> DataFrame:
    """`docs` without the rows that exact_dedup does not keep."""
    names = docs.columns
    rows, found = resolve(spark, docs, most=most, **options)
    out = without(spark, rows, found.filter((F.col("__file") != F.col("best.file")) | (F.col("__row") != F.col("best.row"))), most)
    if "_metadata" in names:
        out = out.withColumnRenamed("__own_metadata", "_metadata")
    return out.select(*names)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir, "doc_id", "text"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
