"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; the first four
return the columns of `documents`, and no others that `docs` may have. Documents that the quality rules refuse go; of equal texts
the row with the largest doc_id stays; of each group of near copies (five-word shingles, similarity 0.8 at least) that with the
smallest doc_id; live-looking secrets are masked in the text; what is left is packed into sequences.

Defined results: the quality rules refuse a null or empty text; very long texts pass whole through all stages. A null doc_id is smaller than any other; of repeated rows one stays, the last by file and row; a null
source is a host of its own and adds no owner to a value. Equal sizes in packing are taken in the order of a hash of the rows' places. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import keep, scratch, shared_dir
from tidelog.llm.exact_dedup import drop_copies
from tidelog.llm.near_copies import drop_near_copies
from tidelog.llm.packing import pack_documents
from tidelog.llm.quality import quality_rules
from tidelog.llm.secrets import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(spark, docs, COLUMNS).filter("kept").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = redact(spark, docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("secret scan", secrets), ("packing", packing)]

#: SQL cannot tokenise and pack; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written as Parquet and read again by the next."""
    path = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch():  # what the stage has written for itself goes when its result is there
            docs = keep(spark, stage(spark, docs, sf_dir), f"{path}/stage={number}")
    return STAGES[-1][1](spark, docs, sf_dir)
