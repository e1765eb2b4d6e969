"""Key hashes and bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of the key filter.
ITEMS, FALSE_POSITIVES = 1_000_000, 0.01


def hash_key(*columns: Column | str) -> Column:
    """A 64-bit hash of one or several key columns; types and order count, so (1, "a") and ("1", "a") differ."""
    return F.xxhash64(*columns)


def bloom_bits(items: int, rate: float = FALSE_POSITIVES) -> int:
    return math.ceil(-items * math.log(rate) / math.log(2) ** 2)


def bloom_hashes(items: int, rate: float = FALSE_POSITIVES) -> int:
    return max(1, round(bloom_bits(items, rate) / items * math.log(2)))


@dataclass
class KeyFilter:
    """A bloom filter over the hashes of a table's keys. It may say yes to a key that is absent, never no to one that is there."""

    filter: object

    @staticmethod
    def build(rows: DataFrame, keys: list[str], items: int = ITEMS, rate: float = FALSE_POSITIVES) -> KeyFilter:
        """Built in one pass, each task merging into a filter of fixed size (1.2 MB at the defaults)."""
        hashed = rows.dropna(subset=keys).select(hash_key(*keys).alias("h"))
        return KeyFilter(hashed._jdf.stat().bloomFilter("h", items, rate))

    def might_contain(self, probe: DataFrame, keys: list[str]) -> list[bool]:
        """For each row of a small probe, in its order, whether its key may be there; a null key never is."""
        rows = probe.select(F.when(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), hash_key(*keys)).alias("h")).collect()
        return [r.h is not None and bool(self.filter.mightContainLong(r.h)) for r in rows]
