"""Joins that bear keys with a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join with a table that is unique by ``keys``; ``rows`` may be skewed by them.

    The hash of the keys joins along. A table that was just aggregated by the keys
    is then shuffled once more, and only a join directly between two shuffles is one
    whose skewed side Spark splits.
    """
    left = rows.withColumn("_hash", key_hash(keys))
    right = table.withColumn("_hash", key_hash(keys))
    return left.join(right, [*keys, "_hash"], how).drop("_hash")
