"""Keyword search through an index of trigrams.

The literal, ASCII-case-blind substring test of ``filters.matches_keyword`` needs a scan. A keyword of
three characters or more occurs only in rows that hold all its trigrams, so the postings of the
rarest one are candidates and the test itself confirms them. Shorter keywords scan.

The index is three tables: postings ``(gram, block, id)``, counts ``(gram, n)`` and the searched texts
``(id, block, ...)``. The first two are partitioned by a hash of the trigram, the third by a
hash of the id, so a search reads one partition of postings and the text blocks of its candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.functions.text import fold_ascii, fold_ascii_text
from venuedir.operators.filters import KEYWORD_COLUMNS, matches_keyword

GRAM = 3


def grams(text: Column) -> Column:
    """Distinct trigrams of a text, letters folded; NULL and shorter texts have none."""
    return F.array_distinct(_all_grams(text))


def _all_grams(text: Column) -> Column:
    # one pass: each match takes one character and looks ahead for the gram that starts with it
    found = F.regexp_extract_all(fold_ascii(text), F.lit(f"(?s)(?=({'.' * GRAM}))."), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def keyword_grams(text: str) -> list[str]:
    folded = fold_ascii_text(text)
    return sorted({folded[i:i + GRAM] for i in range(len(folded) - GRAM + 1)})


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


class KeywordIndex:
    """An index below ``path`` over the searched columns of a table with a unique ``id``.

    ``buckets`` splits postings by trigram and texts by id; a few hundred MB of postings a bucket are fine.
    """

    def __init__(self, path: str, buckets: int = 1024, columns: Sequence[str] = KEYWORD_COLUMNS):
        self.path, self.buckets, self.columns = path, buckets, list(columns)

    def build(self, rows: DataFrame) -> None:
        """Write the index of ``rows``.

        Texts are spread over all tasks before their trigrams are made, however few files they come from, and
        trigrams are made once: a bucket is one hash partition that Spark splits by size, so a trigram of very many
        rows lies in several files. Counts come from a combining aggregate.
        """
        spark = rows.sparkSession
        block = _bucket(F.col("id"), self.buckets).alias("block")
        texts = rows.select("id", *self.columns, block)
        texts.hint("rebalance", "block").write.partitionBy("block").parquet(f"{self.path}/texts")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        spread = texts.repartition(tasks, "id", *self.columns)
        found = F.array_distinct(F.concat(*[_all_grams(F.col(c)) for c in self.columns]))
        posts = spread.select("id", "block", F.explode(found).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        (posts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "block", "id")
         .write.partitionBy("bucket").parquet(f"{self.path}/postings"))
        stored = spark.read.parquet(f"{self.path}/postings")
        counts = stored.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/counts")

    def rarest(self, spark: SparkSession, text: str) -> str | None:
        """The keyword's rarest trigram, None if one of them occurs nowhere. One row per trigram of the keyword is read."""
        wanted = keyword_grams(text)
        buckets = sorted(set(spark.range(1).select(*[_bucket(F.lit(g), self.buckets) for g in wanted]).first()))
        counts = spark.read.parquet(f"{self.path}/counts").where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
        found = {r.gram: r.n for r in counts.select("gram", "n").collect()}
        return min(wanted, key=lambda g: (found[g], g)) if len(found) == len(wanted) else None

    def candidates(self, spark: SparkSession, gram: str) -> DataFrame:
        """``(id, block)`` of all rows that hold the trigram; reads its partition only."""
        bucket = spark.range(1).select(_bucket(F.lit(gram), self.buckets)).first()[0]
        posts = spark.read.parquet(f"{self.path}/postings")
        return posts.where((F.col("bucket") == bucket) & (F.col("gram") == gram)).select("id", "block")

    def matching_ids(self, spark: SparkSession, text: str) -> DataFrame:
        """``id`` of every row that :func:`filters.matches_keyword` finds."""
        texts = spark.read.parquet(f"{self.path}/texts")
        confirmed = texts.where(matches_keyword(text, self.columns))
        if len(text) >= GRAM:
            gram = self.rarest(spark, text)
            if gram is None:
                return texts.where("false").select("id")
            confirmed = confirmed.join(self.candidates(spark, gram), ["id", "block"], "left_semi")
        return confirmed.select("id")

    def search(self, entries: DataFrame, text: str) -> DataFrame:
        """Rows of ``entries`` that hold the keyword."""
        ids = self.matching_ids(entries.sparkSession, text).withColumnRenamed("id", "_wanted")
        return entries.join(ids, entries["id"] == ids["_wanted"], "left_semi")
