"""Pages by number at any depth, from an order-statistics table.

Sorted rows are stored in range partitions, and one row per partition tells how many rows come before
it. A page number becomes a few partitions and an offset inside them; nothing in front is read or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuedir.operators.paging import check_page, ordering, sort_keys

#: Rows per stored range; a page reads one or two.
RANGE_ROWS = 200_000
#: Rows per task in front of the range shuffle, and the most tasks there (Spark writes a shuffle of so few without a buffer).
SPREAD_ROWS, MAX_SPREAD = 5_000, 200


class RankedRows:
    """Rows sorted for one sort name and direction below ``path``."""

    def __init__(self, path: str, sort: str = "", order: str = ""):
        self.path, self.keys = path, sort_keys(sort, order)

    def build(self, rows: DataFrame, range_rows: int = RANGE_ROWS) -> None:
        """Write ``rows``, which have a unique ``id``, in ranges of about ``range_rows``, each row with its place in its range.

        Spark's range partitioning makes the global order; one count per range is all that is summed in one place.
        A task of the range shuffle holds the rows it sorts into ranges, so rows are spread first, however few files they come from.
        """
        spark, columns = rows.sparkSession, ordering(self.keys)
        total = rows.count()
        parts = max(1, -(-total // range_rows))
        spread = rows.repartition(max(1, min(MAX_SPREAD, -(-total // SPREAD_ROWS))), F.xxhash64("id"))
        # the column keeps Spark from taking the two shuffles for one
        ranged = spread.withColumn("_tie", F.xxhash64("id")).repartitionByRange(parts, *columns, "_tie").drop("_tie")
        ranged = ranged.sortWithinPartitions(*columns).withColumns({
            "_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        ranged.write.partitionBy("_range").parquet(f"{self.path}/rows")
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = spark.read.schema(ranged.schema).parquet(f"{self.path}/rows").groupBy("_range").agg(F.count("*").alias("n"))
        counts.select("_range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{self.path}/ranges")

    def page(self, spark: SparkSession, page: int = 1, per_page: int = 20) -> DataFrame:
        """The rows of a page, in order; empty past the end.

        The table of ranges gives the one or more ranges that hold it and the places inside; ranges are folders and places
        are stored in order, so only the row groups of the page are read and only its rows are sorted.
        """
        check_page("", "", page, per_page)
        low = (page - 1) * per_page
        ranges = spark.read.parquet(f"{self.path}/ranges").where(
            (F.col("before") < low + per_page) & (F.col("before") + F.col("n") > low)).collect()
        test = F.lit(False)
        for r in ranges:
            test = test | ((F.col("_range") == r["_range"]) & (F.col("_place") >= low - r.before) & (F.col("_place") < low + per_page - r.before))
        rows = spark.read.parquet(f"{self.path}/rows").where(test).drop("_range", "_place")
        return rows.orderBy(*ordering(self.keys))
