"""Detail views: nested values of an entry as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions.clean import fixed_decimals
from venuedir.operators import filters
from venuedir.operators.owners import Owner, rows_of

# Partition versions in display order, and the metrics of the panel with their
# decimals (None: whole numbers as they are). Fixed values.
PARTITION_VERSIONS = {"xinrui": "新锐 2026", "cas2025": "中科院 2025", "cas2023": "中科院 2023"}
PANEL_METRICS = {
    "impact_factor": 2, "five_year_if": 2, "realtime_if": 2, "cite_score": 2,
    "h_index": None, "jci_value": 2, "article_count": None, "letpub_score": 1,
}


def entry_detail(entries: DataFrame, favorites: DataFrame, entry_id: int,
                 owner: Owner | None = None) -> DataFrame:
    """The full row of one entry with ``is_favorite`` for the owner; no row when unknown."""
    entry = filters.by_id(entries, entry_id).select(*schema.ENTRY_COLUMNS)
    if owner is None:
        return entry.withColumn("is_favorite", F.lit(False))
    own = rows_of(favorites, owner).where(F.col("entry_id") == entry_id)
    hit = own.select("entry_id").distinct()
    marked = entry.join(hit, F.col("id") == F.col("entry_id"), "left")
    return marked.select(*entry.columns, F.col("entry_id").isNotNull().alias("is_favorite"))


def partition_comparison(entries: DataFrame) -> DataFrame:
    """Three rows per entry, one per partition version; fields are NULL where there is no data."""
    versions = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(label).alias("version"),
            F.col(column).isNotNull().alias("has_data"),
            *[F.col(f"{column}.{f}").alias(f)
              for f in ("bigZone", "bigCategory", "smallZone", "smallCategory")],
            F.coalesce(F.col(f"{column}.isTop"), F.lit(False)).alias("isTop"),
        )
        for i, (column, label) in enumerate(PARTITION_VERSIONS.items())
    ])
    return entries.select("id", F.inline(versions))


def _rankings(entries: DataFrame, column: str) -> DataFrame:
    rows = entries.select("id", F.posexplode(column).alias("position", "_r"))
    return rows.select("id", "position", "_r.*")


def jif_rankings(entries: DataFrame) -> DataFrame:
    return _rankings(entries, "jif")


def jci_rankings(entries: DataFrame) -> DataFrame:
    return _rankings(entries, "jci_json")


def citescore_rankings(entries: DataFrame) -> DataFrame:
    return _rankings(entries, "citescore_rankings")


def metric_panel(entries: DataFrame) -> DataFrame:
    """Eight rows ``(id, metric, value, display)`` per entry; NULL display where unknown."""
    cards = F.array(*[
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(metric).cast("double").alias("value"),
            (F.col(metric).cast("string") if digits is None
             else F.when(F.col(metric).isNotNull(), fixed_decimals(F.col(metric), digits))
             ).alias("display"),
        )
        for metric, digits in PANEL_METRICS.items()
    ])
    return entries.select("id", F.inline(cards))
