"""Facet counts of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuedir.functions.zones import zone_bucket

JOURNAL = "journal"


def type_totals(entries: DataFrame) -> DataFrame:
    """One row: ``total_journals, total_conferences``."""
    return entries.agg(
        F.count_if(F.col("type") == JOURNAL).alias("total_journals"),
        F.count_if(F.col("type") == "conference").alias("total_conferences"),
    )


def count_by(entries: DataFrame, column: str) -> DataFrame:
    return entries.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def domain_counts(entries: DataFrame) -> DataFrame:
    return count_by(entries, "ccf_domain")


def level_counts(entries: DataFrame) -> DataFrame:
    return count_by(entries, "ccf_level").orderBy("ccf_level")


def zone_buckets(entries: DataFrame) -> DataFrame:
    """Journals per zone; everything outside the four zones is "not partitioned"."""
    journals = entries.where(F.col("type") == JOURNAL)
    zoned = journals.select(zone_bucket(F.col("cas2025")).alias("zone"))
    return zoned.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


def all_facets(entries: DataFrame) -> DataFrame:
    """All facets as rows ``(dimension, key, n)`` from one scan.

    The scan is combined to one row per (type, domain, level, zone) before anything
    is multiplied, so the four-fold expansion touches combinations and not entries.
    """
    cells = entries.select(
        "type", "ccf_domain", "ccf_level", zone_bucket(F.col("cas2025")).alias("zone")
    ).groupBy("type", "ccf_domain", "ccf_level", "zone").agg(F.count(F.lit(1)).alias("cell"))
    facets = F.array(
        F.struct(F.lit("type").alias("dimension"), F.col("type").alias("key")),
        F.struct(F.lit("domain").alias("dimension"), F.col("ccf_domain").alias("key")),
        F.struct(F.lit("level").alias("dimension"), F.col("ccf_level").alias("key")),
        F.struct(
            F.when(F.col("type") == JOURNAL, "cas_zone").alias("dimension"),
            F.col("zone").alias("key"),
        ),
    )
    rows = cells.select("cell", F.inline(facets)).where("dimension is not null")
    return rows.groupBy("dimension", "key").agg(F.sum("cell").alias("n"))
