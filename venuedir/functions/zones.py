"""Partition zones, TOP flags and index categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions.text import remove_first

# Fixed values.
ZONE_SUFFIX = "区"
NO_ZONE = "未分区"
ZONES = ["1区", "2区", "3区", "4区"]
SYSTEM_PREFIXES = ["中科院", "新锐"]
SCIE_PAGE_PHRASE = "被最新的JCR期刊SCIE收录"


def decode_partition(json_text: Column) -> Column:
    """JSON text to a partition struct; NULL on NULL or bad JSON, all-NULL fields on ``{}``."""
    return F.from_json(json_text, schema.PARTITION)


def big_zone(json_text: Column) -> Column:
    """``bigZone`` of a JSON text, ``''`` when it is missing or unreadable."""
    return F.coalesce(decode_partition(json_text)["bigZone"], F.lit(""))


def top_flag(json_text: Column) -> Column:
    """``isTop`` of a JSON text, false when it is missing or unreadable."""
    return F.coalesce(decode_partition(json_text)["isTop"], F.lit(False))


def is_top_venue(cas2025: Column, xinrui: Column) -> Column:
    """TOP in either of two decoded partitions."""
    return F.coalesce(cas2025["isTop"], F.lit(False)) | F.coalesce(xinrui["isTop"], F.lit(False))


def zone_bucket(partition: Column) -> Column:
    """The zone when it is one of the four, else the "not partitioned" label."""
    zone = partition["bigZone"]
    return F.when(zone.isin(ZONES), zone).otherwise(NO_ZONE)


def zone_number(col: Column) -> Column:
    """First digit 1-4 of labels such as ``1区``, ``Q1``, ``JCR1区``."""
    return F.regexp_extract(col, "([1-4])", 1)


def zone_label(col: Column) -> Column:
    """Label without the name of its zone system (first occurrence of each)."""
    for prefix in SYSTEM_PREFIXES:
        col = remove_first(col, prefix)
    return col


def zone_text(zone: str) -> str:
    """``'1'`` and ``'1区'`` name the same zone."""
    return zone.removesuffix(ZONE_SUFFIX) + ZONE_SUFFIX


def index_category(cell: Column, html: Column) -> Column:
    """Citation index named in a cell, else implied by a phrase of the page, else ``''``."""
    choice = F
    for name in ("SCIE", "SSCI", "ESCI"):
        choice = choice.when(cell.contains(name), name)
    return choice.when(html.contains(SCIE_PAGE_PHRASE), "SCIE").otherwise("")
