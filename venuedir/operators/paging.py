"""Sorting and paging."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sort name of a request -> column. Fixed values.
SORT_COLUMNS = {
    "impact_factor": "impact_factor",
    "cite_score": "cite_score",
    "name": "ccf_abbr",
    "article_count": "article_count",
    "ccf_level": "ccf_level",
    "h_index": "h_index",
    "letpub_score": "letpub_score",
}
TEXT_SORTS = {"name", "ccf_level"}
ORDERS = {"asc", "desc"}
MAX_PER_PAGE = 100


def check_page(sort: str, order: str, page: int, per_page: int) -> None:
    if sort and sort not in SORT_COLUMNS:
        raise ValueError(f"sort must be one of {sorted(SORT_COLUMNS)}")
    if order and order not in ORDERS:
        raise ValueError("order must be asc or desc")
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"per_page must be between 1 and {MAX_PER_PAGE}")


def direction(sort: str, order: str) -> str:
    """Metrics default to descending, text sorts and the default sort to ascending."""
    if order:
        return order
    return "desc" if sort and sort not in TEXT_SORTS else "asc"


def sort_keys(sort: str = "", order: str = "") -> list[tuple[str, str]]:
    """``(column, direction)`` pairs, ending with ``id`` so that pages are stable.

    Without a sort name the order is level, then abbreviation, and the direction
    binds to the abbreviation only.
    """
    way = direction(sort, order)
    if not sort:
        return [("ccf_level", "asc"), ("ccf_abbr", way), ("id", "asc")]
    return [(SORT_COLUMNS[sort], way), ("id", "asc")]


def ordering(keys: list[tuple[str, str]]) -> list[Column]:
    """NULLs come first ascending and last descending, which is also Spark's default."""
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_first()
            for c, way in keys]


def take_page(rows: DataFrame, sort: str = "", order: str = "", page: int = 1,
              per_page: int = 20) -> DataFrame:
    """Page by number: one top-k of ``page * per_page`` rows, no full sort.

    Each task keeps that many rows, so deep pages should use :func:`take_page_after`.
    """
    check_page(sort, order, page, per_page)
    ordered = rows.orderBy(*ordering(sort_keys(sort, order)))
    return ordered.offset((page - 1) * per_page).limit(per_page)


def _after(column: str, way: str, value: Any) -> Column:
    """Rows strictly behind ``value`` in one sort key, NULL placement included."""
    col = F.col(column)
    if way == "asc":
        return col.isNotNull() if value is None else col > F.lit(value)
    return F.lit(False) if value is None else (col < F.lit(value)) | col.isNull()


def after_row(keys: list[tuple[str, str]], last: dict[str, Any]) -> Column:
    """Rows that sort behind the row ``last`` (lexicographic over the sort keys)."""
    result, tied = F.lit(False), F.lit(True)
    for column, way in keys:
        result = result | (tied & _after(column, way, last[column]))
        tied = tied & F.col(column).eqNullSafe(F.lit(last[column]))
    return result


def take_page_after(rows: DataFrame, last: dict[str, Any], sort: str = "", order: str = "",
                    per_page: int = 20) -> DataFrame:
    """Page that follows the row ``last``: a filter and a top-k of ``per_page`` at any depth."""
    check_page(sort, order, 1, per_page)
    keys = sort_keys(sort, order)
    return rows.where(after_row(keys, last)).orderBy(*ordering(keys)).limit(per_page)


def total_pages(total: Column, per_page: int) -> Column:
    return F.ceil(total / F.lit(per_page)).cast("long")


def envelope(filtered: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One row ``(total, page, per_page, total_pages)`` for the filtered rows."""
    check_page("", "", page, per_page)
    counted = filtered.agg(F.count(F.lit(1)).alias("total"))
    return counted.select("total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
                          total_pages(F.col("total"), per_page).alias("total_pages"))
