"""The list request: filter, count, sort, page, annotate."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row

from venuedir import schema
from venuedir.functions.clean import parse_items
from venuedir.operators import annotations, filters, paging
from venuedir.operators.owners import Owner


@dataclass(frozen=True)
class VenueQuery:
    """One list request. Lists are comma-separated text, as in a request string."""

    type: str = ""
    domain: str = ""
    level: str = ""
    cas_zone: str = ""
    q: str = ""
    sort: str = ""
    order: str = ""
    page: int = 1
    per_page: int = 20
    device_id: str = ""
    user_id: int | str | None = None
    favorites: bool = False
    top: bool = False
    tag: str = ""
    # Zone filters on the other systems: {"xinrui": "1,2", "wos_zone": "1"}.
    zones: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        paging.check_page(self.sort, self.order, self.page, self.per_page)

    @property
    def owner(self) -> Owner | None:
        return Owner.of(self.user_id, self.device_id)

    def predicate(self) -> Column:
        """Conjunction of the filters on entry columns."""
        parts = []
        if self.type:
            parts.append(filters.of_type(self.type))
        if domains := parse_items(self.domain):
            parts.append(filters.in_domains(domains))
        if levels := parse_items(self.level):
            parts.append(filters.in_levels(levels))
        for system, text in {"cas2025": self.cas_zone, **self.zones}.items():
            if wanted := parse_items(text):
                parts.append(filters.in_zones(wanted, system))
        if self.q:
            parts.append(filters.matches_keyword(self.q))
        if self.top:
            parts.append(filters.is_top())
        return filters.all_of(parts)


def matching(entries: DataFrame, query: VenueQuery, favorites: DataFrame | None = None) -> DataFrame:
    """Entries that pass every filter.

    ``favorites`` without an identity adds no filter, and ``tag`` counts only
    together with ``favorites``.
    """
    rows = entries.where(query.predicate())
    if query.favorites and query.owner is not None:
        rows = filters.keep_favorites(rows, favorites, query.owner, query.tag)
    return rows


def page(entries: DataFrame, query: VenueQuery, favorites: DataFrame | None = None,
         notes: DataFrame | None = None, after: dict[str, Any] | None = None) -> DataFrame:
    """The requested page with annotations, in page order.

    The limit comes before the annotation joins: they then see at most a hundred
    rows. ``after`` switches to keyset paging for deep pages.
    """
    rows = matching(entries, query, favorites).select(*schema.LIST_COLUMNS)
    cut = _cut(rows, query, after)
    annotated = annotations.annotate(cut, favorites, notes, query.owner)
    return annotated.orderBy(*paging.ordering(paging.sort_keys(query.sort, query.order)))


def _cut(rows: DataFrame, query: VenueQuery, after: dict[str, Any] | None) -> DataFrame:
    if after is not None:
        return paging.take_page_after(rows, after, query.sort, query.order, query.per_page)
    return paging.take_page(rows, query.sort, query.order, query.page, query.per_page)


@dataclass(frozen=True)
class Page:
    data: list[Row]
    total: int
    page: int
    per_page: int
    total_pages: int


def fetch_page(entries: DataFrame, query: VenueQuery, favorites: DataFrame | None = None,
               notes: DataFrame | None = None) -> Page:
    """Run a request: one count of the filtered rows, one top-k.

    The count reads the filter columns only. It is a job of its own and not an
    observed metric of the top-k, because a retried stage would observe rows twice.
    The page (at most a hundred rows) is what reaches the driver.
    """
    total = matching(entries, query, favorites).count()
    data = page(entries, query, favorites, notes).collect()
    return Page(data, total, query.page, query.per_page, -(-total // query.per_page))
