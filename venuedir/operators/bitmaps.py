"""Facet counts and totals of filtered entries from bitmaps, without reading entries.

Every value of every filter and facet has one bitmap per range of 32,768 positions. Values of one filter are
united, filters are intersected, and what is left is intersected with the facets and counted,
range by range. Positions are dense numbers in the order of the filter columns
(``catalogue.load_order_ids``), so that most ranges hold few values and empty bitmaps are not stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuedir.functions.clean import parse_items
from venuedir.functions.zones import zone_bucket, zone_text
from venuedir.operators.facets import JOURNAL
from venuedir.operators.filters import ZONE_SYSTEMS, is_top
from venuedir.operators.paging import check_page, total_pages
from venuedir.plans.list_query import VenueQuery

#: Order of positions: entries with equal values lie together.
POSITION_ORDER = ["type", "ccf_domain", "ccf_level", "id"]
#: Facets that :func:`facets.all_facets` counts; the other dimensions only filter.
FACETS = ("type", "domain", "level", "cas_zone")


def _dimensions() -> dict[str, Column]:
    zones = {f"zone:{name}": F.col(path) for name, path in ZONE_SYSTEMS.items()}
    return {
        "all": F.lit(""), "type": F.col("type"), "domain": F.col("ccf_domain"), "level": F.col("ccf_level"),
        "cas_zone": F.when(F.col("type") == JOURNAL, zone_bucket(F.col("cas2025"))),
        "top": F.when(is_top(), "true"), **zones,
    }


def facet_bitmaps(entries: DataFrame, position: str = "position") -> DataFrame:
    """``(dimension, key, range, bits)``: a row per value and range that holds it.

    A value that a third of all entries share has as many rows as ranges; bits are set by a combining aggregate.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("key")) for name, value in _dimensions().items()])
    rows = entries.select(F.bitmap_bucket_number(position).alias("range"), F.bitmap_bit_position(position).alias("_bit"), F.inline(pairs))
    return rows.where("key is not null").groupBy("dimension", "key", "range").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def position_bitmaps(positions: DataFrame, name: str, position: str = "position") -> DataFrame:
    """Any set of positions, such as an owner's favourites or the hits of a keyword, as one more filter."""
    return positions.groupBy(F.bitmap_bucket_number(position).alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")).select(
        F.lit(name).alias("dimension"), F.lit("true").alias("key"), "range", "bits")


def query_filters(query: VenueQuery) -> dict[str, list[str]]:
    """The wanted keys per dimension of a list request; keyword and favourites come as position sets."""
    wanted = {"type": [query.type] if query.type else [], "domain": parse_items(query.domain), "level": parse_items(query.level),
              "top": ["true"] if query.top else []}
    for system, text in {"cas2025": query.cas_zone, **query.zones}.items():
        wanted[f"zone:{system}"] = [zone_text(z) for z in parse_items(text)]
    return {name: keys for name, keys in wanted.items() if keys}


def selection(bitmaps: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """``(range, bits)`` of the positions that have one of the wanted keys in every dimension."""
    if not wanted:
        return bitmaps.where("dimension = 'all'").select("range", "bits")
    pairs = [(F.col("dimension") == name) & F.col("key").isin(list(keys)) for name, keys in wanted.items()]
    test = pairs[0]
    for pair in pairs[1:]:
        test = test | pair
    united = bitmaps.where(test).groupBy("range", "dimension").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = united.groupBy("range").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n"))
    return both.where(F.col("_n") == len(wanted)).select("range", "bits")


def filtered_facets(bitmaps: DataFrame, query: VenueQuery, *more: DataFrame) -> DataFrame:
    """``(dimension, key, n)`` as :func:`facets.all_facets` of the entries that pass the request and all further position sets."""
    chosen = _selected(bitmaps, query, more).select("range", F.col("bits").alias("_chosen"))
    facets = bitmaps.where(F.col("dimension").isin(*FACETS))
    rows = facets.join(chosen, "range").select("dimension", "key", "range", F.explode(F.array("bits", "_chosen")).alias("bits"))
    cells = rows.groupBy("dimension", "key", "range").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return cells.groupBy("dimension", "key").agg(F.sum("n").alias("n")).where("n > 0")


def filtered_envelope(bitmaps: DataFrame, query: VenueQuery, *more: DataFrame) -> DataFrame:
    """One row ``(total, page, per_page, total_pages)``, as :func:`paging.envelope` of the filtered entries."""
    check_page("", "", query.page, query.per_page)
    total = _selected(bitmaps, query, more).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("total"))
    return total.select("total", F.lit(query.page).alias("page"), F.lit(query.per_page).alias("per_page"),
                        total_pages(F.col("total"), query.per_page).alias("total_pages"))


def _selected(bitmaps: DataFrame, query: VenueQuery, more: Sequence[DataFrame]) -> DataFrame:
    wanted = query_filters(query)
    for k, one in enumerate(more):
        bitmaps = bitmaps.unionByName(one.withColumn("dimension", F.lit(f"set:{k}")))
        wanted[f"set:{k}"] = ["true"]
    return selection(bitmaps, wanted)
