"""Filters, sort rules and paging."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from parity import derived
from venuedir.operators import annotations, details, facets, filters, paging
from venuedir.operators.owners import Owner
from venuedir.plans.list_query import VenueQuery, fetch_page, matching, page


@pytest.fixture(scope="module")
def entries(spark):
    rows = derived.entries(spark, SMALL).cache()
    yield rows
    rows.unpersist()


@pytest.fixture(scope="module")
def favorites(spark):
    rows = [("user", "1", 5, ["a%", "Deep"], 2), ("user", "1", 6, [], 1), ("user", "2", 5, ["x"], 3),
            ("device", "d", 7, ["deep"], 4)]
    df = spark.createDataFrame(rows, "owner_kind string, owner_id string, entry_id long, tags array<string>, t long")
    return df.withColumn("created_at", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t").cache()


@pytest.fixture(scope="module")
def notes(spark):
    rows = [("user", "1", 5, "mine"), ("user", "1", 9, ""), ("device", "d", 5, "guest")]
    df = spark.createDataFrame(rows, "owner_kind string, owner_id string, entry_id long, content string")
    return df.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz")).cache()


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("bad", [
    {"sort": "nope"}, {"order": "up"}, {"page": 0}, {"per_page": 0}, {"per_page": 101}])
def test_validation(bad):
    with pytest.raises(ValueError):
        VenueQuery(**bad)


def test_unknown_zone_system():
    with pytest.raises(ValueError):
        VenueQuery(zones={"other": "1"}).predicate()


@pytest.mark.parametrize("sort, order, way", [
    ("", "", "asc"), ("name", "", "asc"), ("ccf_level", "", "asc"), ("h_index", "", "desc"),
    ("h_index", "asc", "asc"), ("", "desc", "desc")])
def test_default_direction(sort, order, way):
    assert paging.direction(sort, order) == way


def test_direction_of_the_default_sort_binds_to_the_abbreviation(entries):
    rows = page(entries, VenueQuery(order="desc", per_page=100)).collect()
    keys = [(r.ccf_level, r.ccf_abbr) for r in rows]
    levels = [k[0] for k in keys]
    assert levels == sorted(levels)
    for level in set(levels):
        abbrs = [a for lv, a in keys if lv == level]
        assert abbrs == sorted(abbrs, reverse=True)


@pytest.mark.parametrize("sort", ["", *paging.SORT_COLUMNS])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_and_keyset_pages_tile_the_sorted_rows(entries, sort, order):
    small = entries.where("id < 60")
    keys = paging.sort_keys(sort, order)
    everything = ids(small.orderBy(*paging.ordering(keys)))
    numbered = [i for n in range(1, 4) for i in ids(paging.take_page(small, sort, order, n, 25))]
    assert numbered == everything
    walked, last = [], None
    while True:
        rows = (paging.take_page(small, sort, order, 1, 25) if last is None
                else paging.take_page_after(small, last, sort, order, 25)).collect()
        if not rows:
            break
        walked += [r.id for r in rows]
        last = rows[-1].asDict()
    assert walked == everything


def test_nulls_first_ascending_and_last_descending(entries):
    up = paging.take_page(entries, "impact_factor", "asc", 1, 100).collect()
    assert up[0].impact_factor is None
    down = paging.take_page(entries, "impact_factor", "desc", 1, 100).collect()
    assert down[0].impact_factor is not None


def test_page_past_the_end_keeps_the_total(entries):
    got = fetch_page(entries, VenueQuery(page=999, per_page=100))
    assert (got.data, got.total, got.total_pages) == ([], 200, 2)


def test_zone_spellings(entries):
    a = matching(entries, VenueQuery(cas_zone="1"))
    b = matching(entries, VenueQuery(cas_zone=" 1区 ,"))
    assert set(ids(a)) == set(ids(b)) != set()


def test_favorites_filters(entries, favorites):
    def found(**kw):
        return set(ids(matching(entries, VenueQuery(**kw), favorites)))

    assert found(user_id=1, favorites=True) == {5, 6}
    assert found(device_id="d", favorites=True) == {7}
    assert found(user_id=1, device_id="d", favorites=True) == {5, 6}  # the user wins
    assert found(user_id=1, favorites=True, tag="dEEP") == {5}
    assert found(user_id=1, favorites=True, tag="a%") == {5}
    assert found(user_id=1, favorites=True, tag="ee") == set()  # whole element, not a part
    assert len(found(favorites=True)) == 200  # no identity, no filter
    assert len(found(user_id=1, tag="deep")) == 200  # tag without favorites is ignored


def test_annotations_of_a_page(entries, favorites, notes):
    query = VenueQuery(user_id=1, sort="name", per_page=100)
    small = entries.where("id < 12")
    rows = {r.id: r for r in page(small, query, favorites, notes).collect()}
    assert (rows[5].tags, rows[5].note, rows[5].is_favorite) == (["a%", "Deep"], "mine", True)
    assert (rows[6].tags, rows[6].note, rows[6].is_favorite) == ([], "", True)
    assert (rows[7].tags, rows[7].note, rows[7].is_favorite) == ([], "", False)
    nobody = {r.id: r for r in page(small, VenueQuery(per_page=100)).collect()}
    assert (nobody[5].tags, nobody[5].note, nobody[5].is_favorite) == ([], "", False)


def test_identity_is_required_for_lists():
    with pytest.raises(ValueError):
        Owner.required()
    assert Owner.required(device_id="d") == Owner("device", "d")
    assert Owner.of(user_id=3, device_id="d") == Owner("user", "3")


def test_facets_add_up(entries):
    rows = facets.all_facets(entries).collect()
    totals = {}
    for r in rows:
        totals[r.dimension] = totals.get(r.dimension, 0) + r.n
    journals = entries.where("type = 'journal'").count()
    assert totals == {"type": 200, "domain": 200, "level": 200, "cas_zone": journals}


def test_detail(entries, favorites):
    row = details.entry_detail(entries, favorites, 5, Owner("user", "1")).first()
    assert row.is_favorite and row.id == 5 and len(row) == 44
    assert details.entry_detail(entries, favorites, 10**6).first() is None
    assert not details.entry_detail(entries, favorites, 7, Owner("user", "1")).first().is_favorite


def test_empty_partition_is_data_without_fields(spark, entries):
    rows = details.partition_comparison(entries).where("version = '中科院 2023' and has_data and smallZone is null")
    assert rows.count() > 0


def test_blocked_pages(spark):
    df = spark.createDataFrame([("x" * 1000,), ("x" * 999,), ("过于频繁" + "x" * 2000,), ("x" * 500,)], "html string")
    html = F.col("html")
    flags = df.coalesce(1).select(filters.is_unusable_page(html), filters.is_unusable_page(html, 500)).collect()
    assert [tuple(f) for f in flags] == [(False, False), (True, False), (True, True), (True, False)]


def test_tag_lists(spark, favorites):
    defs = spark.createDataFrame([("1", "b", "red"), ("1", "a", "")], "user_id string, name string, color string")
    assert [r.name for r in annotations.list_tags(favorites, defs, Owner("user", "1")).collect()] == ["a", "b"]
    assert [r.name for r in annotations.list_tags(favorites, defs, Owner("device", "d")).collect()] == ["deep"]
