"""Keyword index, facet bitmaps, ranked rows and dense ids: plans and odd rows."""

from __future__ import annotations

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from parity import derived as d
from venuedir.operators import bitmaps, facets, filters
from venuedir.operators.keyword_index import KeywordIndex, grams, keyword_grams
from venuedir.operators.ranks import RankedRows
from venuedir.plans.list_query import VenueQuery, matching
from venuedir.sources import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(1)
    letters = ["a", "B", "é", "😀", "%", "_", "\\", "\n", "'", "期"]
    def text():
        return rng.choice([None, "", "ab", "".join(rng.choice(letters) for _ in range(rng.randint(3, 30)))])
    rows = [(i, text(), text(), text()) for i in range(300)] + [(900, "x", "ab😀é" * 4000 + "end", None)]
    return spark.createDataFrame(rows, "id long, ccf_abbr string, ccf_full string, ccf_publisher string")


@pytest.fixture(scope="module")
def index(names, tmp_path_factory):
    made = KeywordIndex(str(tmp_path_factory.mktemp("index")), buckets=4)
    made.build(names)
    return made


@pytest.mark.parametrize("text", ["ab", "AB", "abé", "é😀%", "b\\_", "_%'", "期期a", "not there", "\n\n\n", "éend", "", "A%b"])
def test_index_equals_the_scan(names, index, text):
    want = {r.id for r in names.where(filters.matches_keyword(text)).collect()}
    assert {r.id for r in index.search(names, text).collect()} == want


def test_grams(spark):
    row = spark.sql("select 'ABabA' as t, '😀é' as s, cast(null as string) as n").select(*[grams(F.col(c)) for c in "tsn"]).first()
    assert sorted(row[0]) == keyword_grams("ABABA") == ["aba", "bab"] and list(row[1]) == [] and not row[2]


def test_search_reads_one_posting_partition(spark, names, index):
    text = plan(index.candidates(spark, "ab😀"))
    assert "PartitionFilters: [isnotnull(bucket" in text and "PushedFilters: [IsNotNull(gram), EqualTo(gram" in text
    searched = plan(index.matching_ids(spark, "ab😀é"))
    assert "Cartesian" not in searched and "NestedLoop" not in searched


QUERIES = [VenueQuery(), VenueQuery(type="journal"), VenueQuery(level="A,C", zones={"xinrui": "2,3"}), VenueQuery(top=True, cas_zone="1"),
           VenueQuery(domain="nothing"), VenueQuery(level="B", type="conference", cas_zone="1")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = catalogue.load_order_ids(d.entries(spark, SMALL), bitmaps.POSITION_ORDER, "position", first=0)
    rows = rows.withColumn("position", F.col("position") * 700)  # over several ranges
    path = str(tmp_path_factory.mktemp("bitmaps"))
    bitmaps.facet_bitmaps(rows).write.parquet(f"{path}/b")
    return spark.read.parquet(f"{path}/b"), rows


@pytest.mark.parametrize("query", QUERIES)
def test_bitmaps_equal_the_scan(spark, stored, query):
    kept = matching(d.entries(spark, SMALL), query)
    want = {(r.dimension, r.key, r.n) for r in facets.all_facets(kept).collect()}
    got = bitmaps.filtered_facets(stored[0], query)
    assert {(r.dimension, r.key, r.n) for r in got.collect()} == want
    assert bitmaps.filtered_envelope(stored[0], query).first().total == kept.count()
    assert "part.parquet" not in plan(got)


def test_bitmaps_with_further_sets(spark, stored):
    few, many = [stored[1].where(t) for t in ("id % 7 < 3", "id % 2 = 0")]
    got = bitmaps.filtered_envelope(stored[0], VenueQuery(type="journal"), *[bitmaps.position_bitmaps(s, "s") for s in (few, many)])
    assert got.first().total == stored[1].where("type = 'journal' and id % 7 < 3 and id % 2 = 0").count()
    assert bitmaps.filtered_envelope(stored[0], VenueQuery(), bitmaps.position_bitmaps(few.where("false"), "s")).first().total == 0


@pytest.mark.parametrize("sort,order", [("impact_factor", ""), ("cite_score", "asc"), ("", "desc"), ("name", "")])
def test_ranked_pages(spark, tmp_path, sort, order):
    from venuedir.operators.paging import ordering, sort_keys
    rows = d.entries(spark, SMALL).select("id", "ccf_level", "ccf_abbr", "impact_factor", "cite_score")
    ranked = RankedRows(str(tmp_path / "r"), sort, order)
    ranked.build(rows, range_rows=33)
    want = [r.id for r in rows.orderBy(*ordering(sort_keys(sort, order))).collect()]
    for page, size in ((1, 100), (2, 30), (3, 50), (7, 30), (1000, 100)):
        got = ranked.page(spark, page, size)
        assert [r.id for r in got.collect()] == want[(page - 1) * size:page * size]
    assert "PartitionFilters: [" in plan(ranked.page(spark, 2, 30)) and "_place" in plan(ranked.page(spark, 2, 30)).split("PushedFilters")[1]


def test_dense_ids(spark):
    rows = spark.createDataFrame([(k % 5 if k % 11 else None, k) for k in range(200)], "a int, b int")
    got = catalogue.load_order_ids(rows, ["a", "b"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 201))
    assert [(r.a, r.b) for r in got] == sorted([(r.a, r.b) for r in got], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert catalogue.load_order_ids(rows.where("false"), ["a"]).count() == 0


def test_load_if_empty(spark, tmp_path):
    rows = d.entries(spark, SMALL)
    for name in ("missing", "folder"):
        path = tmp_path / name
        if name == "folder":
            path.mkdir()
        assert catalogue.load_if_empty(rows.where("id < 10"), str(path)) is True
        assert catalogue.load_if_empty(rows, str(path)) is False
        assert catalogue.read_entries(spark, str(path)).count() == rows.where("id < 10").count()


@pytest.fixture
def written(monkeypatch):
    """The frames written as Parquet during a test, by the last part of their path."""
    from pyspark.sql.readwriter import DataFrameWriter
    frames, parquet = {}, DataFrameWriter.parquet

    def record(self, path, *rest, **more):
        frames[path.rsplit("/", 1)[1]] = self._df
        return parquet(self, path, *rest, **more)
    monkeypatch.setattr(DataFrameWriter, "parquet", record)
    return frames


def test_trigrams_are_made_once_and_in_many_tasks(names, tmp_path, written):
    KeywordIndex(str(tmp_path / "i"), buckets=4).build(names.coalesce(1))
    text = written["postings"]._jdf.queryExecution().optimizedPlan().toString()
    # no range shuffle, whose bounds need a pass of their own; texts are spread below the explosion
    assert "gram" in text and text.index("RebalancePartitions") < text.index("Generate") < text.index("RepartitionByExpression")


def test_ranked_rows_are_spread_before_they_are_sorted_into_ranges(spark, tmp_path, written):
    rows = spark.range(12_000, numPartitions=1).selectExpr("id", "cast(id % 7 as double) as impact_factor")
    ranked = RankedRows(str(tmp_path / "r"), "impact_factor", "asc")
    ranked.build(rows, range_rows=5000)
    text = plan(written["rows"])
    assert "rangepartitioning" in text and "hashpartitioning" in text.split("rangepartitioning")[1]
    assert [r.id for r in ranked.page(spark, 2, 3).collect()] == [21, 28, 35]
