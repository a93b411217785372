"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as driver
from parity import REGISTRY, derived
from venuedir.operators import facets, ledger, paging, replay

QUERIES = driver.queries()
EAGER = {"stored_entries", "stored_entries_filtered", "exported_entries", "stream_replay", "stream_replay_notes", "build_catalogue", "build_outcomes", "build_rejects",
         "merge_logins_notes", "merge_notes_many_users"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - EAGER))
def test_no_python_and_no_nested_loop(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("PythonUDF", "EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text


def test_page_is_a_top_k(spark):
    text = plan(paging.take_page(derived.entries(spark, SMALL), "h_index", "", 3, 20))
    assert "TakeOrderedAndProject(limit=60, offset=40" in text and "Exchange" not in text


def test_one_scan_for_all_facets(spark):
    text = plan(facets.all_facets(derived.entries(spark, SMALL)))
    assert text.count("FileScan") == 1 and "Expand" not in text


def test_latest_cuts_groups_before_the_shuffle(spark):
    text = plan(replay.replay_notes(derived.operations(spark, SMALL)))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_scan_reads_only_the_columns_of_a_filter(spark):
    text = plan(QUERIES["filter_domain_level"](spark, SMALL))
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string,p_size:int>" in text
    assert "PushedFilters: [In(p_type, [ECONOMY,PROMO])" in text


def test_owner_reaches_every_scan_of_the_replay(spark):
    """Two reads of the log, and both are cut to the owner's rows by the scan's filters."""
    own = derived.operations(spark, SMALL)
    got = replay.replay_favorites(own).where("owner_kind = 'user' and owner_id = '2'")
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 2 and text.count("= 2)") == 2
    assert "approx_top_k" not in text and "Window" not in text


@pytest.fixture
def settings(spark):
    """Set SQL settings for one test."""
    before = {}

    def change(values: dict[str, str]) -> None:
        for key, value in values.items():
            before[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_lookup_splits_a_skewed_side(spark, settings):
    """A third of the rows share one key; the join with an aggregated table is cut."""
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128KB",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"})
    n = 200_000
    big = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("abbr"),
        F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    small = spark.range(500).select(F.col("id").cast("string").alias("abbr"), F.lit("1").alias("issn")).union(
        spark.createDataFrame([("hot", "7")], "abbr string, issn string"))
    joined = ledger.with_issn(big, small)
    counted = joined.agg(F.count_if(F.col("issn") == "7").alias("h"), F.count("*").alias("n"), F.max("pad"))
    row = counted.collect()[0]
    assert (row.h, row.n) == (len(range(0, n, 3)), n)
    assert "SortMergeJoin(skew=true)" in plan(counted)
