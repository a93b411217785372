"""Worklists, outcomes and result upserts of a catalogue build.

The key is configurable; the default keeps equal abbreviations of different
domains apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuedir.operators.replay import latest
from venuedir.operators.skew import lookup

DEFAULT_KEY = ("type", "domain", "abbr")

SUCCESS, NOT_FOUND, PARSE_FAILED = "success", "not_found", "parse_failed"


def with_issn(catalogue: DataFrame, older_metrics: DataFrame, on: str = "abbr") -> DataFrame:
    """Add ``issn`` from older metrics, ``''`` where there is none."""
    metrics = older_metrics.groupBy(on).agg(F.max("issn").alias("_issn"))
    joined = lookup(catalogue, metrics, [on])
    return joined.select(*catalogue.columns, F.coalesce("_issn", F.lit("")).alias("issn"))


def remaining(worklist: DataFrame, ledger: DataFrame,
              keys: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """Worklist rows without a successful outcome."""
    done = ledger.where(F.col("status") == SUCCESS).select(*keys)
    return worklist.join(done, list(keys), "left_anti").select(*worklist.columns)


def outcomes(attempts: DataFrame, keys: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """Ledger rows of attempts ``(keys, journalid, method, name, ts)``.

    ``name`` is the name read from the page: an empty one means the page did not parse.
    """
    no_id = F.coalesce("journalid", F.lit("")).isin("", "0")
    no_page = F.coalesce("name", F.lit("")) == ""
    status = F.when(no_id, NOT_FOUND).when(no_page, PARSE_FAILED).otherwise(SUCCESS)
    known = F.when(~no_id, F.col("journalid"))
    return attempts.select(
        *keys, status.alias("status"), known.alias("journalid"),
        F.when(status == SUCCESS, F.col("method")).alias("method"), "ts")


def current_ledger(ledger: DataFrame, keys: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """The standing outcome per key: a success stays, else the newest failure."""
    failed = F.col("status") != SUCCESS
    return latest(ledger, list(keys), failed.asc(), F.desc("ts"), F.asc("status"))


def run_summary(ledger: DataFrame) -> DataFrame:
    """Keys per outcome: ``(status, n)``."""
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def merge_extracted(catalogue: DataFrame, extracted: DataFrame, on: str = "journalid") -> DataFrame:
    """Catalogue fields with the fields read from the page; on a name clash the page wins."""
    shared = [c for c in catalogue.columns if c in extracted.columns and c != on]
    own = catalogue.withColumnsRenamed({c: f"_old_{c}" for c in shared})
    joined = lookup(own, extracted, [on], "inner")
    merged = [F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in shared]
    rest = [c for c in [*catalogue.columns, *extracted.columns] if c not in shared and c != on]
    return joined.select(on, *merged, *dict.fromkeys(rest))


def upsert_results(results: DataFrame, new: DataFrame, version: str = "ts",
                   keys: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """Replace results by key, append the rest; of several new rows the newest counts."""
    order = [F.desc("_new"), F.desc(version)]
    rows = results.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(rows, list(keys), *order).drop("_new")
