"""Catalogue build: sources, id resolution, page extraction, outcomes, upsert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuedir.operators import ledger as outcomes_
from venuedir.operators import pages as pages_
from venuedir.operators.filters import MIN_PAGE_CHARS
from venuedir.operators.ledger import DEFAULT_KEY
from venuedir.operators.replay import latest
from venuedir.operators.resolve import keep_known_ids, resolve
from venuedir.operators.skew import lookup
from venuedir.session import shared_dir

# Source field -> catalogue column. Fixed values.
OWN_FIELDS = {
    "domain": "ccf_domain", "level": "ccf_level", "abbr": "ccf_abbr", "full": "ccf_full",
    "publisher": "ccf_publisher", "url": "ccf_url",
}


@dataclass(frozen=True)
class Build:
    entries: DataFrame   # journals read in this run, catalogue columns
    outcomes: DataFrame  # ledger rows of this run
    rejected: DataFrame  # unusable pages with the reason


def build_journals(catalogue: DataFrame, older_metrics: DataFrame, candidates: DataFrame,
                   pages: DataFrame, ledger: DataFrame | None = None,
                   min_chars: int = MIN_PAGE_CHARS) -> Build:
    """One run over ``catalogue(domain, abbr, full, level, publisher, url[, known_id])``.

    Rows done before are skipped, ids are resolved, the pages of those ids are read.
    The two stages that several outputs share, resolution and extraction, are written
    once to the shared folder and read back from there.
    """
    spark = catalogue.sparkSession
    stage = shared_dir(spark, "build")
    key = list(DEFAULT_KEY)

    work = catalogue.withColumn("type", F.lit("journal"))
    if ledger is not None:
        work = outcomes_.remaining(work, ledger)
    resolved = resolve(outcomes_.with_issn(work, older_metrics), candidates)
    if "known_id" in catalogue.columns:
        resolved = keep_known_ids(resolved)
    # '0' stands for "no id" wherever ids are kept.
    resolved = resolved.withColumn("journalid", F.nullif("journalid", F.lit("0")))
    resolved.write.parquet(f"{stage}/resolved")
    resolved = spark.read.parquet(f"{stage}/resolved")

    wanted = resolved.select("journalid").where(F.col("journalid").isNotNull()).distinct()
    ids = pages.withColumn("journalid", F.regexp_extract("url", r"journalid=(\d+)", 1))
    own_pages = ids.join(wanted, "journalid", "left_semi").select(*pages.columns)
    records = pages_.typed_fields(pages_.extract_text(own_pages, min_chars))
    records.write.parquet(f"{stage}/records")
    records = spark.read.parquet(f"{stage}/records")

    good = records.where(F.col("reject_reason").isNull())
    one_page = latest(good, ["journalid"], F.desc("page_id")).drop("page_id", "reject_reason")
    # The extracted name decides the outcome; a page that never parsed has none.
    attempts = lookup(resolved, one_page.select("journalid", "name"), ["journalid"])
    outcomes = outcomes_.outcomes(
        attempts.select(*key, "journalid", "method", "name", F.current_timestamp().alias("ts")))

    own = resolved.select("type", "journalid", *[
        F.coalesce(F.col(f), F.lit("")).alias(c) for f, c in OWN_FIELDS.items()])
    entries = outcomes_.merge_extracted(own, one_page)
    rejected = records.where(F.col("reject_reason").isNotNull()).select(
        "page_id", F.col("letpub_url").alias("url"), F.col("reject_reason").alias("reason"))
    return Build(entries, outcomes, rejected)
