"""Import records to catalogue rows, and the catalogue table on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions import clean
from venuedir.session import shared_dir

NATURAL_KEY = ["type", "ccf_domain", "ccf_abbr", "ccf_full"]
CONFERENCE_FIELDS = {
    "domain": "ccf_domain", "level": "ccf_level", "abbr": "ccf_abbr", "full": "ccf_full",
    "publisher": "ccf_publisher", "url": "ccf_url",
}


def _nested(field: str, column: str) -> Column:
    """JSON text to the column's type. ``null`` and ``""`` are NULL, ``{}`` and ``[]`` stay."""
    return F.from_json(clean.canonical_json(F.col(field)), schema.ENTRY[column].dataType)


def journal_rows(records: DataFrame) -> DataFrame:
    """Journal import records to catalogue columns.

    The catalogue's own six fields default to ``''``; in the others ``''`` and ``'-'``
    mean NULL. Numbers (VARIANT) may be numbers or texts with a leading number.
    """
    own = set(schema.REQUIRED_TEXT) | set(schema.DEFAULTED_TEXT)
    columns = {"type": F.lit("journal")}
    for field, column in schema.JOURNAL_TEXT_FIELDS.items():
        text = F.col(field)
        columns[column] = F.coalesce(text, F.lit("")) if column in own else clean.null_sentinel(text)
    for field, column in schema.JOURNAL_NUMBER_FIELDS.items():
        parse = clean.json_int if column in schema.INT_METRICS else clean.json_double
        columns[column] = parse(F.col(field))
    for field, column in schema.JOURNAL_NESTED_FIELDS.items():
        columns[column] = _nested(field, column)
    return records.select(*[c.alias(n) for n, c in columns.items()])


def conference_rows(records: DataFrame) -> DataFrame:
    """Conference records to catalogue columns."""
    return records.select(
        F.lit("conference").alias("type"),
        *[F.coalesce(F.col(f), F.lit("")).alias(c) for f, c in CONFERENCE_FIELDS.items()])


def combine(journals: DataFrame, conferences: DataFrame) -> DataFrame:
    """One catalogue of both; columns a side lacks are NULL."""
    return journals.unionByName(conferences, allowMissingColumns=True)


def with_ids(entries: DataFrame) -> DataFrame:
    """Surrogate id from the natural key: the same row gets the same id in every load."""
    rows = entries.withColumn("id", F.xxhash64(*NATURAL_KEY))
    return rows.select(*[c for c in schema.ENTRY_COLUMNS if c in rows.columns])


def load_order_ids(rows: DataFrame, order: Sequence[str], column: str = "id", first: int = 1) -> DataFrame:
    """Dense ids ``first, first + 1, ...`` in the order of the columns ``order``, NULL first.

    Rows are range-partitioned and stored with their place inside the partition; ids are that
    place plus the counts of the partitions before. One number per partition meets in one task, never
    the rows. Rows that tie in ``order`` get neighbouring ids in any order.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order]
    path = shared_dir(spark, "load-order")
    # evaluated behind the sort: the partition's number in the high bits, the row's in the low 33
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    made = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + first
    return stored.join(starts, "_part").withColumn(column, made.cast("long")).drop("_part", "_place", "_before")


def duplicate_entries(entries: DataFrame) -> DataFrame:
    """``(id, n_rows, n_keys)`` of every id that more than one row bears.

    ``n_keys`` counts natural keys: 1 means that one entry was loaded several times, more that
    different entries share the id.
    """
    keys = entries.groupBy("id", *NATURAL_KEY).agg(F.count("*").alias("_n"))
    return keys.groupBy("id").agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_keys")).where("n_rows > 1")


def import_catalogue(journals: DataFrame, conferences: DataFrame) -> DataFrame:
    """Full catalogue rows of both kinds of import records."""
    return with_ids(combine(journal_rows(journals), conference_rows(conferences)))


def ensure_columns(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive migration: add missing columns, fill the default where older files have none."""
    return rows.withColumns({
        name: F.coalesce(F.col(name), default) if name in rows.columns else default
        for name, default in defaults.items()})


def _clustered(entries: DataFrame) -> DataFrame:
    """Range-partitioned so that files hold narrow ranges of the filter columns.

    ``id`` ends the key: a domain with much of the catalogue still spreads over tasks.
    """
    keys = ["type", "ccf_domain", "ccf_level", "id"]
    return entries.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_entries(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by type. ``mode="ignore"`` loads only when there is no table yet."""
    _clustered(entries).write.mode(mode).partitionBy("type").parquet(path)


def load_if_absent(entries: DataFrame, path: str) -> None:
    """Write the catalogue unless the target already exists, with or without rows."""
    write_entries(entries, path, mode="ignore")


def load_if_empty(entries: DataFrame, path: str) -> bool:
    """Write the catalogue unless the target holds a row; True if it was written.

    A missing folder, an empty one and a table without rows are all empty.
    """
    try:
        empty = read_entries(entries.sparkSession, path).limit(1).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = True
    if empty:
        write_entries(entries, path, mode="append")
    return empty


def read_entries(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """The catalogue table; files written before a column existed read it as its default (constant SQL), else as NULL."""
    return spark.read.schema(schema.with_defaults(schema.ENTRY, defaults or {})).parquet(path).select(*schema.ENTRY_COLUMNS)


def export_records(entries: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """``(journals, conferences)`` in the field names of the import document, behind the columns ``more``."""
    fields = {**schema.JOURNAL_TEXT_FIELDS, **schema.JOURNAL_NUMBER_FIELDS,
              **schema.JOURNAL_NESTED_FIELDS}
    journals = entries.where("type = 'journal'").select(
        *more, *[F.col(c).alias(f) for f, c in fields.items()])
    conferences = entries.where("type = 'conference'").select(
        *more, *[F.col(c).alias(f) for f, c in CONFERENCE_FIELDS.items()])
    return journals, conferences


def write_export(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The import document as two JSON-lines tables, ``journals`` and ``conferences``.

    ``large.write_large_export`` writes one document in parts instead.
    """
    journals, conferences = export_records(entries)
    journals.write.mode(mode).json(f"{path}/journals")
    conferences.write.mode(mode).json(f"{path}/conferences")
