"""Input documents as rows.

Each shape has a function over a column ``value`` of JSON texts, so it works the same
on a file, on a table of documents or on a stream, and a thin reader for files.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuedir import schema

CORRUPT = "_corrupt_record"
BAD_JSON, MISSING_FIELD = "bad_json", "missing_field"


def read_documents(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """JSON texts as ``value``: one per file, or one per line (the form for large inputs)."""
    return spark.read.text(path, wholetext=whole)


def import_records(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(journals, conferences, rejects)`` of combined documents ``{journals: [], conferences: []}``.

    A text that is not such a document gives no records and one reject.
    """
    parsed = parse_records(documents, schema.IMPORT_DOCUMENT)
    good = accepted(parsed)
    return good.select(F.inline("journals")), good.select(F.inline("conferences")), rejects(parsed)


def read_import_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`import_records` of files, one document each."""
    return import_records(read_documents(spark, path))


def parse_records(documents: DataFrame, record: T.StructType,
                  required: list[str] | None = None) -> DataFrame:
    """One record per JSON text: its fields, the text, and ``reject_reason``.

    A bad record is kept and marked instead of failing the load.
    """
    marked = T.StructType([*record.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    parsed = documents.select("value", F.from_json("value", marked, options).alias("_r"))
    reason = F.when(F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull(), BAD_JSON)
    for name in required or []:
        reason = reason.when(F.col(f"_r.{name}").isNull(), MISSING_FIELD)
    return parsed.select("value", *[F.col(f"_r.{n}").alias(n) for n in record.fieldNames()],
                         reason.alias("reject_reason"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("value", "reject_reason")


def rejects(parsed: DataFrame) -> DataFrame:
    """``(value, reject_reason)`` of the bad records."""
    return parsed.where(F.col("reject_reason").isNotNull()).select("value", "reject_reason")


def reject_counts(parsed: DataFrame) -> DataFrame:
    """``(reject_reason, n)``; NULL counts the accepted records."""
    return parsed.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@contextmanager
def _two_writers(spark: SparkSession) -> Iterator[None]:
    """Each task keeps a file open for both values of a flag, where it would else hold and sort its rows by it."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_counted(parsed: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str | None, int]]:
    """Write ``parsed`` below ``path``, accepted records and rejects apart; ``(accepted, rejects, counts)`` of what was written.

    The input is read and parsed once: counts by reason (None: accepted) are observed by the write itself. They
    are a report: a task that Spark runs again may be counted again. :func:`reject_counts` of the stored rows is exact.
    """
    reasons = [None, BAD_JSON, MISSING_FIELD]
    seen = Observation("import")
    is_reason = [F.col("reject_reason").eqNullSafe(F.lit(r)) for r in reasons]
    watched = parsed.observe(seen, *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(is_reason)])
    marked = watched.withColumn("rejected", F.col("reject_reason").isNotNull())
    with _two_writers(parsed.sparkSession):
        marked.write.partitionBy("rejected").parquet(path)
    counts = {r: seen.get[f"n{i}"] for i, r in enumerate(reasons)}
    kinds = T.StructType([*parsed.schema.fields, T.StructField("rejected", T.BooleanType())])
    stored = parsed.sparkSession.read.schema(kinds).parquet(path)
    good, bad = stored.where("not rejected").drop("rejected"), stored.where("rejected").drop("rejected")
    return accepted(good), rejects(bad), counts


def members(documents: DataFrame) -> DataFrame:
    """``(value, key, member)``: the members of JSON objects, each as its own JSON text.

    A text that is no object gives one row without key and member.
    """
    # As the only field of a record, so that Spark reports texts it can read in part only.
    shape = T.StructType([T.StructField("_map", T.MapType(T.StringType(), T.StringType())), T.StructField(CORRUPT, T.StringType())])
    wrapped = F.concat(F.lit('{"_map":'), "value", F.lit("}"))
    parsed = documents.select("value", F.from_json(
        wrapped, shape, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("_r"))
    whole = parsed.select("value", F.when(F.col(f"_r.{CORRUPT}").isNull(), F.col("_r._map")).alias("_map"))
    bad = F.map_from_arrays(F.array(F.lit("")), F.array(F.lit(None).cast("string")))
    rows = whole.select("value", F.col("_map").isNull().alias("_bad"), F.explode(F.coalesce("_map", bad)).alias("key", "member"))
    return rows.select("value", F.when(~F.col("_bad"), F.col("key")).alias("key"), "member")


def elements(rows: DataFrame) -> DataFrame:
    """``(value, key, member, element)``: the elements of members that are arrays, each as JSON text.

    A member that is no array gives one row without element, an empty one none.
    """
    items = F.from_json("member", T.ArrayType(T.StringType()))
    items = F.when(F.ltrim("member").startswith("["), items)
    return rows.select("value", "key", "member", F.explode(F.coalesce(items, F.array(F.lit(None).cast("string")))).alias("element"))


def as_record(text: str, record: T.StructType) -> Column:
    """The record in a JSON text, NULL if it holds anything but an object of that shape."""
    marked = T.StructType([*record.fields, T.StructField(CORRUPT, T.StringType())])
    made = F.from_json(text, marked, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    return F.when(F.ltrim(text).startswith("{") & made[CORRUPT].isNull(), made)


def _domain_records(documents: DataFrame, record: T.StructType) -> DataFrame:
    shape = T.StructType([f for f in record.fields if f.name != "domain"])
    rows = elements(members(documents))
    return rows.withColumn("_record", as_record("element", shape))


def odd(rows: DataFrame, text: str) -> DataFrame:
    """``(value, reject_reason, key)``: whole documents without a key, odd members with theirs and their own text."""
    bad = rows.where(F.col("_record").isNull())
    return bad.select(F.when(F.col("key").isNull(), F.col("value")).otherwise(F.col(text)).alias("value"),
                      F.lit(BAD_JSON).alias("reject_reason"), "key")


def flatten_by_domain(documents: DataFrame, record: T.StructType = schema.SOURCE_RECORD) -> DataFrame:
    """``{domain: [record, ...]}`` to records stamped with ``domain``.

    The key wins over a field of the same name in the record. Every record is read by itself: an odd one, or a
    text that is no such document, gives no row here and one in :func:`by_domain_rejects`.
    """
    names = [f.name for f in record.fields if f.name != "domain"]
    rows = _domain_records(documents, record).where(F.col("_record").isNotNull())
    return rows.select(F.col("key").alias("domain"), *[F.col(f"_record.{n}").alias(n) for n in names])


def by_domain_rejects(documents: DataFrame, record: T.StructType = schema.SOURCE_RECORD) -> DataFrame:
    """``(value, reject_reason, key)`` of what :func:`flatten_by_domain` cannot read.

    Whole documents have no key; of an odd member or record, ``value`` is its own text and ``key`` its domain.
    """
    rows = _domain_records(documents, record)
    return odd(rows.withColumn("element", F.coalesce("element", "member")), "element")


def flatten_keyed(documents: DataFrame, record: T.StructType, key: str = "abbr") -> DataFrame:
    """``{key: record}`` to rows with the key as a column.

    Every member is read by itself: an odd one, or a text that is no such document, gives no row here and one
    in :func:`keyed_rejects`.
    """
    rows = members(documents).withColumn("_record", as_record("member", record)).where(F.col("_record").isNotNull())
    return rows.select(F.col("key").alias(key), *[F.col(f"_record.{n}").alias(n) for n in record.fieldNames()])


def keyed_rejects(documents: DataFrame, record: T.StructType) -> DataFrame:
    """``(value, reject_reason, key)`` of what :func:`flatten_keyed` cannot read: documents without, members with a key."""
    return odd(members(documents).withColumn("_record", as_record("member", record)), "member")


def read_by_domain(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    return flatten_by_domain(read_documents(spark, path, whole))


def read_keyed(spark: SparkSession, path: str, record: T.StructType, key: str = "abbr",
               missing_ok: bool = True) -> DataFrame:
    """A keyed lookup; a missing file reads as an empty one unless ``missing_ok`` is off."""
    try:
        documents = read_documents(spark, path)
    except AnalysisException as error:
        if not missing_ok or error.getCondition() != "PATH_NOT_FOUND":
            raise
        fields = [T.StructField(key, T.StringType()), *record.fields]
        return spark.createDataFrame([], T.StructType(fields))
    return flatten_keyed(documents, record, key)
