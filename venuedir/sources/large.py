"""JSON documents of any size, read and written by many tasks.

A document is cut at every closing brace, so Spark splits it like any text. Where a piece stands, inside a string
or not and how deep, follows from prefix sums: inside each block of the file over its pieces, and over one row per block.
Pieces are then put together to groups that end with a record, each a small document of its own.
Groups are bounded by the size of a record and what stands between two records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuedir import schema
from venuedir.session import shared_dir
from venuedir.sources import records
from venuedir.sources.catalogue import export_records

END = "}"
#: Depth of records: members of the root object, or elements of the arrays in it.
IN_ROOT, IN_ARRAYS = 1, 2
#: Groups in one block, inside which names are carried forward.
GROUPS = 10_000


def _depth_change(text: Column) -> Column:
    """Opening minus closing brackets outside strings; escapes are gone already, and a string at the end may be open."""
    bare = F.regexp_replace(text, r'"[^"]*("|\z)', "")
    plain = F.char_length(F.translate(bare, "{[}]", ""))
    opening = F.char_length(F.translate(bare, "}]", "")) - plain
    return 2 * opening - (F.char_length(bare) - plain)


def _pieces(spark: SparkSession, path: str, whole_folder: bool) -> DataFrame:
    """``(doc, file, block, at, text, ended, q, d0, d1)``: pieces up to a closing brace, in the order ``(file, block, at)``.

    ``q``: the quotes in a piece are odd. ``d0``, ``d1``: its change of depth if it starts outside, or inside, a string.
    With ``whole_folder`` the files of the path are one document in the order of their names.
    """
    raw = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    clean = F.regexp_replace("text", r"(?s)\\.", "")
    quotes = F.char_length(clean) - F.char_length(F.replace(clean, F.lit('"'), F.lit("")))
    doc = F.regexp_replace("file", "/[^/]*$", "") if whole_folder else F.col("file")
    pieces = raw.select(doc.alias("doc"), "file", "block", "at", "text", "_size", (quotes % 2).cast("int").alias("q"),
                        _depth_change(clean).alias("d0"), _depth_change(F.regexp_replace(clean, r'\A[^"]*("|\z)', "")).alias("d1"))
    stored = _stored(pieces, "pieces")
    # A file's last piece has a closing brace behind it only if the sizes say so.
    lasts = stored.groupBy("file").agg(F.max(F.struct("block", "at")).alias("_last"), F.first("_size").alias("_size"),
                                       F.sum(F.octet_length("text") + 1).alias("_with_ends"))
    open_ = lasts.where(F.col("_with_ends") != F.col("_size")).select("file", "_last.block", "_last.at", F.lit(True).alias("_open"))
    return stored.drop("_size").join(open_, ["file", "block", "at"], "left").withColumn("ended", F.col("_open").isNull()).drop("_open")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _before(rows: DataFrame, value: str) -> Column:
    """Sum of ``value`` over the blocks before, of one document; one row per block meets here."""
    window = Window.partitionBy("doc").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def grouped_members(spark: SparkSession, path: str, depth: int, whole_folder: bool = False) -> DataFrame:
    """``(doc, group, text, closed)``: the text of each document cut behind every record.

    A record is an object that closes at ``depth``. The last group holds what follows; it is not ``closed``.
    """
    pieces = _pieces(spark, path, whole_folder)
    inside = Window.partitionBy("doc", "file", "block").orderBy("at")
    key = ["doc", "file", "block"]
    # whether each piece starts and ends in a string, if its block starts outside one (0) or inside one (1)
    run = F.sum("q").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbers = pieces.select(*key, "at", "q", "d0", "d1", "ended").withColumn("_run", run)
    for start in (0, 1):
        begins, ends = (F.lit(start) + F.col("_run") - F.col("q")) % 2, (F.lit(start) + F.col("_run")) % 2
        change = F.when(begins == 0, F.col("d0")).otherwise(F.col("d1")) - F.when(F.col("ended") & (ends == 0), 1).otherwise(0)
        numbers = numbers.withColumns({f"_c{start}": change, f"_e{start}": ends})
    blocks = numbers.groupBy(*key).agg(F.sum("q").alias("_q"), F.sum("_c0").alias("_c0"), F.sum("_c1").alias("_c1"))
    blocks = blocks.withColumn("_start", _before(blocks, "_q") % 2)
    blocks = blocks.withColumn("_change", F.when(F.col("_start") == 0, F.col("_c0")).otherwise(F.col("_c1")))
    blocks = blocks.select(*key, "_start", _before(blocks, "_change").alias("_deep"))
    joined = numbers.join(blocks, key)
    pick = [F.when(F.col("_start") == 0, F.col(f"_{x}0")).otherwise(F.col(f"_{x}1")) for x in ("c", "e")]
    placed = joined.select(*key, "at", pick[0].alias("_change"), pick[1].alias("_ends"), "ended", "_deep")
    deep = F.col("_deep") + F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    cut = F.when(F.col("ended") & (F.col("_ends") == 0) & (deep == depth), 1).otherwise(0)
    cuts = _stored(placed.withColumn("_cut", cut).select(*key, "at", "_cut"), "cuts")
    totals = cuts.groupBy(*key).agg(F.sum("_cut").alias("_n"))
    totals = totals.select(*key, _before(totals, "_n").alias("_groups"))
    earlier = F.coalesce(F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = cuts.withColumn("_earlier", earlier).join(totals, key).select(*key, "at", "_cut", (F.col("_groups") + F.col("_earlier")).alias("group"))
    text = F.concat("text", F.when(F.col("ended"), END).otherwise(""))
    rows = pieces.select(*key, "at", text.alias("text")).join(numbered, [*key, "at"])
    parts = F.array_sort(F.collect_list(F.struct("file", "block", "at", "text")))
    return rows.groupBy("doc", "group").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
                                            (F.max("_cut") == 1).alias("closed"))


def _member_documents(groups: DataFrame) -> DataFrame:
    """``(doc, group, value)``: every group of members as a JSON object of its own."""
    body = F.regexp_replace("text", r"\A\s*,", "")
    body = F.when(F.col("group") == 0, body).otherwise(F.concat(F.lit("{"), body))
    value = F.when(F.col("closed"), F.concat(body, F.lit("}"))).otherwise(body)
    # the root's own closing brace alone, or white space behind it, holds nothing
    return groups.select("doc", "group", value.alias("value")).where(~F.col("value").rlike(r"\A\{\s*\}?\s*\z") | (F.col("group") == 0))


def read_large_keyed(spark: SparkSession, path: str, record: T.StructType, key: str = "abbr",
                     whole_folder: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of documents ``{key: record}`` of any size, as ``records.flatten_keyed`` and ``keyed_rejects``.

    Members are rejected one by one; where brackets or quotes do not match, the group at that place is one reject.
    """
    documents = _member_documents(grouped_members(spark, path, IN_ROOT, whole_folder)).select("value")
    return records.flatten_keyed(documents, record, key), records.keyed_rejects(documents, record)


def _array_documents(groups: DataFrame) -> DataFrame:
    """``value``: every group as a JSON object of arrays; a group that starts inside an array takes the name it has there.

    Only groups that open an array carry its name. The last name before a group comes from a window inside blocks of
    groups, and over one row per block; no document is passed through in one task.
    """
    starts = ~F.col("text").rlike(r"\A\s*,")
    body = (F.when(F.col("group") == 0, F.col("text"))
            .when(starts, F.concat(F.lit("{"), F.regexp_replace("text", r"\A\s*\]\s*,?", "")))
            .otherwise(F.regexp_replace("text", r"\A\s*,", "")))
    rows = groups.select("doc", "group", "closed", starts.alias("_starts"), F.concat(body, F.when(F.col("closed"), "]}").otherwise("")).alias("_body"),
                         F.floor(F.col("group") / GROUPS).alias("_block"))
    keys = F.json_object_keys(F.concat(F.when(F.col("_starts"), "").otherwise('{"":['), "_body"))
    rows = rows.withColumn("_keys", F.when(F.col("closed"), keys))
    rows = rows.withColumn("_opens", F.when((F.size("_keys") > 1) | (F.col("_starts") & (F.size("_keys") > 0)), F.element_at("_keys", -1))).drop("_keys")
    rows = _stored(rows, "groups")
    last = rows.groupBy("doc", "_block").agg(F.max(F.when(F.col("_opens").isNotNull(), F.struct("group", "_opens"))).alias("_last"))
    over_blocks = Window.partitionBy("doc").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("doc", "_block", F.last("_last._opens", ignorenulls=True).over(over_blocks).alias("_carried"))
    inside = Window.partitionBy("doc", "_block").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    named = rows.withColumn("_here", F.last("_opens", ignorenulls=True).over(inside)).join(last, ["doc", "_block"])
    name = F.to_json(F.array(F.coalesce("_here", "_carried")))
    quoted = F.substring(name, F.lit(2), F.length(name) - 2)
    value = F.when(F.col("_starts"), F.col("_body")).otherwise(F.concat(F.lit("{"), quoted, F.lit(":["), F.col("_body")))
    return named.select(value.alias("value")).where(~F.col("value").rlike(r"\A\{\s*\}?\s*\z"))


def read_large_by_domain(spark: SparkSession, path: str, record: T.StructType = schema.SOURCE_RECORD,
                         whole_folder: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of documents ``{domain: [record, ...]}`` of any size, as ``records.flatten_by_domain`` and ``by_domain_rejects``."""
    documents = _array_documents(grouped_members(spark, path, IN_ARRAYS, whole_folder))
    return records.flatten_by_domain(documents, record), records.by_domain_rejects(documents, record)


def read_large_import(spark: SparkSession, path: str, whole_folder: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(journals, conferences, rejects)`` of documents ``{journals: [...], conferences: [...]}`` of any size.

    Unlike ``records.import_records``, a broken document loses the records around the break only.
    """
    groups = _stored(_array_documents(grouped_members(spark, path, IN_ARRAYS, whole_folder)), "documents")
    rows = records.elements(records.members(groups))
    shapes = {"journals": schema.JOURNAL_IMPORT, "conferences": schema.CONFERENCE_IMPORT}
    out = []
    for name, shape in shapes.items():
        out.append(rows.where(F.col("key") == name).withColumn("_record", records.as_record("element", shape)))
    odd = [records.odd(r.withColumn("element", F.coalesce("element", "member")), "element") for r in out]
    other = rows.where(F.col("key").isNull() | ~F.col("key").isin(*shapes)).withColumn("_record", F.lit(None))
    other = records.odd(other.withColumn("element", F.coalesce("element", "member")), "element").where("key is null")
    good = [r.where(F.col("_record").isNotNull()).select("_record.*") for r in out]
    return good[0], good[1], odd[0].unionByName(odd[1]).unionByName(other)


def write_large_export(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The import document in parts below ``path``: joined in the order of their names they are one JSON document.

    Records follow by kind and ``id``, which has to be unique. Only the least id of each kind is
    looked up; every other line starts with a comma.
    """
    kinds = entries.groupBy("type").agg(F.min("id").alias("_first"))
    sides = []
    for place, (kind, frame) in enumerate(zip(("journal", "conference"), export_records(entries, "id"), strict=True)):
        fields = [c for c in frame.columns if c != "id"]
        lines = frame.select("id", F.to_json(F.struct(*fields)).alias("_json"))
        first = kinds.where(F.col("type") == kind).select(F.col("_first").alias("id"), F.lit(True).alias("_leads"))
        lines = lines.join(first, "id", "left")
        sides.append(lines.select(F.lit(2 * place + 1).alias("part"), "id", F.concat(
            F.when(F.col("_leads").isNull(), ",").otherwise(""), "_json").alias("value")))
    spark = entries.sparkSession
    fixed = spark.createDataFrame([(0, 0, '{"journals":['), (2, 0, '],"conferences":['), (4, 0, "]}")], "part int, id long, value string")
    lines = sides[0].unionByName(sides[1]).unionByName(fixed)
    lines.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("value").write.mode(mode).text(path)
