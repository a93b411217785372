"""Line dedup over overlapping windows of three lines.

Lines are hashed, three consecutive hashes make a window, and windows are counted over
the whole corpus. The first occurrence of a repeated window stays; the lines that its
later occurrences cover go. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.llm.common import fresh, table

WINDOW = 3


def _line_hashes(lines: Column) -> Column:
    """Two independent 64-bit hashes per line."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))


def _windows(hashes: Column) -> Column:
    """``array<struct<h1, h2>>``: one entry per run of three lines."""
    def at(i: Column, side: str) -> Column:
        parts = [F.get(hashes, i + k)[side] for k in range(WINDOW)]
        return F.xxhash64(*parts)

    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    made = F.transform(starts, lambda i: F.struct(at(i, "a").alias("h1"), at(i, "b").alias("h2")))
    return F.when(F.size(hashes) >= WINDOW, made)


def _kept_lines(lines: Column, starts: Column) -> Column:
    """Lines outside the windows that begin at the sorted ``starts``: the gaps between them, joined."""
    def gap(i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(starts, i - 1) + WINDOW)
        end = F.when(i == F.size(starts), F.size(lines)).otherwise(F.get(starts, i))
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), gap))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated runs of lines removed, plus ``n_lines`` and ``n_removed``.

    Lines end at ``\\n``. Among the occurrences of three equal consecutive lines the one with
    the least (key, text hash, position) stays, NULL keys first; occurrences that overlap
    it in the same text count as later ones. Windows are judged on the input, not on what is left.
    Texts of fewer than three lines stay as they are; NULL texts stay NULL with 0
    lines. Rows that repeat both key and text are one document and keep the same lines.
    Columns that already carry the added names are replaced. A window that a third of all documents share
    costs nothing extra: first occurrences come from a combining aggregate, and the join that finds
    the later ones lies directly between two shuffles, where Spark splits a skewed side.
    """
    n_lines, n_removed, k, th, lines, hashes, starts, k2, th2 = fresh(
        [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")],
        "n_lines", "n_removed", "_k", "_th", "_lines", "_hashes", "_starts", "_k2", "_th2")
    keyed = docs.select(F.col(key).alias(k), F.xxhash64(text).alias(th),
                        _line_hashes(F.split(F.col(text), "\n")).alias(hashes))
    at = keyed.select(k, th, F.posexplode(_windows(F.col(hashes)))).select(
        k, th, F.col("pos"), F.col("col.h1").alias("h1"), F.col("col.h2").alias("h2"))
    first = at.groupBy("h1", "h2").agg(F.min(F.struct(k, th, "pos")).alias("first"),
                                       F.count("*").alias("n")).where("n > 1").drop("n")
    again = at.join(first, ["h1", "h2"]).where(~F.struct(k, th, "pos").eqNullSafe(F.col("first")))
    removed = again.groupBy(F.col(k).alias(k2), F.col(th).alias(th2)).agg(
        F.array_sort(F.collect_set("pos")).alias(starts))
    same = F.col(k).eqNullSafe(F.col(k2)) & (F.col(th) == F.col(th2))
    kept = docs.drop("n_lines", "n_removed")
    rows = kept.withColumns({k: F.col(key), th: F.xxhash64(text)}).join(removed, same, "left")
    rows = rows.withColumn(lines, F.split(F.col(text), "\n"))
    rows = rows.withColumn(hashes, F.when(F.col(starts).isNotNull(), _kept_lines(F.col(lines), F.col(starts))))
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col(hashes).isNull(), 0).otherwise(F.size(lines) - F.size(hashes)).cast("long")
    new_text = F.when(F.col(hashes).isNull(), F.col(text)).otherwise(F.array_join(hashes, "\n"))
    return rows.select(*[new_text.alias(c) if c == text else F.col(c) for c in kept.columns],
                       total.alias(n_lines), gone.alias(n_removed))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and the SHA-256 of the rest, for every document."""
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = """with l as (
  select doc_id, text, row_number() over () as r, string_split(text, chr(10)) as lines from documents),
w as (select doc_id, r, pos, lines[pos + 1] as a, lines[pos + 2] as b, lines[pos + 3] as c
  from (select doc_id, r, lines, unnest(range(0, len(lines) - 2)) as pos from l where len(lines) >= 3)),
n as (select r, pos, row_number() over (partition by a, b, c order by doc_id nulls first, pos) as k from w),
gone as (select distinct r, unnest([pos, pos + 1, pos + 2]) as pos from n where k > 1),
g as (select r, list(pos) as gone from gone group by r)
select doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  case when gone is null then sha256(text) else sha256(array_to_string(
    list_transform(list_filter(range(0, len(lines)), lambda i: not list_contains(gone, i)), lambda i: lines[i + 1]),
    chr(10))) end as kept_sha256
from l left join g using (r)"""
