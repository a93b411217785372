"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id and text. Words are summed by source and the
first 12 bits of the hash; the running sums show the bucket in which a source's budget
ends. Only the documents of that one bucket are summed again, by the next 12 bits, and
so on; what remains is one hash threshold per source, and a filter. No documents are sorted.
Repeated rows share their hash; those on a threshold are told apart the same way by a row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuedir.llm.common import n_words, staged, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BITS, LEVELS = 12, 5
#: A source's documents are spread over so many tasks when they meet its row.
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in code-point order, NULL last, take ``weights`` in turn. A target stops at
    ``most`` times the source's size; what is over goes to the others by weight. The
    sources that stop are a prefix of the order by cap over weight, so one running sum
    settles all rounds. The windows hold one row per source, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * most)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", (F.sum("source_size").over(everything) * F.lit(share)).alias("_budget"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_left_w"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_left_cap"))
    rows = rows.withColumn("_rate", (F.col("_budget") - F.col("_left_cap")) / F.col("_left_w"))
    rows = rows.withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_rate"))
    rate = F.max(F.when(~F.col("_full"), F.col("_rate"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * rate)
    return rows.select("source", "source_size", target.alias("target"))


def _salted(per_source: DataFrame, name: str) -> DataFrame:
    """Rows per source once for each salt: a hot source's documents then join in ``SALTS`` tasks."""
    return per_source.withColumnRenamed("source", name).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _same_source():
    return F.col("source").eqNullSafe(F.col("_source")) & (F.pmod("h", F.lit(SALTS)) == F.col("_salt"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(source, threshold, rest)`` from ``docs(source, h, size)`` and ``budgets(source, rest)``.

    Documents with a hash below the threshold hold at most ``rest`` words, and with the
    next hash value they would hold more; the result's ``rest`` is what they leave of it.
    Sources without a row take every document.
    """
    state = budgets.select("source", F.col("rest").alias("_rest"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        bucket = F.shiftright("h", BITS * (LEVELS - 1 - level))
        rows = docs.select("source", "h", "size", bucket.alias("_bucket"))
        inside = F.shiftright(F.col("_bucket"), BITS) == F.col("_prefix")
        rows = rows.join(_salted(state, "_source"), _same_source() & inside)
        sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"), F.first("_rest").alias("_rest"))
        run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("_until", F.sum("_n").over(run)).where("_until > _rest")
        state = sums.groupBy("source").agg(
            F.min_by(F.struct("_bucket", (F.col("_rest") - (F.col("_until") - F.col("_n"))).alias("_rest")),
                     "_bucket").alias("_at")
        ).select("source", F.col("_at._rest").alias("_rest"), F.col("_at._bucket").alias("_prefix"))
    return state.select("source", F.col("_prefix").alias("threshold"), F.col("_rest").alias("rest"))


def _mixed(docs: DataFrame, carried: Column, weights: Sequence[int], share: float, most: int,
           key: str, text: str, source: str) -> DataFrame:
    """``(doc, source, size, source_size, target, copies)`` per row, ``doc`` being ``carried``."""
    body = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), body))
    h = F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")
    rows = staged(docs.select(carried.alias("doc"), F.col(source).cast("string").alias("source"),
                              n_words(F.col(text)).alias("size"), h.alias("h"),
                              F.monotonically_increasing_id().alias("row")), "mixing")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("base", base.cast("long")).withColumn(
        "rest", F.col("target") - F.col("base") * F.col("source_size"))
    targets = staged(targets, "targets")
    limits = staged(thresholds(rows, targets.select("source", "rest")), "limits")
    edge = rows.join(_salted(limits, "_source"), _same_source() & (F.col("h") == F.col("threshold")))
    edge = staged(edge.select("source", F.col("row").alias("h"), "size"), "edge")
    last = thresholds(edge, limits.select("source", "rest")).select("source", F.col("threshold").alias("last"))
    plan = targets.alias("t").join(limits.alias("l"), F.expr("t.source <=> l.source"), "left").join(
        last.alias("e"), F.expr("t.source <=> e.source"), "left").select(
        F.col("t.source").alias("source"), "source_size", "target", "base", F.col("t.rest").alias("rest"), "threshold", "last")
    below = F.col("threshold").isNull() | (F.col("h") < F.col("threshold")) | (
        (F.col("h") == F.col("threshold")) & (F.col("row") < F.col("last")))
    extra = F.when((F.col("rest") > 0) & F.coalesce(below, F.lit(False)), 1).otherwise(0)
    return rows.join(_salted(plan, "_source"), _same_source()).select(
        "doc", "source", "size", "source_size", "target", (F.col("base") + extra).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
                key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(key, source, size, source_size, target, copies, taken)`` for every row of ``docs``.

    Size is the number of words (NULL text: 0). ``taken = size * copies``; no document is
    taken more than ``most`` times. NULL keys count as empty ones. Rows that repeat key and text share one
    hash; where a target ends among them, as many as fit are taken once more, so every source comes within one
    document of its target. No rows give no rows. Reruns agree: the hash depends on key and text alone, and which of
    equal rows are taken cannot be told. Sources and repeated rows may hold any share of the rows: every sum is
    combined before the shuffle and the only joins are with one row per source.
    """
    return _mixed(docs, F.col(key), weights, share, most, key, text, source).select(
        F.col("doc").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
                    key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as :func:`mix_sources` says, same columns.

    Rows are written once, and each is repeated where it lies: texts meet one row per source and nothing else.
    """
    rows = _mixed(docs, F.struct("*"), weights, share, most, key, text, source).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


SQL = r"""with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, row_number() over () as r,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as w,
    2 * source_size as cap, cast(sum(source_size) over () as bigint) * 1.5e0 as budget from s),
r as (select *, (budget - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as rate
    from w window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, cap / w <= rate as is_full from r),
t as (select source, source_size, case when is_full then cast(cap as double)
    else w * max(case when not is_full then rate end) over () end as target from f),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as base from t),
c as (select d.*, p.source_size, p.target, p.base, p.target - p.base * p.source_size as rest,
    sum(size) over (partition by d.source order by h, r rows unbounded preceding) as until from d join p on d.source is not distinct from p.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(size * (base + case when rest > 0 and until <= rest then 1 else 0 end) as bigint) as taken from c"""
