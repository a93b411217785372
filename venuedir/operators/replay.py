"""Annotation state from an operation log.

Operations are ``(event_id, ts, owner_kind, owner_id, entry_id, op, tags, content)``
and are ordered by ``(ts, event_id)``. Nothing here depends on arrival order, and a
repeated event changes nothing, so replays may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions.tags import no_tags
from venuedir.functions.text import trim_space
from venuedir.operators.skew import lookup

# Fixed values.
FAV_ADD = "fav_add"
FAV_REMOVE = "fav_remove"
FAV_TAGS = "fav_tags"
FAV_TOGGLE = "fav_toggle"
NOTE_UPSERT = "note_upsert"
NOTE_DELETE = "note_delete"
FAVORITE_OPS = [FAV_ADD, FAV_REMOVE, FAV_TAGS]
NOTE_OPS = [NOTE_UPSERT, NOTE_DELETE]

KEY = schema.ANNOTATION_KEY


def _behind_last_remove(rows: DataFrame, removes: DataFrame) -> DataFrame:
    """``rows`` newer than the ``_remove`` of their key in ``removes``, or without one."""
    marked = lookup(rows, removes.select(*KEY, F.struct("_remove.ts", "_remove.event_id").alias("_gone")), KEY)
    newer = F.struct("ts", "event_id") > F.col("_gone")
    return marked.where(F.col("_gone").isNull() | newer).drop("_gone")


def replay_favorites(ops: DataFrame) -> DataFrame:
    """Live favourites: ``(owner_kind, owner_id, entry_id, tags, created_at)``.

    An add counts only while the favourite is absent, so the first add after the
    last remove is the live one; it dates the row. The newest tag operation behind
    that add sets the tags; earlier ones, and those of absent favourites, do nothing.

    Two combining aggregates around a skew-tolerant join: the rows of one key are
    never sorted, nor gathered in one task, however many there are. A filter on the
    owner reaches both reads of ``ops``.
    """
    own = ops.where(F.col("op").isin(FAVORITE_OPS)).select(*KEY, "op", "ts", "event_id", "tags")
    removes = own.where(F.col("op") == FAV_REMOVE).groupBy(*KEY).agg(
        F.max(F.struct("ts", "event_id")).alias("_remove"))
    live = _behind_last_remove(own.where(F.col("op") != FAV_REMOVE), removes)
    stamped = F.struct("ts", "event_id", "tags")
    state = live.groupBy(*KEY).agg(
        F.min(F.when(F.col("op") == FAV_ADD, stamped)).alias("_add"),
        F.max(F.when(F.col("op") == FAV_TAGS, stamped)).alias("_tags"),
    ).where(F.col("_add").isNotNull())
    position = {c: F.struct(f"{c}.ts", f"{c}.event_id") for c in ("_add", "_tags")}
    retagged = F.coalesce(position["_tags"] > position["_add"], F.lit(False))
    tags = F.when(retagged, F.col("_tags.tags")).otherwise(F.col("_add.tags"))
    return state.select(*KEY, F.coalesce(tags, no_tags()).alias("tags"),
                        F.col("_add.ts").alias("created_at"))


def condensed(ops: DataFrame) -> DataFrame:
    """The operations that can still matter, whatever operations arrive later.

    Per key these are the last remove, the adds behind it, the last tag operation and
    the last note operation. Replaying them, with any others added, gives what
    replaying the whole log with those others gives.
    """
    stamped = F.struct("ts", "event_id", "op", "tags", "content")
    # The two note operations are one kind, of which the last one counts.
    kind = F.when(F.col("op").isin(NOTE_OPS), "note").otherwise(F.col("op")).alias("_kind")
    last = ops.where(F.col("op").isin([FAV_REMOVE, FAV_TAGS, *NOTE_OPS])).groupBy(*KEY, kind).agg(F.max(stamped).alias("_op"))
    kept = last.select(*KEY, "_op.*")
    removes = ops.where(F.col("op") == FAV_REMOVE).groupBy(*KEY).agg(F.max(F.struct("ts", "event_id")).alias("_remove"))
    adds = ops.where(F.col("op") == FAV_ADD).select(*kept.columns)
    return kept.unionByName(_behind_last_remove(adds, removes).distinct())


def latest(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """The newest row per key. Spark cuts every group to one row before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def replay_notes(ops: DataFrame) -> DataFrame:
    """Live notes: ``(owner_kind, owner_id, entry_id, content, updated_at)``.

    One note per owner and entry, last write wins. An empty text is still a note;
    only a delete removes it.
    """
    own = ops.where(F.col("op").isin(NOTE_OPS)).select(*KEY, "op", "content", "ts", "event_id")
    last = latest(own, KEY, F.desc("ts"), F.desc("event_id")).where(F.col("op") == NOTE_UPSERT)
    return last.select(*KEY, F.coalesce("content", F.lit("")).alias("content"),
                       F.col("ts").alias("updated_at"))


def trimmed_notes(ops: DataFrame) -> DataFrame:
    """Note texts trimmed before they are logged, as the editor does."""
    text = F.when(F.col("op") == NOTE_UPSERT, trim_space(F.col("content")))
    return ops.withColumn("content", F.coalesce(text, F.col("content")))


def replay_toggles(toggles: DataFrame) -> DataFrame:
    """Favourites from toggles alone: an odd count is live, dated by the last toggle.

    Unlike the other replays this one counts, so repeated events are dropped first.
    """
    once = toggles.where(F.col("op") == FAV_TOGGLE).select(*KEY, "ts", "event_id").distinct()
    counted = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("created_at"))
    return counted.where("_n % 2 = 1").select(*KEY, "created_at")
