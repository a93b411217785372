"""Joins of entries with an owner's favourites and notes, and the annotation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions.tags import no_tags
from venuedir.operators.owners import DEVICE, USER, Owner, rows_of
from venuedir.operators.skew import lookup


def _first_per_entry(rows: DataFrame, *order) -> DataFrame:
    """At most one row per entry. State tables are unique already; raw imports may not be."""
    rank = F.row_number().over(W.partitionBy("entry_id").orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def tags_of(favorites: DataFrame, owner: Owner) -> DataFrame:
    """``(entry_id, tags)`` of one owner."""
    own = rows_of(favorites, owner).select("entry_id", "tags", "created_at")
    return _first_per_entry(own, "created_at").select("entry_id", "tags")


def notes_of(notes: DataFrame, owner: Owner) -> DataFrame:
    """``(entry_id, content)`` of one owner: the entry-to-note map, last write wins.

    Kept as rows. An owner may annotate millions of entries, so it is not folded
    into one map value.
    """
    own = rows_of(notes, owner).select("entry_id", "content", "updated_at")
    return _first_per_entry(own, F.desc("updated_at")).select("entry_id", "content")


def annotate(rows: DataFrame, favorites: DataFrame | None, notes: DataFrame | None,
             owner: Owner | None) -> DataFrame:
    """Add ``tags``, ``note`` and ``is_favorite`` for one owner.

    Meant to run on a page (limit first): both sides then hold one owner's rows at
    most, the shuffle is on ``entry_id``, and Spark broadcasts a side only when its
    measured size allows. One join serves the tags and the flag.
    """
    if owner is None:
        return rows.select("*", no_tags().alias("tags"), F.lit("").alias("note"),
                           F.lit(False).alias("is_favorite"))
    fav = tags_of(favorites, owner).select(
        F.col("entry_id").alias("_fav_id"), F.col("tags").alias("_fav_tags"))
    note = notes_of(notes, owner).select(
        F.col("entry_id").alias("_note_id"), F.col("content").alias("_content"))
    joined = rows.join(fav, F.col("id") == F.col("_fav_id"), "left").join(
        note, F.col("id") == F.col("_note_id"), "left")
    return joined.select(
        *rows.columns,
        F.coalesce("_fav_tags", no_tags()).alias("tags"),
        F.coalesce("_content", F.lit("")).alias("note"),
        F.col("_fav_id").isNotNull().alias("is_favorite"),
    )


def annotate_for_owners(entries: DataFrame, favorites: DataFrame, notes: DataFrame,
                        columns: list[str]) -> DataFrame:
    """Every annotated (owner, entry) with the entry's columns, for all owners at once.

    Favourites and notes meet on the annotation key first (same partitioning, one
    shuffle each), then the entry columns are looked up.
    """
    fav = favorites.select(*schema.ANNOTATION_KEY, "tags", F.lit(True).alias("is_favorite"))
    note = notes.select(*schema.ANNOTATION_KEY, F.col("content").alias("note"))
    both = fav.join(note, schema.ANNOTATION_KEY, "full_outer")
    venue = entries.select(F.col("id").alias("entry_id"), *[c for c in columns if c != "id"])
    rows = lookup(both, venue, ["entry_id"], "inner").withColumnRenamed("entry_id", "id")
    return rows.select(
        *schema.OWNER_KEY, *columns,
        F.coalesce("tags", no_tags()).alias("tags"),
        F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"),
    )


def tags_for_entries(favorites: DataFrame, owner: Owner, ids: DataFrame) -> DataFrame:
    """``(entry_id, tags)`` for a list of ids; ids without a favourite are absent."""
    return tags_of(favorites, owner).join(ids.select("entry_id").distinct(), "entry_id", "left_semi")


def notes_for_entries(notes: DataFrame, owner: Owner, ids: DataFrame) -> DataFrame:
    """``(entry_id, content)`` for a list of ids; ids without a note are absent."""
    return notes_of(notes, owner).join(ids.select("entry_id").distinct(), "entry_id", "left_semi")


def tags_or_empty(requests: DataFrame, favorites: DataFrame) -> DataFrame:
    """Tags of requested (owner, entry) keys; ``[]`` when there is no such favourite."""
    keys = schema.ANNOTATION_KEY
    found = lookup(requests, favorites.select(*keys, "tags"), keys)
    return found.withColumn("tags", F.coalesce("tags", no_tags()))


def note_or_empty(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """Note of requested (owner, entry) keys; ``''`` when there is none."""
    keys = schema.ANNOTATION_KEY
    found = lookup(requests, notes.select(*keys, "content"), keys)
    return found.withColumn("content", F.coalesce("content", F.lit("")))


def is_favorite(requests: DataFrame, favorites: DataFrame) -> DataFrame:
    """Requested (owner, entry) keys with an ``is_favorite`` flag."""
    keys = schema.ANNOTATION_KEY
    marked = favorites.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return lookup(requests, marked, keys).select(
        *requests.columns, F.col("_hit").isNotNull().alias("is_favorite"))


def notes_with_entry(notes: DataFrame, entries: DataFrame) -> DataFrame:
    """Notes with the entry's abbreviation, name and level. Notes of unknown entries drop out.

    A popular entry may hold a large share of the notes; the notes side of the join
    is the one that skew splitting cuts.
    """
    venue = entries.select(F.col("id").alias("entry_id"), "ccf_abbr", "ccf_full", "ccf_level")
    return lookup(notes, venue, ["entry_id"], "inner").select(
        *schema.OWNER_KEY, "entry_id", "ccf_abbr", "ccf_full", "ccf_level", "content", "updated_at")


def list_notes(notes: DataFrame, entries: DataFrame, owner: Owner) -> DataFrame:
    """An owner's notes, newest first."""
    return notes_with_entry(rows_of(notes, owner), entries).orderBy(
        F.desc("updated_at"), "entry_id")


def list_favorite_ids(favorites: DataFrame, owner: Owner) -> DataFrame:
    """An owner's favourite ids, newest first."""
    return rows_of(favorites, owner).orderBy(F.desc("created_at"), "entry_id").select(
        "entry_id", "created_at")


def favorite_counts(favorites: DataFrame) -> DataFrame:
    """Favourites per owner; combined before the shuffle, so a heavy owner is one row per task."""
    return favorites.groupBy(*schema.OWNER_KEY).agg(F.count(F.lit(1)).alias("n"))


def distinct_tags(favorites: DataFrame) -> DataFrame:
    """Distinct tag names per owner with their first use ``(first_at, first_pos)``.

    Favourites without readable tags are skipped. Order by ``first_at, first_entry,
    first_pos`` for first-seen order.
    """
    used = favorites.select(
        *schema.OWNER_KEY, "created_at", "entry_id", F.posexplode("tags").alias("pos", "name"))
    first = F.min(F.struct("created_at", "entry_id", "pos"))
    return used.groupBy(*schema.OWNER_KEY, "name").agg(first.alias("_first")).select(
        *schema.OWNER_KEY, "name",
        F.col("_first.created_at").alias("first_at"),
        F.col("_first.entry_id").alias("first_entry"),
        F.col("_first.pos").alias("first_pos"),
    )


def guest_tags(favorites: DataFrame) -> DataFrame:
    """Distinct tags of guests only."""
    return distinct_tags(favorites.where(F.col("owner_kind") == DEVICE))


def list_tags(favorites: DataFrame, user_tags: DataFrame, owner: Owner) -> DataFrame:
    """A user's tag definitions by name, or a guest's used tags in first-seen order."""
    if owner.kind == USER:
        own = user_tags.where(F.col("user_id") == owner.id)
        return own.select("name", "color").orderBy("name")
    first_seen = distinct_tags(rows_of(favorites, owner))
    return first_seen.orderBy("first_at", "first_entry", "first_pos").select(
        "name", F.lit("").alias("color"))


def tag_uses(favorites: DataFrame) -> DataFrame:
    """Distinct ``(user_id, name)`` pairs in use by users."""
    used = favorites.where(F.col("owner_kind") == USER).select(
        F.col("owner_id").alias("user_id"), F.explode("tags").alias("name"))
    return used.distinct()


def tag_in_use(user_tags: DataFrame, favorites: DataFrame) -> DataFrame:
    """Tag definitions with an ``in_use`` flag: an exact element test per (user, name)."""
    used = tag_uses(favorites).withColumn("_hit", F.lit(True))
    return user_tags.join(used, ["user_id", "name"], "left").select(
        *user_tags.columns, F.col("_hit").isNotNull().alias("in_use"))
