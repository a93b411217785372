"""Tag definitions, the user registry, and inserts that respect a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions.clean import valid_tag_name, valid_username
from venuedir.functions.tags import without_tag
from venuedir.operators.annotations import tag_uses
from venuedir.operators.owners import USER
from venuedir.operators.replay import latest
from venuedir.operators.skew import lookup


def first_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest row per key (``created_at``, then all other columns as a tiebreak)."""
    rest = [F.asc(c) for c in rows.columns if c not in {*keys, "created_at"}]
    return latest(rows, keys, F.asc("created_at"), *rest)


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` plus those new rows whose key is not there yet."""
    fresh = first_per_key(new, keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def _insert_or_reject(existing: DataFrame, requests: DataFrame, keys: list[str],
                      valid: Column) -> DataFrame:
    """Requests with ``status``: inserted, conflict (key taken or asked for earlier) or invalid.

    One winner per key is decided first and then looked up from the requests, so that
    a key asked for by very many requests is cut to one row before it is shuffled.
    """
    first = latest(requests.where(valid).select(*keys, "created_at", "request_id"), keys,
                   F.asc("created_at"), F.asc("request_id"))
    winners = first.join(existing.select(*keys), keys, "left_anti").select(
        *keys, F.col("request_id").alias("_winner"))
    status = (F.when(~valid, "invalid")
              .when(F.col("_winner") == F.col("request_id"), "inserted")
              .otherwise("conflict"))
    return lookup(requests, winners, keys).select(*requests.columns, status.alias("status"))


def create_tags(user_tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per ``(request_id, user_id, name, color, created_at)``; add the inserted rows."""
    return _insert_or_reject(user_tags, requests, ["user_id", "name"], valid_tag_name(F.col("name")))


def register_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per registration ``(request_id, username, created_at)``; usernames are unique."""
    return _insert_or_reject(users, requests, ["username"], valid_username(F.col("username")))


def lookup_users(users: DataFrame, wanted: DataFrame, by: str = "username") -> DataFrame:
    """Users by ``username`` or by ``id``; what is not found has no row."""
    return users.join(wanted.select(by).distinct(), by, "left_semi").select(*users.columns)


def update_outcomes(user_tags: DataFrame, updates: DataFrame) -> DataFrame:
    """Every update ``(user_id, name, new_name, new_color, ...)`` with its ``status``.

    ``not_found``: the user has no such tag. ``invalid``: the new name is too long or empty. ``superseded``: another
    update of the same tag counts, the one with the greatest ``(new_name, new_color)``. ``conflict``: the user has the new name before the
    batch, or a smaller name claims it. All others are ``updated``; equal updates share their status.
    """
    keys = ["user_id", "name"]
    own = user_tags.select(*keys)
    valid = F.col("new_name").isNull() | valid_tag_name(F.col("new_name"))
    asked = F.struct("new_name", "new_color")
    change = updates.where(valid).groupBy(*keys).agg(F.max(asked).alias("_to")).join(own, keys, "left_semi")
    change = change.select(*keys, "_to", F.col("_to.new_name").alias("_new"))
    moved = change.where("_new <> name")
    free = moved.join(own.select("user_id", F.col("name").alias("_new")), ["user_id", "_new"], "left_anti")
    winners = free.groupBy("user_id", "_new").agg(F.min("name").alias("name")).select(*keys)
    kept = change.where("_new is null or _new = name").select(*keys).unionByName(winners).withColumn("_done", F.lit(True))
    decided = lookup(change.drop("_new"), kept, keys)
    known = lookup(updates, own.withColumn("_known", F.lit(True)), keys)
    status = (F.when(F.col("_known").isNull(), "not_found").when(~valid, "invalid")
              .when(~asked.eqNullSafe(F.col("_to")), "superseded").when(F.col("_done"), "updated").otherwise("conflict"))
    return lookup(known, decided, keys).select(*updates.columns, status.alias("status"))


def update_tags(user_tags: DataFrame, updates: DataFrame) -> DataFrame:
    """Tags after the updates that :func:`update_outcomes` calls ``updated``. Favourites keep the old name."""
    done = update_outcomes(user_tags, updates.select("user_id", "name", "new_name", "new_color")).where("status = 'updated'")
    joined = lookup(user_tags, done.drop("status").distinct(), ["user_id", "name"])
    return joined.withColumns({"name": F.coalesce("new_name", "name"), "color": F.coalesce("new_color", "color")}).select(*user_tags.columns)


def delete_tags(user_tags: DataFrame, deletes: DataFrame, favorites: DataFrame) -> DataFrame:
    """Definitions left after ``deletes(user_id, name)``; a tag in use is not deleted."""
    keys = ["user_id", "name"]
    allowed = deletes.select(*keys).join(tag_uses(favorites), keys, "left_anti")
    return user_tags.join(allowed, keys, "left_anti")


def remove_tags(favorites: DataFrame, removals: DataFrame) -> DataFrame:
    """Take tags off all favourites of their user: ``removals(user_id, name)``.

    Works on exploded tags, so neither a user with very many favourites nor one with
    very many removals is gathered anywhere; only the tags of one favourite meet again.
    """
    rows = favorites.select(*schema.ANNOTATION_KEY, "created_at",
                            F.posexplode_outer("tags").alias("_pos", "_name"))
    gone = removals.select(F.lit(USER).alias("owner_kind"), F.col("user_id").alias("owner_id"),
                           F.col("name").alias("_name"), F.lit(True).alias("_gone")).distinct()
    marked = lookup(rows, gone, [*schema.OWNER_KEY, "_name"])
    kept = F.when(F.col("_gone").isNull() & F.col("_name").isNotNull(), F.struct("_pos", "_name"))
    regrouped = marked.groupBy(*schema.ANNOTATION_KEY, "created_at").agg(
        F.array_sort(F.collect_list(kept)).alias("_kept"))
    return regrouped.select(*schema.ANNOTATION_KEY, F.col("_kept._name").alias("tags"), "created_at")


def remove_one_tag(favorites: DataFrame, user_id: str, name: str) -> DataFrame:
    """Take one tag off all favourites of one user."""
    own = (F.col("owner_kind") == USER) & (F.col("owner_id") == user_id)
    tags = F.when(own, without_tag(F.col("tags"), name)).otherwise(F.col("tags"))
    return favorites.withColumn("tags", tags)
