"""References between annotations, entries and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.operators.owners import USER
from venuedir.operators.skew import lookup


def with_known_entry(annotations: DataFrame, entries: DataFrame) -> DataFrame:
    """Annotations whose entry exists."""
    return lookup(annotations, entries.select(F.col("id").alias("entry_id")), ["entry_id"], "left_semi")


def orphans(annotations: DataFrame, entries: DataFrame) -> DataFrame:
    """Annotations whose entry does not exist."""
    return lookup(annotations, entries.select(F.col("id").alias("entry_id")), ["entry_id"], "left_anti")


def ownerless(annotations: DataFrame, users: DataFrame, id_column: str = "user_id") -> DataFrame:
    """User-owned annotations whose user does not exist. Devices need no registration."""
    known = users.select(F.col(id_column).alias("owner_id"))
    return lookup(annotations.where(F.col("owner_kind") == USER), known, ["owner_id"], "left_anti")


def without_entries(annotations: DataFrame, deleted_entries: DataFrame) -> DataFrame:
    """Cascade: annotations left after entries ``(id)`` are deleted."""
    gone = deleted_entries.select(F.col("id").alias("entry_id"))
    return lookup(annotations, gone, ["entry_id"], "left_anti").select(*annotations.columns)


def without_users(annotations: DataFrame, deleted_users: DataFrame,
                  id_column: str = "user_id") -> DataFrame:
    """Cascade: favourites or notes left after users are deleted."""
    gone = deleted_users.select(F.lit(USER).alias("owner_kind"), F.col(id_column).alias("owner_id"))
    return lookup(annotations, gone, schema.OWNER_KEY, "left_anti").select(*annotations.columns)


def tags_without_users(user_tags: DataFrame, deleted_users: DataFrame,
                       id_column: str = "user_id") -> DataFrame:
    """Cascade: tag definitions left after users are deleted."""
    gone = deleted_users.select(F.col(id_column).alias("user_id"))
    return lookup(user_tags, gone, ["user_id"], "left_anti").select(*user_tags.columns)
