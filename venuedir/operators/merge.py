"""Moving guest annotations into user accounts, for all logins at once.

Input is ``logins(device_id, user_id, ts)``. Each device's first login takes its
favourites and tags along; a later login of the same device finds nothing left. Notes
that had to stay may move at a later login to another user.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.operators.annotations import guest_tags
from venuedir.operators.definitions import insert_absent
from venuedir.operators.owners import DEVICE, USER
from venuedir.operators.replay import latest
from venuedir.operators.skew import lookup
from venuedir.session import shared_dir

KEY = schema.ANNOTATION_KEY


def first_logins(logins: DataFrame) -> DataFrame:
    """One row per device: its earliest login."""
    own = logins.select("device_id", "user_id", "ts")
    return latest(own, ["device_id"], F.asc("ts"), F.asc("user_id"))


def _with_login(annotations: DataFrame, logins: DataFrame) -> DataFrame:
    """Add ``login_user, login_ts`` to guest rows whose device logs in."""
    login = first_logins(logins).select(
        F.lit(DEVICE).alias("owner_kind"), F.col("device_id").alias("owner_id"),
        F.col("user_id").alias("login_user"), F.col("ts").alias("login_ts"))
    return lookup(annotations, login, schema.OWNER_KEY)


def merge_favorites(favorites: DataFrame, logins: DataFrame) -> DataFrame:
    """A guest's favourite moves to the user unless the user has the entry; then it goes.

    Of several devices of one user the earlier login wins. The user's own row always
    wins, tags included.
    """
    moved = F.col("login_user").isNotNull()
    claims = _with_login(favorites, logins).select(
        F.when(moved, USER).otherwise(F.col("owner_kind")).alias("owner_kind"),
        F.coalesce("login_user", "owner_id").alias("owner_id"),
        "entry_id", "tags", "created_at",
        moved.alias("_moved"), F.col("login_ts").alias("_login_ts"),
        F.col("owner_id").alias("_device"),
    )
    best = latest(claims, KEY, F.asc("_moved"), F.asc("_login_ts"), F.asc("_device"))
    return best.select(*KEY, "tags", "created_at")


def _settle(claims: DataFrame) -> DataFrame:
    """``claims`` with ``_settled``, and ``_dropped`` where a settled claim takes the note or the user's entry."""
    by_note, by_user = W.partitionBy("device_id", "entry_id"), W.partitionBy("user_id", "entry_id")
    ranked = claims.withColumn("_a", F.row_number().over(by_note.orderBy("login_ts", "user_id")))
    ranked = ranked.withColumn("_b", F.row_number().over(by_user.orderBy("login_ts", "device_id")))
    ranked = ranked.withColumn("_settled", (F.col("_a") == 1) & (F.col("_b") == 1))
    gone = F.max("_settled").over(by_user)
    ranked = ranked.withColumn("_taken", gone).withColumn("_moved", F.max("_settled").over(by_note))
    return ranked.withColumn("_dropped", ~F.col("_settled") & (F.col("_taken") | F.col("_moved"))).drop("_a", "_b", "_taken", "_moved")


def merge_notes(notes: DataFrame, logins: DataFrame) -> DataFrame:
    """Notes after all logins, in their order: a guest's note moves to the user if the user has none on that entry.

    Otherwise it stays with the device and may move at a later login to another user, so the
    outcome of a login can depend on an earlier one elsewhere. A claim (device, user, entry) that is the earliest
    both of its note and of its user's entry depends on no other. One pass settles all of those: with one user
    per device that is everything. Only what is still contested goes through further rounds; equal times are ordered by device and user.
    """
    shared_dir(notes.sparkSession, "logins")  # checkpoints go to the cluster's shared folder
    taken = notes.where(F.col("owner_kind") == USER).select(F.col("owner_id").alias("user_id"), "entry_id")
    guests = notes.where(F.col("owner_kind") == DEVICE).select(F.col("owner_id").alias("device_id"), "entry_id")
    once = logins.groupBy("device_id", "user_id").agg(F.min("ts").alias("login_ts"))
    # A device may hold very many notes, a user very many entries: skew-tolerant joins.
    claims = lookup(guests, once, ["device_id"], "inner")
    claims = lookup(claims, taken, ["user_id", "entry_id"], "left_anti").select("device_id", "user_id", "entry_id", "login_ts")

    columns, moves = claims.columns, []
    while True:
        claims = _settle(claims).where("not _dropped").checkpoint()
        moves.append(claims.where("_settled").select("device_id", "user_id", "entry_id"))
        claims = claims.where("not _settled").select(*columns)
        if claims.isEmpty():
            break
    target = reduce(DataFrame.unionByName, moves).select(
        F.lit(DEVICE).alias("owner_kind"), F.col("device_id").alias("owner_id"), "entry_id", F.col("user_id").alias("_user"))
    moved = F.col("_user").isNotNull()
    return lookup(notes, target, KEY).withColumns({
        "owner_kind": F.when(moved, USER).otherwise(F.col("owner_kind")),
        "owner_id": F.coalesce("_user", "owner_id"),
    }).select(*notes.columns)


def merge_tags(user_tags: DataFrame, favorites: DataFrame, logins: DataFrame) -> DataFrame:
    """Tag definitions plus the guests' tag names the user lacks, without a colour.

    ``favorites`` is the snapshot taken before the merge.
    """
    names = guest_tags(favorites).select(
        F.col("owner_id").alias("device_id"), "name")
    added = lookup(names, first_logins(logins), ["device_id"], "inner").groupBy(
        "user_id", "name").agg(F.min("ts").alias("created_at"))
    fresh = added.select("user_id", "name", F.lit("").alias("color"), "created_at")
    return insert_absent(user_tags.select(*fresh.columns), fresh, ["user_id", "name"])
