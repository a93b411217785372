"""Merges against logins handled one after the other."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from venuedir import schema
from venuedir.operators import definitions, merge
from venuedir.plans.login import Annotations, merge_logins

START = datetime(2024, 1, 1)
FAV = "owner_kind string, owner_id string, entry_id long, tags array<string>, created_at timestamp_ntz"
NOTE = "owner_kind string, owner_id string, entry_id long, content string, updated_at timestamp_ntz"
TAG = "user_id string, name string, color string, created_at timestamp_ntz"
LOGIN = "device_id string, user_id string, ts timestamp_ntz"


def world(seed: int, many_users: bool):
    rng = random.Random(seed)
    owners = [("device", f"d{i}") for i in range(6)] + [("user", f"u{i}") for i in range(3)]
    keys = {(*rng.choice(owners), rng.randrange(5)) for _ in range(40)}
    favorites = [(*k, [rng.choice("abc") for _ in range(rng.randrange(3))],
                  START + timedelta(days=rng.randrange(9))) for k in sorted(keys)]
    notes = [(*k, f"{k}", START) for k in sorted({(*rng.choice(owners), rng.randrange(5)) for _ in range(40)})]
    tags = [("u0", "a", "red", START)]
    times = rng.sample(range(1000), 20)
    logins = []
    for i in range(5):  # d5 stays a guest
        for _ in range(rng.randrange(1, 4) if many_users else 1):
            logins.append((f"d{i}", f"u{rng.randrange(3)}", START + timedelta(seconds=times.pop())))
    return favorites, notes, tags, logins


def model(favorites, notes, tags, logins):
    fav = {r[:3]: r[3:] for r in favorites}
    note = {r[:3]: r[3:] for r in notes}
    names = {(r[0], r[1]): r[2] for r in tags}
    for device, user, _ in sorted(logins, key=lambda r: (r[2], r[0], r[1])):
        for key in [k for k in fav if k[:2] == ("device", device)]:
            for name in fav[key][0]:
                names.setdefault((user, name), "")
        for key in [k for k in fav if k[:2] == ("device", device)]:
            row = fav.pop(key)
            fav.setdefault(("user", user, key[2]), row)
        for key in [k for k in note if k[:2] == ("device", device)]:
            if ("user", user, key[2]) not in note:
                note["user", user, key[2]] = note.pop(key)
    return fav, note, names


def keyed(df):
    return {tuple(r[k] for k in schema.ANNOTATION_KEY): tuple(r[f] for f in df.columns if f not in schema.ANNOTATION_KEY)
            for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("many_users", [False, True])
def test_merge_equals_the_model(spark, seed, many_users):
    favorites, notes, tags, logins = world(seed, many_users)
    before = Annotations(spark.createDataFrame(favorites, FAV), spark.createDataFrame(notes, NOTE),
                         spark.createDataFrame(tags, TAG))
    login_map = spark.createDataFrame(logins, LOGIN)
    after = merge_logins(before, login_map)
    fav, note, names = model(favorites, notes, tags, logins)
    assert keyed(after.favorites) == fav
    assert keyed(after.notes) == note
    assert {(r.user_id, r.name): r.color for r in after.user_tags.collect()} == names
    if not many_users:
        assert keyed(merge.merge_notes(before.notes, login_map)) == note


def test_merging_twice_is_merging_once(spark):
    favorites, notes, tags, logins = world(7, False)
    login_map = spark.createDataFrame(logins, LOGIN)
    once = merge.merge_favorites(spark.createDataFrame(favorites, FAV), login_map)
    assert keyed(merge.merge_favorites(once, login_map)) == keyed(once)
    first = merge.merge_notes(spark.createDataFrame(notes, NOTE), login_map)
    assert keyed(merge.merge_notes(first, login_map)) == keyed(first)


def test_guest_note_stays_when_the_user_has_one(spark):
    notes = spark.createDataFrame(
        [("user", "u", 1, "user", START), ("device", "d", 1, "guest", START), ("device", "d", 2, "moves", START)], NOTE)
    logins = spark.createDataFrame([("d", "u", START)], LOGIN)
    assert {k: v[0] for k, v in keyed(merge.merge_notes(notes, logins)).items()} == {
        ("user", "u", 1): "user", ("device", "d", 1): "guest", ("user", "u", 2): "moves"}


def test_tag_definitions(spark):
    defs = spark.createDataFrame([("1", "a", "red", START), ("1", "b", "", START), ("2", "a", "", START)], TAG)
    favorites = spark.createDataFrame([("user", "1", 1, ["a", "c", "a"], START), ("user", "2", 1, [], START),
                                       ("device", "1", 1, ["b"], START)], FAV)
    gone = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "user_id string, name string")
    left = definitions.delete_tags(defs, gone, favorites)
    assert [(r.user_id, r.name) for r in left.collect()] == [("1", "a")]  # in use by its user
    stripped = keyed(definitions.remove_tags(favorites, gone))
    assert {k: v[0] for k, v in stripped.items()} == {
        ("user", "1", 1): ["c"], ("user", "2", 1): [], ("device", "1", 1): ["b"]}
    one = keyed(definitions.remove_one_tag(favorites, "1", "c"))
    assert one["user", "1", 1][0] == ["a", "a"]
    updates = spark.createDataFrame([("1", "a", "z", None)], "user_id string, name string, new_name string, new_color string")
    changed = definitions.update_tags(defs, updates)
    assert sorted((r.user_id, r.name, r.color) for r in changed.collect()) == [
        ("1", "b", ""), ("1", "z", "red"), ("2", "a", "")]


def test_creating_tags(spark):
    defs = spark.createDataFrame([("1", "a", "red", START)], TAG)
    asked = [(1, "1", "a", "", START), (2, "1", "n", "", START), (3, "1", "n", "", START), (4, "2", "a", "", START),
             (5, "1", "", "", START), (6, "1", "x" * 21, "", START)]
    requests = spark.createDataFrame(asked, "request_id long, " + TAG)
    got = {r.request_id: r.status for r in definitions.create_tags(defs, requests).collect()}
    assert got == {1: "conflict", 2: "inserted", 3: "conflict", 4: "inserted", 5: "invalid", 6: "invalid"}


def test_registry(spark):
    users = spark.createDataFrame([("ann", START)], "username string, created_at timestamp_ntz")
    asked = [(1, "ann", START), (2, "bob", START), (3, "bob", START), (4, "al", START)]
    requests = spark.createDataFrame(asked, "request_id long, username string, created_at timestamp_ntz")
    got = {r.request_id: r.status for r in definitions.register_users(users, requests).collect()}
    assert got == {1: "conflict", 2: "inserted", 3: "conflict", 4: "invalid"}
    names = spark.createDataFrame([("ann",), ("ann",), ("zoe",)], "username string")
    assert [r.username for r in definitions.lookup_users(users, names).collect()] == ["ann"]


def test_insert_if_absent(spark):
    old = spark.createDataFrame([("1", "a", "red", START)], TAG)
    new = spark.createDataFrame([("1", "a", "x", START), ("1", "b", "late", START + timedelta(1)), ("1", "b", "first", START)], TAG)
    got = definitions.insert_absent(old, new, ["user_id", "name"])
    assert sorted((r.name, r.color) for r in got.collect()) == [("a", "red"), ("b", "first")]


def test_update_tags_keeps_names_unique(spark):
    defs = spark.createDataFrame([("1", n, "c") for n in "abcd"], "user_id string, name string, color string")
    updates = spark.createDataFrame(
        [("1", "a", "b", "x"), ("1", "c", "z", "y"), ("1", "c", "z", "y"), ("1", "d", "z", "w"), ("2", "b", "q", None), ("1", "b", None, "r")],
        "user_id string, name string, new_name string, new_color string")
    got = sorted((r.name, r.color) for r in definitions.update_tags(defs, updates).collect())
    assert got == [("a", "c"), ("b", "r"), ("d", "c"), ("z", "y")]
