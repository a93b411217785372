"""Replays against a one-operation-at-a-time model, in batch and as a stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from venuedir import schema
from venuedir.operators import replay
from venuedir.session import shared_dir
from venuedir.streaming import changes
from venuedir.streaming.changes import ChangeStore, start_replay

START = datetime(2024, 1, 1)
OPS = [*replay.FAVORITE_OPS, *replay.NOTE_OPS]


def random_log(seed: int, n: int, hot: float = 0.5):
    """Few keys, one of them with a large share, and several events per instant."""
    rng = random.Random(seed)
    rows = []
    for event in range(n):
        owner = ("user", "hot", 1) if rng.random() < hot else (
            rng.choice(["user", "device"]), str(rng.randrange(3)), rng.randrange(3))
        rows.append((event, START + timedelta(seconds=rng.randrange(n // 3)), *owner,
                     rng.choice(OPS), [f"t{rng.randrange(4)}"], rng.choice(["", f"n{event}"])))
    return rows


def model(rows):
    """What the single-row statements would leave behind."""
    favorites, notes = {}, {}
    for event, ts, kind, owner, entry, op, tags, content in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (kind, owner, entry)
        if op == replay.FAV_ADD:
            favorites.setdefault(key, (tags, ts))
        elif op == replay.FAV_REMOVE:
            favorites.pop(key, None)
        elif op == replay.FAV_TAGS and key in favorites:
            favorites[key] = (tags, favorites[key][1])
        elif op == replay.NOTE_UPSERT:
            notes[key] = (content, ts)
        elif op == replay.NOTE_DELETE:
            notes.pop(key, None)
    return favorites, notes


def as_dict(df, *fields):
    return {tuple(r[k] for k in schema.ANNOTATION_KEY): tuple(r[f] for f in fields) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_the_model(spark, seed):
    rows = random_log(seed, 400)
    ops = spark.createDataFrame(rows, schema.OPERATION).repartition(5)
    favorites, notes = model(rows)
    assert as_dict(replay.replay_favorites(ops), "tags", "created_at") == favorites
    assert as_dict(replay.replay_notes(ops), "content", "updated_at") == notes


def test_repeated_events_change_nothing(spark):
    rows = random_log(9, 200)
    ops = spark.createDataFrame(rows + rows[::2], schema.OPERATION)
    favorites, notes = model(rows)
    assert as_dict(replay.replay_favorites(ops), "tags", "created_at") == favorites
    assert as_dict(replay.replay_notes(ops), "content", "updated_at") == notes


def test_toggles(spark):
    rows = [(i, START + timedelta(seconds=i), "user", "1", i % 2, replay.FAV_TOGGLE, None, None) for i in range(5)]
    ops = spark.createDataFrame(rows + rows, schema.OPERATION)
    assert as_dict(replay.replay_toggles(ops), "created_at") == {("user", "1", 0): (START + timedelta(seconds=4),)}


def test_notes_are_trimmed_before_logging(spark):
    rows = [(1, START, "user", "1", 1, replay.NOTE_UPSERT, None, "　 a b \n")]
    ops = replay.trimmed_notes(spark.createDataFrame(rows, schema.OPERATION))
    assert as_dict(replay.replay_notes(ops), "content") == {("user", "1", 1): ("a b",)}


def test_micro_batches_equal_the_batch_replay(spark):
    """Late operations, a batch that runs twice, and a compaction in between."""
    rows = random_log(21, 240)
    store = ChangeStore(shared_dir(spark, "test-changes"), buckets=3)
    parts = [rows[i::4] for i in range(4)]  # every part reaches back over the whole time
    for batch_id, part in enumerate(parts):
        batch = spark.createDataFrame(part, schema.OPERATION)
        store.apply(batch, batch_id)
        if batch_id == 1:
            store.apply(batch, batch_id)
            store.compact(spark, upto=1)
        favorites, notes = model([r for p in parts[: batch_id + 1] for r in p])
        assert as_dict(store.favorites(spark), "tags", "created_at") == favorites
        assert as_dict(store.notes(spark), "content", "updated_at") == notes
    store.compact(spark, upto=3)
    assert as_dict(store.favorites(spark), "tags", "created_at") == model(rows)[0]
    assert as_dict(store.notes(spark), "content", "updated_at") == model(rows)[1]


def test_condensed_log_goes_on_like_the_whole(spark):
    """Late operations included: the halves overlap in time."""
    rows = random_log(5, 300)
    early, late = rows[::2], rows[1::2]
    kept = replay.condensed(spark.createDataFrame(early, schema.OPERATION)).select(*schema.OPERATION.fieldNames())
    ops = kept.unionByName(spark.createDataFrame(late, schema.OPERATION))
    favorites, notes = model(rows)
    assert as_dict(replay.replay_favorites(ops), "tags", "created_at") == favorites
    assert as_dict(replay.replay_notes(ops), "content", "updated_at") == notes


def test_what_a_batch_reads_does_not_grow_with_the_history(spark):
    """The same keys act again and again; compaction leaves one version of each bucket."""
    store = ChangeStore(shared_dir(spark, "test-bounded"), buckets=2)
    sizes = []
    for batch_id in range(5):
        rows = [(batch_id * 40 + i, START + timedelta(days=batch_id, seconds=i), "user", str(i % 4), 1,
                 OPS[(i // 4) % len(OPS)], ["t"], "n") for i in range(40)]
        store.apply(spark.createDataFrame(rows, schema.OPERATION), batch_id)
        sizes.append(store.operations(spark).count())
    assert len(set(sizes)) == 1
    store.compact(spark, upto=4)
    assert store.operations(spark).count() == sizes[0]
    assert all(v.kind == "base" or v.batch > min(w.batch for w in store._live(spark)) for v in store._live(spark))


def test_a_batch_writes_what_it_holds(spark, monkeypatch):
    """Small batches on a large state add runs; bases are written anew only now and then, and nothing is lost."""
    monkeypatch.setattr(changes, "MAX_RUNS", 5)
    store, rows = ChangeStore(shared_dir(spark, "test-runs"), buckets=2), []
    rewritten = []
    for batch_id in range(9):
        n = 400 if batch_id == 0 else 4
        part = [(batch_id * 1000 + i, START + timedelta(days=batch_id, seconds=i), "user", str(i), batch_id, "fav_add", ["t"], None) for i in range(n)]
        rows += part
        store.apply(spark.createDataFrame(part, schema.OPERATION), batch_id)
        rewritten.append(sum(v.rows for v in store._live(spark) if v.batch == batch_id))
    assert sum(n > 100 for n in rewritten[1:]) <= 2 and sorted(rewritten)[4] <= 4
    assert store.operations(spark).count() == len(rows)
    store.compact(spark, upto=8)
    assert as_dict(store.favorites(spark), "tags", "created_at") == model(rows)[0]
    store.apply(spark.createDataFrame([(99_999, START + timedelta(days=99), "user", "1", 0, "fav_remove", None, None)], schema.OPERATION), 9)
    assert store.favorites(spark).count() == len(rows) - 1


def test_late_logins(spark):
    """Operations and logins in any order over six batches equal one merge of everything."""
    from venuedir.plans.login import Annotations, merge_logins
    log = random_log(8, 240)
    logins = [(5000 + i, START + timedelta(minutes=7 * i), "device", str(i % 5), None, "login", None, str(i % 3)) for i in range(12)]
    mixed = (log + logins)[::-1]
    store = ChangeStore(shared_dir(spark, "test-logins"), buckets=2)
    for batch_id in range(6):
        store.apply(spark.createDataFrame(mixed[batch_id::6], schema.OPERATION), batch_id)
    tags = spark.createDataFrame([("0", "t", "red", START)], "user_id string, name string, color string, created_at timestamp_ntz")
    ops = spark.createDataFrame(log, schema.OPERATION)
    before = Annotations(replay.replay_favorites(ops), replay.replay_notes(ops), tags)
    table = spark.createDataFrame([(d, u, t) for _, t, _, d, _, _, _, u in logins], "device_id string, user_id string, ts timestamp_ntz")
    want, got = merge_logins(before, table), store.annotations(spark, tags)
    for name in ("favorites", "notes", "user_tags"):
        a, b = (sorted(map(str, getattr(x, name).collect())) for x in (want, got))
        assert a == b


def test_file_stream(spark):
    rows = random_log(33, 150)
    source = shared_dir(spark, "test-source")
    spark.createDataFrame(rows, schema.OPERATION).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(schema.OPERATION).option("maxFilesPerTrigger", 1).parquet(source)
    store = ChangeStore(shared_dir(spark, "test-stream"), buckets=2)
    start_replay(stream, store).awaitTermination()
    assert {r["at"] for r in spark.read.parquet(f"{store.path}/versions").select("at").distinct().collect()} <= {0, 1, 2}
    favorites, notes = model(rows)
    assert as_dict(store.favorites(spark), "tags", "created_at") == favorites
    assert as_dict(store.notes(spark), "content", "updated_at") == notes


def test_first_run_of_a_bucket_stands_for_its_base(spark, tmp_path):
    """What one batch has condensed is not condensed again before there is something to merge it with."""
    from venuedir.streaming.changes import ChangeStore
    rows = [(i, "user", str(i % 5), i % 3, "fav_add" if i % 2 else "note_upsert") for i in range(60)]
    ops = spark.createDataFrame(rows, "event_id long, owner_kind string, owner_id string, entry_id long, op string").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, event_id) as ts", "owner_kind", "owner_id", "entry_id", "op",
        "cast(null as array<string>) as tags", "'n' as content")
    store = ChangeStore(str(tmp_path / "s"), buckets=2)
    store.apply(ops.where("event_id < 30"), 0)
    assert not list(tmp_path.glob("s/operations/batch_id=0/kind=base/*"))
    store.apply(ops.where("event_id >= 30"), 1)
    assert list(tmp_path.glob("s/operations/batch_id=1/kind=base/*"))
    from venuedir.operators.replay import replay_favorites, replay_notes
    for got, want in ((store.favorites(spark), replay_favorites(ops)), (store.notes(spark), replay_notes(ops))):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
