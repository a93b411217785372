"""WARC archives, source divergence and conversation repair against SQL, brute force and round trips."""

from __future__ import annotations

import gzip
import hashlib
import heapq
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as driver
from venuedir.llm import dialogues, divergence, warc
from venuedir.llm.common import scratch


@pytest.mark.parametrize("name", ["op11_warc", "op12_divergence"])
def test_same_rows_as_sql(spark, name):
    assert difference(driver.queries()[name](spark, SMALL), connect(SMALL), driver.oracle_sql()[name]) is None


# --- 11 ---------------------------------------------------------------------------


PAGES = "page_id long, url string, html string, headers string, payload int"


@pytest.fixture(scope="module")
def pages(spark):
    long, other = "é" * 40_000, "x" * 1000
    rows = [(1, "http://a.org/ü b\r\nX: y", long), (2, None, long), (3, "u", other), (4, "u", other), (4, "u", other), (None, "u", other),
            (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", "z" * 2000), (None, "u", "z" * 2000),
            (9, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 50), (10, "u", "\r\n\r\n")]
    return spark.createDataFrame([(*r, "h", 1) for r in rows], PAGES)


def expected_pages(rows):
    last = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    out = Counter()
    for i, _, h in rows:
        h = (h or "").encode()
        again = h in last and i != last[h]
        out[(i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", last[h] if again else None)] += 1
    return out


def test_odd_pages(spark, pages):
    path = scratch(spark, "warc")
    warc.write_warc(warc.page_records(pages), path)
    got = warc.archived_pages(warc.read_warc(spark, path)).collect()
    assert Counter(tuple(r) for r in got) == expected_pages([(r.page_id, r.url, r.html) for r in pages.collect()])
    everything = warc.read_warc(spark, path).collect()
    responses = [r for r in everything if r.record_type == "response"]
    assert all(r.payload_digest == warc.payload_digest(bytes(r.payload)) and r.http_status == 200 for r in responses)
    ids = {r.record_id for r in responses}
    assert all(r.refers_to in ids and r.payload is None for r in everything if r.record_type == "revisit")
    assert next(r.target_uri for r in everything if (r.target_uri or "").startswith("http")) == "http://a.org/ü%20b%0D%0AX:%20y"


def test_empty_pages(spark, pages):
    path = scratch(spark, "warc")
    warc.write_warc(warc.page_records(pages.where("false")), path)
    assert warc.archived_pages(warc.read_warc(spark, path)).count() == 0


def test_members_are_plain_gzip(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(pages.coalesce(1)), path)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")]
    text = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert text.count(b"WARC-Type: re") == pages.count()
    # the same records in one member, without compression, and with unknown member lengths
    shapes = {"whole.warc.gz": gzip.compress(text), "plain.warc": text,
              "each.warc.gz": b"".join(gzip.compress(part) for part in cut_records(text))}
    want = sorted(map(str, warc.archived_pages(warc.read_warc(spark, path)).collect()))
    for name, data in shapes.items():
        (tmp_path / name).write_bytes(data)
        assert sorted(map(str, warc.archived_pages(warc.read_warc(spark, str(tmp_path / name))).collect())) == want


def cut_records(text):
    out, f = [], io.BytesIO(text)
    starts = [r["offset"] for r in warc.records(io.BufferedReader(f))]
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        out.append(text[a:b])
    return out


class Counting(io.BytesIO):
    """Counts the bytes that are read."""

    seen = 0

    def readinto(self, into):
        n = super().readinto(into)
        self.seen += n
        return n


def test_unwanted_payloads_are_not_read():
    rng = np.random.default_rng(1)
    rows = [{"record_type": "response" if k % 100 == 0 else "resource", "target_uri": str(k), "payload": rng.bytes(40_000)} for k in range(300)]
    data = b"".join(warc.member(warc.record_bytes(r)) for r in rows)
    f = Counting(data)
    got = list(warc.records(io.BufferedReader(f, 1 << 12), lambda r: r["record_type"] == "response"))
    assert [r["payload"] for r in got] == [r["payload"] for r in rows[::100]] and f.seen < len(data)
    f = Counting(b"".join(warc.record_bytes(r) for r in rows))
    got = list(warc.records(io.BufferedReader(f, 1 << 12), payload=False, status=False))
    assert len(got) == 300 and f.seen < len(data) / 5


def test_predicates_reach_the_scan(spark, pages):
    path = scratch(spark, "warc")
    warc.write_warc(warc.page_records(pages), path)
    df = warc.read_warc(spark, path, ["record_type", "target_uri", "headers"]).where(
        "record_type = 'response' and target_uri like 'http%' and headers['x-page-id'] > '0'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter", 1)[1].split("\n")[0] and df.count() == 0
    reader = warc.WarcReader(df.schema, {"path": path})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("headers",), "x"),
                                    warc.Not(warc.EqualTo(("target_uri",), "u")), warc.Not(warc.StringStartsWith(("date",), "2"))]))
    assert len(kept) == 2 and len(reader.conditions) == 2
    assert not warc._passes(dict.fromkeys(warc.SCHEMA_NAMES), reader.conditions)


def test_partitions_and_manifests(spark, pages, tmp_path):
    path = str(tmp_path / "many")
    for _ in range(2):
        warc.write_warc(warc.page_records(pages.repartition(3)), path)
    (tmp_path / "many" / "part-x.warc.gz").write_bytes(b"left by a lost task")
    assert warc.archived_pages(warc.read_warc(spark, path)).count() == 2 * pages.count()
    planned = warc.WarcReader(warc.read_warc(spark, path).schema, {"path": path, "maxPartitionBytes": "1"}).partitions()
    assert all(len(p.paths) == 1 for p in planned) and len(planned) >= 2
    warc.write_warc(warc.page_records(pages), path, mode="overwrite")
    assert warc.archived_pages(warc.read_warc(spark, path)).count() == pages.count()


def test_broken_archives(spark, tmp_path):
    good = warc.member(warc.record_bytes({"record_type": "resource", "payload": b"x" * 500}))
    (tmp_path / "b.warc.gz").write_bytes(good + good[:60])
    with pytest.raises(Exception, match="b.warc.gz"):
        warc.read_warc(spark, str(tmp_path)).collect()
    rows = warc.read_warc(spark, str(tmp_path), onBadFile="mark").collect()
    assert [r.record_type for r in rows] == ["resource", "bad"]


# --- 12 ---------------------------------------------------------------------------


def brute_divergence(rows, least, top=50):
    import re
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = {}, Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts.setdefault((lang, source), Counter()).update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang, source in groups:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        same = {s: share(counts[(x, s)]) for x, s in groups if x == lang}
        whole = share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = [(o, sum(abs(same[source][t] - same[o][t]) for t in kept)) for o in same if o != source]
        terms = [(t, same[source][t] - whole[t]) for t in kept if counts[(lang, source)][t] and same[source][t] > whole[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return Counter(out)


@pytest.mark.parametrize("blocks", [(128, 400_000), (2, 40)])
def test_divergence_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", blocks[0])
    monkeypatch.setattr(divergence, "GROUP_ROWS", blocks[1])
    rng = random.Random(3)
    words = ["a", "Ab", "straße", "É", "été", "x" * 8, "y" * 9, "z" * 16, "w" * 17, "w" * 17 + "é", "語" * 40, "q" * 5000, "été" * 3, "ab" * 8]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "1", "-", "\0", "\n"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "é", None, "s3", "", "s4", "s5"])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("lonely", "xx", "two"), (None, None, None)] + [rows[0]] * 40
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "text string, lang string, source string, term string, n int")
    got = divergence.source_divergence(df, least=20, top=5).collect()
    assert Counter(tuple(r) for r in got) == brute_divergence(rows, 20, 5)
    assert divergence.source_divergence(df.where("false")).count() == 0


def test_terms_at_borders_of_rows():
    texts = [b"ab", b"", b"cd", b"x1", b"yy", b"\xc3\xa9", b"ab"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, length, row = divergence.term_runs(data, offsets)
    assert [(bytes(data[s:s + n]), r) for s, n, r in zip(start, length, row, strict=True)] == [
        (b"ab", 0), (b"cd", 2), (b"x", 3), (b"yy", 4), (b"\xc3\xa9", 5), (b"ab", 6)]


def test_radix_order():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 5, 1000).astype(np.uint64) << np.uint64(s) for s in (60, 3)]
    assert (divergence.radix_order(words, np.arange(1000)) == np.lexsort(words[::-1])).all()


# --- 13 ---------------------------------------------------------------------------


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else text.translate(str.maketrans("", "", ".!?")) if harm == 2 else text
        out += [(c, t, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired) by uniform-cost search over whole edit sequences; ``turns`` are (role, text, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            return cost, audit, "\n".join(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        for r, to in step[state].items():
            if r in names:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*lines, names[r] + ":")))
        if i < len(turns):
            role, text, flaw = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if flaw not in ("blank", "duplicate"):
                extra = 3 if flaw == "truncated" else 0
                for r, to in step[state].items():
                    if role[:1] == r:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))
                    if r in names:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, to, (*lines, f"{names[r]}:{text}")))
    raise AssertionError


def brute_repair(rows, order):
    """Expected op13 rows; ``order`` sorts turns of equal number."""
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in damage(rows):
        by[c].append((t, role, text))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], order(x[2])))
        seen, flagged = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\f\r")
            flaw = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            flagged.append((role, text, flaw))
        numbers = [t for t, *_ in turns if t is not None]
        count = Counter(f for *_, f in flagged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(flagged, flagged[1:], strict=False))
        cost, audit, text = cheapest(flagged)
        out[c] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count["blank"], count["duplicate"],
                  count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got_repair(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_registered_repair_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_repair(driver.queries()["op13_dialogues"](spark, SMALL)) == brute_repair(rows, lambda t: t)


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "User", "", None, "tool", "unknown"]
    texts = ["Yes.", "No!", "cut", "", None, " \t\n", "why? \n", "é", "a.b"]
    rows = [(c, rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for c, n in ((i, rng.randint(1, 12)) for i in range(150))
            for _ in range(n)]
    rows += [(None, k, "user", "x" * 100_000 + ".") for k in range(30)] + rows[:20]
    df = spark.createDataFrame([(*r, "k", "c") for r in rows], "conv_id long, turn long, role string, text string, key string, copy string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    texts = sorted({t if t is not None else " " for *_, t in damage(rows)})
    hashed = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("a")).collect()
    order = {r.t: r.a for r in hashed}
    assert got_repair(dialogues.op13_dialogues(spark, str(tmp_path))) == brute_repair(rows, order.__getitem__)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes?"), (1, 2, "assistant", "So."), (1, 3, "assistant", "So."), (1, 4, "user", "cut"),
            (2, 0, "system", "Be."), (3, 0, "user", " ")]
    out, report = dialogues.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    plans = {r.conv_id: (r.cost, r.audit) for r in report.collect()}
    for c in (1, 2, 3):
        turns = [(r, t, "blank" if not t.strip() else "duplicate" if (r, t) in [x[2:] for x in rows[:k] if x[0] == c]
                  else None if t[-1] in ".!?" else "truncated") for k, (i, _, r, t) in enumerate(rows) if i == c]
        cost, audit, text = cheapest(turns)
        assert plans[c] == (cost, audit)
        assert "\n".join(f"{r}:{t}" for _, r, t in got.get(c, [])) == text


def test_shared_suffixes_are_computed_once(monkeypatch):
    import pyarrow as pa
    made = []
    grown = dialogues.grown
    monkeypatch.setattr(dialogues, "grown", lambda letter, after: made.append(letter) or grown(letter, after))
    signatures = ["sua", "ua", "uaua", "suaua", "Xuaua"]
    batch = pa.RecordBatch.from_arrays([pa.array(sorted(s[::-1] for s in signatures))], ["back"])
    out = pa.Table.from_batches(list(dialogues._plans(iter([batch])))).to_pydict()
    assert dict(zip(out["back"], out["audit"], strict=True))["auaus"] == "KKKKK"
    assert len(made) == len({s[k:] for s in signatures for k in range(len(s))})
