"""Id resolution and outcomes against a row-by-row model."""

from __future__ import annotations

import random

import pytest

from venuedir.operators import ledger, resolve

CAT = "issn string, full string, abbr string"
CAND = "query_kind string, query_key string, pos int, journalid string, name string"


def norm(text: str) -> str:
    return "".join(ch for ch in text.upper() if ch in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def contains(a: str, b: str) -> bool:
    return bool(a) and bool(b) and b in a


def model(row, candidates, with_abbr=False):
    issn, full, abbr = row

    def of(kind, key):
        return sorted((c[2:] for c in candidates if c[0] == kind and c[1] == key), key=lambda c: c[0])

    if issn not in ("", "-", None) and of("issn", issn):
        return of("issn", issn)[0][1], "issn"
    found = of("name", full)
    label = (lambda m: "name") if with_abbr else (lambda m: m)
    for _, i, name in found:
        if norm(name) == norm(full):
            return i, label("name_exact")
    for _, i, name in found:
        if contains(norm(name), norm(full)) or contains(norm(full), norm(name)):
            return i, label("name_partial")
    if len(found) == 1:
        return found[0][1], label("name_single")
    if with_abbr and found and abbr and abbr != full:
        for _, i, name in of("abbr", abbr):
            if contains(norm(name), norm(abbr)):
                return i, "name"
    return (found[0][1], label("name_first")) if found else (None, "none")


def world(seed):
    rng = random.Random(seed)
    words = ["Data", "data base", "DATA-BASE", "计算机", "Net", "Networks", "x"]
    catalogue = [(rng.choice(["", "-", None, "1", "2", "3"]), rng.choice(words), rng.choice(["", "D", "Net", "x"])) for _ in range(40)]
    candidates, n = [], 100
    for kind, keys in (("issn", ["1", "2"]), ("name", words[:6]), ("abbr", ["D", "Net"])):
        for key in keys:
            for pos in range(rng.randrange(0, 4)):
                n += 1
                candidates.append((kind, key, pos, str(n), rng.choice([*words, "The Net of D", "其他", "zz"])))
    return catalogue, candidates


@pytest.mark.parametrize("seed", range(6))
def test_tiers(spark, seed):
    catalogue, candidates = world(seed)
    cat = spark.createDataFrame(catalogue, CAT)
    cand = spark.createDataFrame(candidates, CAND)
    for run, with_abbr in ((resolve.resolve, False), (resolve.resolve_with_abbreviation, True)):
        got = sorted((tuple(r) for r in run(cat, cand).collect()), key=str)
        want = sorted(((*row, *model(row, candidates, with_abbr)) for row in catalogue), key=str)
        assert got == want


def test_candidates_in_page_order(spark):
    html = '<a href="?journalid=5&x=1">A <b></a><a href="?JOURNALID=6">B</a> journalid=7'
    pages = spark.createDataFrame([("name", "q", html), ("issn", "1", html), ("name", "none", "nothing")],
                                  "query_kind string, query_key string, html string")
    got = {(r.query_kind, r.pos): (r.journalid, r.name) for r in resolve.extract_candidates(pages).collect()}
    assert got == {("name", 0): ("6", "B"), ("issn", 0): ("5", None), ("issn", 1): ("6", None), ("issn", 2): ("7", None)}


def test_known_ids(spark):
    rows = [("1", "issn", "9"), ("1", "issn", "0"), ("1", "issn", None), (None, "none", "8"), ("0", "name_first", "")]
    df = spark.createDataFrame(rows, "journalid string, method string, known_id string")
    got = [(r.journalid, r.method) for r in resolve.keep_known_ids(df).collect()]
    assert got == [("9", "cached_id"), ("1", "issn"), ("1", "issn"), ("8", "cached_id"), (None, "name_first")]


def test_ledger(spark):
    rows = [("j", "d", "A", "1", "issn", "", 1), ("j", "d", "A", "1", "issn", "N", 2), ("j", "d", "A", None, "none", None, 3),
            ("j", "d", "B", "0", "none", None, 1), ("j", "d", "B", "2", "issn", "", 2), ("j", "e", "A", None, "none", None, 1)]
    attempts = spark.createDataFrame(rows, "type string, domain string, abbr string, journalid string, method string, name string, ts int")
    current = ledger.current_ledger(ledger.outcomes(attempts))
    got = {(r.domain, r.abbr): (r.status, r.journalid, r.method) for r in current.collect()}
    assert got == {("d", "A"): ("success", "1", "issn"), ("d", "B"): ("parse_failed", "2", None), ("e", "A"): ("not_found", None, None)}
    assert {r.status: r.n for r in ledger.run_summary(current).collect()} == {"success": 1, "parse_failed": 1, "not_found": 1}
    work = spark.createDataFrame([("j", "d", "A"), ("j", "e", "A"), ("j", "d", "C")], "type string, domain string, abbr string")
    assert sorted((r.domain, r.abbr) for r in ledger.remaining(work, current).collect()) == [("d", "C"), ("e", "A")]


def test_upsert_and_merge(spark):
    shape = "type string, domain string, abbr string, v string, ts int"
    old = spark.createDataFrame([("j", "d", "A", "old", 9), ("j", "d", "B", "keep", 1)], shape)
    new = spark.createDataFrame([("j", "d", "A", "n1", 1), ("j", "d", "A", "n2", 2), ("j", "d", "C", "add", 1)], shape)
    assert sorted((r.abbr, r.v) for r in ledger.upsert_results(old, new).collect()) == [("A", "n2"), ("B", "keep"), ("C", "add")]
    cat = spark.createDataFrame([("1", "cat", "x"), ("2", "cat", "y"), ("3", "c", "z")], "journalid string, publisher string, own string")
    page = spark.createDataFrame([("1", "page", 5), ("2", None, 6)], "journalid string, publisher string, extra int")
    got = sorted(tuple(r) for r in ledger.merge_extracted(cat, page).select("journalid", "publisher", "own", "extra").collect())
    assert got == [("1", "page", "x", 5), ("2", "cat", "y", 6)]
    issn = ledger.with_issn(spark.createDataFrame([("A",), ("B",)], "abbr string"),
                            spark.createDataFrame([("A", "1")], "abbr string, issn string"))
    assert sorted((r.abbr, r.issn) for r in issn.collect()) == [("A", "1"), ("B", "")]
