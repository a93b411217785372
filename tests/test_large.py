"""Documents cut into many pieces equal documents read whole."""

from __future__ import annotations

import json
import random
from collections import Counter
from pathlib import Path

import pytest

from conftest import SMALL

from parity import derived as d
from venuedir import schema
from venuedir.sources import catalogue, large, records


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


ODD_TEXTS = ["plain", 'quo"te', "bra}ce", "{[", "\\", '\\"}', "é😀", "a,b", "]},", ""]


def some(rng):
    return rng.choice(ODD_TEXTS) + rng.choice(ODD_TEXTS)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 1), (3, None)])
def test_by_domain(spark, tmp_path, small_splits, monkeypatch, seed, indent):
    monkeypatch.setattr(large, "GROUPS", 7)
    rng = random.Random(seed)
    for k in range(3):
        document = {f"d{j}{some(rng)}": [{"abbr": some(rng), "full": some(rng), "level": "A"} if rng.random() < 0.9 else
                                         rng.choice([7, "te}xt", None, [{"abbr": "in"}]]) for _ in range(rng.randint(0, 25))] for j in range(rng.randint(0, 6))}
        if rng.random() < 0.5:
            document["odd"] = 5
        (tmp_path / f"{k}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False) + rng.choice(["", "\n"]))
    good, bad = large.read_large_by_domain(spark, str(tmp_path))
    documents = records.read_documents(spark, str(tmp_path))
    assert rows(good) == rows(records.flatten_by_domain(documents))
    assert Counter((r.key) for r in bad.collect()) == Counter(r.key for r in records.by_domain_rejects(documents).collect())


@pytest.mark.parametrize("seed,indent", [(4, None), (5, 2)])
def test_keyed(spark, tmp_path, small_splits, seed, indent):
    rng = random.Random(seed)
    document = {f"k{j}{some(rng)}": {"issn": some(rng)} if rng.random() < 0.8 else rng.choice([7, "x{y", None, [1, {"issn": "2"}], {"issn": {"a": 1}}])
                for j in range(120)}
    (tmp_path / "k.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("{}")
    documents = records.read_documents(spark, str(tmp_path))
    good, bad = large.read_large_keyed(spark, str(tmp_path), schema.OLDER_METRIC)
    assert rows(good) == rows(records.flatten_keyed(documents, schema.OLDER_METRIC))
    assert Counter(r.key for r in bad.collect()) == Counter(r.key for r in records.keyed_rejects(documents, schema.OLDER_METRIC).collect())


def test_cut_document_keeps_its_whole_records(spark, tmp_path, small_splits):
    text = json.dumps({"a": [{"abbr": f"n{k}"} for k in range(100)]})
    (tmp_path / "cut.json").write_text(text[:-10])
    good, bad = large.read_large_by_domain(spark, str(tmp_path))
    assert good.count() == 99 and bad.count() == 1


def test_export_in_parts_and_back(spark, tmp_path, small_splits):
    entries = d.entries(spark, SMALL)
    path = str(tmp_path / "export")
    large.write_large_export(entries, path)
    parts = sorted(p for p in Path(path).iterdir() if p.name.startswith("part-"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert [len(document[k]) for k in ("journals", "conferences")] == [entries.where(f"type='{t}'").count() for t in ("journal", "conference")]
    journals, conferences, rejected = large.read_large_import(spark, path, whole_folder=True)
    assert rejected.count() == 0
    back = catalogue.import_catalogue(journals, conferences)
    assert back.count() == entries.count()
    assert rows(back.select("type", "ccf_abbr", "impact_factor", "wos_zone")) == rows(entries.select("type", "ccf_abbr", "impact_factor", "wos_zone").selectExpr(
        "type", "ccf_abbr", "impact_factor", "case when type='journal' then wos_zone end"))


def test_one_document_is_read_in_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "big.json").write_text(json.dumps({"journals": [{"ccfAbbr": f"j{k}", "ccfFull": "x" * 50} for k in range(500)], "conferences": []}))
    pieces = spark.read.option("lineSep", large.END).text(str(tmp_path / "big.json"))
    assert pieces.rdd.getNumPartitions() > 20
    journals, conferences, rejected = large.read_large_import(spark, str(tmp_path / "big.json"))
    assert (journals.select("ccfAbbr").distinct().count(), conferences.count(), rejected.count()) == (500, 0, 0)
