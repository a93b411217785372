"""Reading, combining and writing."""

from __future__ import annotations

import json

import pytest
from conftest import SMALL
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from parity import derived
from venuedir import schema
from venuedir.session import shared_dir
from venuedir.sources import catalogue, records

JOURNAL = {"ccfDomain": "AI", "ccfLevel": "A", "ccfAbbr": "J", "ccfFull": "Journal", "publisher": "-", "issn": "",
           "impactFactor": 12.5, "fiveYearIF": "7.5abc", "hIndex": 12.9, "articleCount": "30 a", "sjr": "-",
           "cas2025": {"bigZone": "1区", "isTop": True}, "xinrui": {}, "cas2023": "", "jif": [], "jci": None,
           "citeScoreRankings": [{"category": "c", "zone": "Q1", "rank": "1/2"}]}
CONFERENCE = {"domain": "DB", "level": "B", "abbr": "C", "full": "Conf"}


def check_import(journals, conferences):
    rows = {r.type: r for r in catalogue.import_catalogue(journals, conferences).collect()}
    j, c = rows["journal"], rows["conference"]
    assert j.__fields__ == schema.ENTRY_COLUMNS == c.__fields__
    assert (j.publisher, j.issn, j.impact_factor, j.five_year_if, j.h_index, j.article_count, j.sjr) == (
        None, None, 12.5, 7.5, 12, 30, None)
    assert (j.cas2025.bigZone, j.cas2025.isTop, j.cas2023, j.jif, j.jci_json) == ("1区", True, None, [], None)
    assert j.xinrui is not None and all(v is None for v in j.xinrui)
    assert (j.ccf_publisher, c.ccf_publisher, c.ccf_url, c.ccf_domain, c.impact_factor) == ("", "", "", "DB", None)
    assert j.citescore_rankings[0].rank == "1/2"
    assert j.id != c.id


def test_import_document(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps({"journals": [JOURNAL], "conferences": [CONFERENCE]}, indent=2, ensure_ascii=False))
    journals, conferences, rejected = records.read_import_document(spark, str(path))
    check_import(journals, conferences)
    assert rejected.count() == 0


def test_broken_documents_are_reported(spark, tmp_path):
    whole = json.dumps({"journals": [JOURNAL], "conferences": []}, ensure_ascii=False)
    for name, text in (("good", whole), ("cut", whole[:-30])):
        (tmp_path / f"{name}.json").write_text(text)
    journals, conferences, rejected = records.read_import_document(spark, str(tmp_path))
    assert (journals.count(), conferences.count()) == (1, 0)
    assert [(r.value, r.reject_reason) for r in rejected.collect()] == [(whole[:-30], "bad_json")]
    texts = ['{"AI":[{"abbr":"a"}]}', '{"AI":[{"abbr":"b"}', "[1]", "", None, "{}"]
    documents = spark.createDataFrame([(t,) for t in texts], "value string")
    assert [r.abbr for r in records.flatten_by_domain(documents).collect()] == ["a"]
    bad = [(t, "bad_json") for t in texts[1:5]]
    assert [(r.value, r.reject_reason) for r in records.by_domain_rejects(documents).collect()] == bad
    keyed = spark.createDataFrame([('{"a":{"issn":"1"}}',), ('{"a":{"issn":',), ("7",)], "value string")
    assert [r.issn for r in records.flatten_keyed(keyed, schema.OLDER_METRIC).collect()] == ["1"]
    assert records.keyed_rejects(keyed, schema.OLDER_METRIC).count() == 2


def test_import_lines(spark, tmp_path):
    lines = tmp_path / "lines.json"
    lines.write_text(json.dumps(JOURNAL, ensure_ascii=False) + "\n{broken\n" + '{"ccfAbbr":"x"}\n')
    parsed = records.parse_records(records.read_documents(spark, str(lines), whole=False), schema.JOURNAL_IMPORT, ["ccfFull"])
    conferences = spark.createDataFrame([CONFERENCE], schema.CONFERENCE_IMPORT)
    check_import(records.accepted(parsed), conferences)
    assert {r.value[:3]: r.reject_reason for r in records.rejects(parsed).collect()} == {
        "{br": "bad_json", '{"c': "missing_field"}
    assert {r.reject_reason: r.n for r in records.reject_counts(parsed).collect()} == {
        None: 1, "bad_json": 1, "missing_field": 1}


def test_flatten(spark, tmp_path):
    path = tmp_path / "by_domain.json"
    path.write_text(json.dumps({"AI": [{"abbr": "a", "domain": "other"}, {"abbr": "b"}], "DB": []}, indent=1))
    got = records.read_by_domain(spark, str(path)).collect()
    assert [(r.domain, r.abbr) for r in got] == [("AI", "a"), ("AI", "b")]
    keyed = tmp_path / "keyed.json"
    keyed.write_text(json.dumps({"a": {"issn": "1"}, "b": {}}))
    assert {r.abbr: r.issn for r in records.read_keyed(spark, str(keyed), schema.OLDER_METRIC).collect()} == {"a": "1", "b": None}


def test_missing_lookup_reads_as_empty(spark, tmp_path):
    gone = str(tmp_path / "gone.json")
    empty = records.read_keyed(spark, gone, schema.OLDER_METRIC)
    assert (empty.columns, empty.count()) == (["abbr", "issn"], 0)
    with pytest.raises(AnalysisException):
        records.read_keyed(spark, gone, schema.OLDER_METRIC, missing_ok=False)


def test_store_and_prune(spark):
    entries = derived.entries(spark, SMALL)
    path = shared_dir(spark, "test-entries")
    catalogue.load_if_absent(entries, path)
    catalogue.load_if_absent(entries.limit(1), path)  # there already: nothing happens
    stored = catalogue.read_entries(spark, path)
    assert stored.columns == schema.ENTRY_COLUMNS
    assert stored.exceptAll(entries.select(*schema.ENTRY_COLUMNS)).isEmpty() and stored.count() == 200
    plan = stored.where("type = 'journal' and cas2025.bigZone = '1区'").select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and "cas2025.bigZone" in plan.split("PushedFilters")[1]


def test_older_files_get_new_columns(spark):
    path = shared_dir(spark, "test-older")
    derived.entries(spark, SMALL).drop("jci_json", "letpub_score").write.partitionBy("type").parquet(path)
    old = catalogue.read_entries(spark, path)
    assert old.columns == schema.ENTRY_COLUMNS and old.where("jci_json is not null").isEmpty()
    filled = catalogue.ensure_columns(old.select("id", "issn"), {"issn": F.lit("?"), "tags": F.lit("[]")})
    assert filled.where("issn is null").isEmpty() and filled.where("tags = '[]'").count() == 200


def test_defaults_come_from_the_scan(spark):
    """Old files read the default, stored NULLs stay, and a filter on the new column reaches the scan."""
    path = shared_dir(spark, "test-defaults")
    rows = derived.entries(spark, SMALL).withColumn("issn", F.when(F.col("id") % 4 != 1, F.col("issn")))
    catalogue.write_entries(rows.where("id % 2 = 0").drop("issn"), path)
    catalogue.write_entries(rows.where("id % 2 = 1"), path, mode="append")
    stored = catalogue.read_entries(spark, path, {"issn": "'?'"})
    assert stored.columns == schema.ENTRY_COLUMNS and stored.count() == 200
    assert stored.where("id % 2 = 0 and (issn <> '?' or issn is null)").isEmpty()
    assert stored.where("id % 4 = 1 and issn is not null").isEmpty() and not stored.where("id % 4 = 1").isEmpty()
    asked = stored.where("issn = '?'").select("id", "issn")
    assert asked.count() == rows.where("id % 2 = 0").count()
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(issn,?)" in plan.split("PushedFilters")[1] and "coalesce" not in plan
    with pytest.raises(ValueError, match="no such columns"):
        schema.with_defaults(schema.ENTRY, {"nothing": "1"})


def test_write_counts_what_it_writes(spark):
    good = json.dumps(JOURNAL, ensure_ascii=False)
    texts = [good, good, "{broken", '{"ccfAbbr":"x"}', None, ""]
    documents = spark.createDataFrame([(t,) for t in texts], "value string")
    parsed = records.parse_records(documents, schema.JOURNAL_IMPORT, ["ccfFull"])
    accepted, rejected, counts = records.write_counted(parsed, shared_dir(spark, "test-counted"))
    exact = {r.reject_reason: r.n for r in records.reject_counts(parsed).collect()}
    assert {k: n for k, n in counts.items() if n} == exact and counts[None] == accepted.count() == 2
    assert sorted((r.value or "", r.reject_reason) for r in rejected.collect()) == sorted(
        (r.value or "", r.reject_reason) for r in records.rejects(parsed).collect())
    assert [r.impact_factor for r in catalogue.journal_rows(accepted).collect()] == [12.5, 12.5]
    accepted, rejected, counts = records.write_counted(parsed.limit(0), shared_dir(spark, "test-counted"))
    assert (accepted.count(), rejected.count(), set(counts.values())) == (0, 0, {0})


def test_export_round_trip(spark):
    entries = derived.entries(spark, SMALL)
    path = shared_dir(spark, "test-export")
    catalogue.write_export(entries, path)
    journals = spark.read.schema(schema.JOURNAL_IMPORT).json(f"{path}/journals")
    conferences = spark.read.schema(schema.CONFERENCE_IMPORT).json(f"{path}/conferences")
    columns = ["type", "ccf_abbr", "impact_factor", "h_index", "cas2025", "jif", "wos_zone"]
    again = catalogue.import_catalogue(journals, conferences).select(*columns)
    want = entries.where("type = 'journal'").select(*columns)
    got = again.where("type = 'journal'")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert again.where("type = 'conference'").count() == entries.where("type = 'conference'").count()


def test_ids_are_stable(spark):
    rows = derived.entries(spark, SMALL).drop("id")
    a, b = catalogue.with_ids(rows), catalogue.with_ids(rows.repartition(7, "ccf_full"))
    assert a.select("id", "ccf_abbr").exceptAll(b.select("id", "ccf_abbr")).isEmpty()
    assert a.select("id").distinct().count() == 200


def test_counted_write_does_not_sort_by_the_flag(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from venuedir import schema
    from venuedir.sources import records
    name, parquet, seen = "spark.sql.maxConcurrentOutputFileWriters", DataFrameWriter.parquet, []

    def record(self, path, *rest, **more):
        seen.append(spark.conf.get(name))
        return parquet(self, path, *rest, **more)
    monkeypatch.setattr(DataFrameWriter, "parquet", record)
    before = spark.conf.get(name)
    texts = spark.createDataFrame([('{"ccfAbbr":"%d"}' % i if i % 3 else "{",) for i in range(30)], "value string")
    good, bad, counts = records.write_counted(records.parse_records(texts, schema.JOURNAL_IMPORT), str(tmp_path / "w"))
    assert seen == ["2"] and spark.conf.get(name) == before
    assert (good.count(), bad.count(), counts) == (20, 10, {None: 20, records.BAD_JSON: 10, records.MISSING_FIELD: 0})
