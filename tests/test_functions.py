"""Scalar expressions on literal values."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions import clean, tags, text, zones


def values(spark, expression, inputs, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize("raw, expected", [
    ("", None), ("-", None), (" -", " -"), ("x", "x"), (None, None)])
def test_sentinels(spark, raw, expected):
    assert values(spark, clean.null_sentinel, [raw]) == [expected]


def test_lenient_numbers(spark):
    raw = ["12.5", "12.5abc", "1.2.3", "", "-", "n/a", " 7", "-3.", ".5", "1e2x", "12.5%", None]
    assert values(spark, clean.lenient_double, raw) == [
        12.5, 12.5, 1.2, None, None, None, 7.0, -3.0, 0.5, 100.0, 12.5, None]
    assert values(spark, clean.lenient_int, ["12abc", "abc", "12.9", " -4", "99999999999", None]) == [
        12, None, 12, -4, None, None]
    assert values(spark, clean.truncated_int, [12.9, -12.9, 1e12, None], "double") == [12, -12, None, None]


def test_canonical_json(spark):
    raw = ['{"b":1, "a":{"d":2,"c":[3, 4]}}', "null", '""', "[]", "{}", "bad{", None]
    assert values(spark, clean.canonical_json, raw) == [
        '{"a":{"c":[3,4],"d":2},"b":1}', None, None, "[]", "{}", None, None]


def test_fixed_decimals_follow_the_binary_value(spark):
    rng = random.Random(5)
    xs = [1.005, 0.125, 2.675, 9.125, -0.001, 0.0, 8.345, -9.125] + [
        rng.choice([rng.uniform(-999, 999), rng.randrange(10**6) / 1000, rng.randrange(9999) / 8])
        for _ in range(300)]

    def want(x: float, digits: int) -> str:
        body = abs(Decimal(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
        return ("-" if x < 0 else "") + str(body)

    for digits in (1, 2):
        got = values(spark, lambda c, d=digits: clean.fixed_decimals(c, d), xs, "double")
        assert got == [want(x, digits) for x in xs]
    assert values(spark, lambda c: clean.fixed_decimals(c, 0), [0.0, None, 2.5], "double") == ["-", "-", "3"]


def test_items():
    assert clean.parse_items(" a, ,b ,") == ["a", "b"]
    assert clean.parse_items(" , ") == clean.parse_items(None) == []


def test_constraints(spark):
    assert values(spark, clean.valid_tag_name, ["", "x", "标" * 20, "x" * 21, None]) == [
        False, True, True, False, False]
    assert values(spark, clean.valid_username, ["ab", "abc", "x" * 32, "x" * 33]) == [
        False, True, True, False]
    assert values(spark, clean.valid_entry_id, [0, 1, None], "long") == [False, True, False]


def test_markup(spark):
    raw = ["<p>a&nbsp;&amp; b</p>\n<br/>c", "　x  y﻿", "1 < 2", ""]
    assert values(spark, text.strip_markup, raw) == ["a & b c", "x y", "1 < 2", ""]
    assert values(spark, text.trim_space, ["　 a b \n"]) == ["a b"]


def test_small_extractors(spark):
    assert values(spark, text.first_number, ["IF 3.2 (5)", "none"]) == ["3.2", ""]
    assert values(spark, text.first_percentage, ["3 of 12.5% or 7%", "3"]) == ["12.5%", ""]
    assert values(spark, text.first_token, ["http://a b", "　x", ""]) == ["http://a", "", ""]
    label = lambda c: text.drop_label(c, "网友分享经验")
    assert values(spark, label, ["网友分享经验： 3 周", "a 网友分享经验 b 网友分享经验:c", "x"]) == [
        "3 周", "a b 网友分享经验:c", "x"]


def test_names(spark):
    assert values(spark, text.normalize_name, ["Journal of A&B", "计算机学报", "Straße 1"]) == [
        "JOURNALOFAB", "", "STRASSE1"]


def test_ascii_folding_only(spark):
    hits = lambda needle: (lambda c: text.contains_folded(c, needle))
    assert values(spark, hits("WIDGET"), ["a widget", "gadget"]) == [True, False]
    assert values(spark, hits("a%b"), ["xa%by", "axxb"]) == [True, False]
    assert values(spark, hits("a_b\\"), ["A_B\\", "axb\\"]) == [True, False]
    assert values(spark, hits("Ä"), ["ä", "Ä"]) == [False, True]


def test_zones(spark):
    raw = ['{"bigZone":"2区","isTop":true}', "{}", "bad", None]
    assert values(spark, zones.big_zone, raw) == ["2区", "", "", ""]
    assert values(spark, zones.top_flag, raw) == [True, False, False, False]
    empty = values(spark, zones.decode_partition, ["{}", "bad", None])
    assert empty[0] is not None and all(v is None for v in empty[0])
    assert empty[2] is None
    assert values(spark, zones.zone_number, ["1区", "Q3", "JCR4区", "x", "9区"]) == ["1", "3", "4", "", ""]
    assert values(spark, zones.zone_label, ["中科院2区", "新锐3区", "中科院中科院1区"]) == ["2区", "3区", "中科院1区"]
    assert zones.zone_text("1") == zones.zone_text("1区") == "1区"


def test_index_category(spark):
    rows = [("in SCIE", ""), ("ESCI SSCI", ""), ("", "x被最新的JCR期刊SCIE收录"), ("no", "no")]
    df = spark.createDataFrame(rows, "cell string, html string").coalesce(1)
    got = [r[0] for r in df.select(zones.index_category(F.col("cell"), F.col("html"))).collect()]
    assert got == ["SCIE", "SSCI", "SCIE", ""]


def test_tag_arrays(spark):
    assert values(spark, tags.decode_tags, ['["a","b","a"]', "null", "bad", "[]"]) == [["a", "b", "a"], None, None, []]
    arrays = [["a", "B"], [], None]
    kind = schema.TAGS.simpleString()
    assert values(spark, lambda c: tags.has_tag(c, "b"), arrays, kind) == [True, False, False]
    assert values(spark, lambda c: tags.toggled_tag(c, "a"), arrays[:2], kind) == [["B"], ["a"]]
    assert values(spark, lambda c: tags.without_tag(c, "a"), [["a", "b", "a"]], kind) == [["b"]]
    # wildcards are plain characters
    assert values(spark, lambda c: tags.has_tag(c, "a%"), [["a%"], ["ab"]], kind) == [True, False]


def test_numbers_by_json_type(spark):
    got = values(spark, clean.lenient_int, ["1.0E7", "1e7", " 12", "12.9", "12abc", "99999999999", "abc"])
    assert got == [1, 1, 12, 12, 12, None, None]
    texts = ["1e7", '"1e7"', '"1.0E7"', "12345678.5", "-12.9", "5e-4", "1e20", "99999999999", '" 12abc"', '"-"', "true", "null",
             "{}", "[1]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", F.try_parse_json("t").alias("v")).select("i", clean.json_int(F.col("v")).alias("n"), clean.json_double(F.col("v")).alias("x"))
    made = {r.i: (r.n, r.x) for r in rows.collect()}
    nothing = (None, None)
    assert [made[i] for i in range(len(texts))] == [
        (10_000_000, 1e7), (1, 1e7), (1, 1e7), (12_345_678, 12345678.5), (-12, -12.9), (0, 5e-4), (None, 1e20), (None, 99999999999.0),
        (12, 12.0), nothing, nothing, nothing, nothing, nothing, nothing]
