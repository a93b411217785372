"""Page extraction on hand-written pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from venuedir.operators import pages, partitions

PAD = "<!--" + "." * 1000 + "-->"
NAME = '期刊名字</span><img alt="Nature">'


def extract(spark, body: str, url: str = "https://x/?journalid=7&a=b"):
    df = spark.createDataFrame([(1, url, PAD + NAME + body)], "page_id long, url string, html string")
    return pages.extract_text(df).first()


def table(*cells: str, header: str = "<th>大类学科</th><th>x</th>") -> str:
    row = "".join(f'<td style="padding:8px">{c}</td>' for c in cells)
    return f"<table><tr>{header}</tr><tr>{row}</tr></table>"


def zone(number: int, style: str = "") -> str:
    return f'<span class="a" style="{style}">{number}区</span>'


NESTED = '<table><tr><td style="padding:4px;">小 {n}</td><td>' + "{z}</td></tr></table>"


def full_table(n: int, top: str = "否", review: str = "否") -> str:
    big = f"工程{n} {zone(9, 'display:none')}{zone(8, 'x;display: none')}{zone(n)}"
    return table(big, NESTED.format(n=n, z=zone(n)), top, review)


def test_three_tables_by_position(spark):
    got = extract(spark, full_table(1, "是") + full_table(2, "否", "是") + full_table(3, "否", "N/A 是"))
    assert got.partition_tables == 3
    assert got.xinrui.asDict() == {"bigCategory": "工程1", "bigZone": "1区", "smallCategory": "小 1",
                                   "smallZone": "1区", "isTop": True, "isReview": False}
    assert (got.cas2025.bigZone, got.cas2025.isReview) == ("2区", True)
    assert (got.cas2023.bigZone, got.cas2023.isReview) == ("3区", False)


def test_fourth_table_is_counted_but_not_read(spark):
    got = extract(spark, "".join(full_table(n) for n in (1, 2, 3, 4)))
    assert (got.partition_tables, got.cas2023.bigZone) == (4, "3区")


def test_two_tables(spark):
    got = extract(spark, full_table(1) + full_table(2))
    assert (got.partition_tables, got.xinrui.bigZone, got.cas2025.bigZone, got.cas2023) == (2, "1区", "2区", None)


@pytest.mark.parametrize("body", [
    table("a", "b", "c"),                                                        # three cells
    "<table><tr><th>大类学科</th></tr><tr><td style='padding:8px'>a</tr></table>",  # cell never closes
    "<table><tr><th>大类学科</th></tr><tr><td>plain</td></tr></table>",            # no partition cells
])
def test_short_row_is_an_empty_partition(spark, body):
    got = extract(spark, body)
    assert got.xinrui is not None and all(v is None for v in got.xinrui)


@pytest.mark.parametrize("body", [
    "大类学科</th>",                                     # nothing behind the header
    "大类学科</th></tr><p>no row</p>",                    # no data row
    "大类学科</th></tr><tr><td style='padding:8px'>a</td>",  # row never closes
])
def test_missing_row_is_no_partition(spark, body):
    assert extract(spark, body).xinrui is None


def test_name_attribute_is_case_sensitive(spark):
    html = F.lit('期刊名字</span><img ALT="upper"><img alt="lower">')
    assert spark.range(1).select(pages.venue_name(html)).first()[0] == "lower"


def test_long_sections_keep_every_row(spark):
    ranks = "<th>CiteScore排名</th>" + "".join(SMALL.format(v) for v in ("大类：A", "Q1", "1/2") * 60)
    got = extract(spark, CITESCORE + ranks + "按JIF指标学科分区" + "." * 3000 + subject("A") * 50 + "按JCI指标学科分区" + subject("B") * 80)
    assert (len(got.citescore_rankings), len(got.jif), len(got.jci_json)) == (60, 50, 80)
    assert extract(spark, "大类学科</th></tr>" + "." * 6000 + full_table(1).split("</tr>", 1)[1]).xinrui.bigZone == "1区"


def test_sections_before_the_last_are_not_bounded(spark):
    far = "大类学科</th></tr>" + "." * 6000 + full_table(1).split("</tr>", 1)[1]
    got = extract(spark, far + full_table(2))
    assert (got.xinrui.bigZone, got.cas2025.bigZone) == ("1区", "2区")


def test_nested_rows_and_upper_case_tags(spark):
    cell = "<TABLE><TR><TD>x</TD></TR></TABLE>"
    got = extract(spark, table(f"大 {zone(2)}", cell + zone(1), "是", "是").replace("<td style", "<TD STYLE"))
    assert (got.xinrui.bigCategory, got.xinrui.smallCategory, got.xinrui.smallZone) == ("大", "x", "1区")


def test_only_small_cell_pattern_names_the_category(spark):
    got = extract(spark, table("a", f"b {zone(3)}", "", ""))
    assert (got.xinrui.smallCategory, got.xinrui.smallZone, got.xinrui.bigZone) == ("b", "3区", "")


def test_visible_zone(spark):
    html = F.lit(zone(1, "display:none") + zone(2, "color:red") + zone(3))
    assert spark.range(1).select(partitions.visible_zone(html)).first()[0] == "2区"
    assert spark.range(1).select(partitions.visible_zone(F.lit("<span>1区</span>"))).first()[0] == ""


def cells(*pairs: tuple[str, str]) -> str:
    return "".join(f"<tr><td class='l'> {a}</td>\n<td>{b}</td></tr>" for a, b in pairs)


def test_label_cells(spark):
    got = extract(spark, cells(
        ("期刊ISSN <i>(p)</i>", "<b>1234-5678</b>&nbsp;"), ("e-issn", "x"), ("出版商", "A &amp; B"),
        ("Gold OA文章占比", "about 12.5% (9%)"), ("期刊官方网站", "http://a　b"), ("SCI收录类型", "SSCI x"),
        ("2024-2025最新影响因子", "n 3.5 SPAN 9"), ("实时影响因子", "x 截止2025：4.1 y"),
        ("五年影响因子", "5.5"), ("JCI期刊引文指标", "-"), ("2024-2025自引率", "7%"),
        ("平均审稿速度", "网友分享经验：3 周"), ("平均录用比例", "x"), ("出版商", "second")))
    assert (got.issn, got.eissn, got.publisher, got.gold_oa_ratio, got.official_url) == (
        "1234-5678", "x", "A & B", "12.5%", "http://a")
    assert (got.sci_type, got.impact_factor, got.realtime_if, got.five_year_if, got.jci_value) == (
        "SSCI", "3.5", "4.1", "5.5", "")
    assert (got.self_citation_rate, got.review_speed, got.acceptance_rate, got.country) == ("7%", "3 周", "x", "")
    assert (got.name, got.journalid) == ("Nature", "7")


def test_realtime_falls_back_to_the_last_number(spark):
    assert extract(spark, cells(("实时影响因子", "about 2.5 "))).realtime_if == "2.5"
    assert extract(spark, cells(("实时影响因子", "2.5 x"))).realtime_if == ""


def test_one_pass_equals_one_pattern_per_label(spark):
    pairs = [(label, f"<b>v{i}</b>") for i, label in enumerate(pages.CELL_LABELS.values())]
    body = cells(*pairs[::2]) + "<td>出版商 without value</td> text <td>next</td><td>v</td>" + cells(*pairs[1::2])
    df = spark.createDataFrame([(body,)], "html string")
    one = pages._with_label_cells(df).select(*[pages._cell(c).alias(c) for c in pages.CELL_LABELS]).first()
    each = df.select(*[pages.cell_after_label(F.col("html"), label).alias(c)
                       for c, label in pages.CELL_LABELS.items()]).first()
    assert one == each


def test_numbers_behind_texts(spark):
    got = extract(spark, "<td>h-INDEX</td> <td> 55 </td><td>年文章数</td><td colspan='1'>1</td>"
                  '<td>x</td><td colspan="2"> 321 a</td>LetPub评分<b style="font-size:24px">8.5</b>'
                  "WOS分区等级：<i></i><span>2区</span>")
    assert (got.h_index, got.article_count, got.letpub_score, got.wos_zone) == ("55", "321", "8.5", "2区")
    bare = extract(spark, "")
    assert (bare.h_index, bare.article_count, bare.letpub_score, bare.wos_zone) == ("", "", "", "")


CITESCORE = "<th>CiteScore</th></tr><tr><td>1.5</td><td>x</td><td> 2.5</td><td>3.5</td></tr>"
SMALL = '<td style="padding:4px;">{}</td>'


def test_citescore(spark):
    ranks = "<th>CiteScore排名</th>" + "".join(SMALL.format(v) for v in ("大类：A", "Q1", "1/2", "other", "Q2", "2/2", "学科 B", "Q3", "3/3"))
    got = extract(spark, CITESCORE + ranks)
    assert (got.cite_score, got.sjr, got.snip) == ("1.5", "2.5", "3.5")
    assert [tuple(r) for r in got.citescore_rankings] == [("大类：A", "Q1", "1/2"), ("学科 B", "Q3", "3/3")]
    two = extract(spark, CITESCORE.replace("<td>3.5</td>", "") + ranks)
    assert (two.cite_score, len(two.citescore_rankings)) == ("", 2)
    assert extract(spark, ranks).citescore_rankings == []  # no CiteScore row, no rankings
    late = "<th>CiteScore</th>" + "." * 2000 + "</tr><tr><td>1</td><td>2</td><td>3</td></tr>"
    assert extract(spark, late).cite_score == "1"  # however far the data row is


def subject(name: str, quartile: str = "Q1") -> str:
    return f"学科： {name} </td><td>SCIE</td><td> {quartile}</td><td>3/50</td>"


def test_subject_rankings(spark):
    got = extract(spark, "按JIF指标学科分区" + subject("A") + subject("B", "Q2") + "按JCI指标学科分区" + subject("C"))
    assert [r.subject for r in got.jif] == ["A", "B"]
    assert [tuple(r) for r in got.jci_json] == [("C", "SCIE", "Q1", "3/50")]
    swapped = extract(spark, "按JCI指标学科分区" + subject("C") + "按JIF指标学科分区" + subject("A"))
    assert [r.subject for r in swapped.jif] == ["A"]
    assert [r.subject for r in swapped.jci_json] == ["C"]  # a section ends at the next header
    far = extract(spark, "按JIF指标学科分区" + "." * 3000 + subject("A"))
    assert [r.subject for r in far.jif] == ["A"]


def test_quality_gate(spark):
    rows = [(1, "u", PAD + NAME), (2, "u", "过于频繁" + PAD + NAME), (3, "u", NAME), (4, "u", PAD)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.reason for r in pages.rejected(df).collect()} == {2: "blocked", 3: "too_short", 4: "no_name"}
    assert [r.page_id for r in pages.extract(df).collect()] == [1]
    assert {r.page_id for r in pages.rejected(df, min_chars=5).collect()} == {2, 4}


def test_typed_fields(spark):
    df = spark.createDataFrame([(1, "u", PAD + NAME + cells(("五年影响因子", "5.5"), ("E-ISSN", "-")) + "h-index</td><td>12<")],
                               "page_id long, url string, html string")
    got = pages.extract(df).first()
    assert (got.five_year_if, got.h_index, got.eissn, got.country, got.jif) == (5.5, 12, None, None, [])


def test_sections_are_found_in_one_pass(spark):
    """A header whose last character starts the next one counts, and only its first place does."""
    from venuedir.operators import pages
    html = pages.CITESCORE_HEADER + pages.CITESCORE_HEADER[1:] + pages.JIF_HEADER + "a" + pages.JIF_HEADER + "b" + pages.JCI_HEADER + "c"
    staged = pages._with_sections(spark.createDataFrame([(html,), (None,)], "html string"))
    got = staged.select("_citescore_at", "_jif_section", "_jci_section").collect()
    assert tuple(got[0]) == (1 + 1, pages.JIF_HEADER + "a" + pages.JIF_HEADER + "b", pages.JCI_HEADER + "c")
    assert tuple(got[1]) == (None, None, None)
    text = staged._jdf.queryExecution().optimizedPlan().toString()
    assert "locate(" not in text and "instr(html" not in text
