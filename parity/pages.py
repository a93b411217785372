"""Page queries: the driver's raw pages, and detail pages composed from ``part``."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parity import derived as d
from venuedir.functions.text import strip_markup
from venuedir.operators import pages as p
from venuedir.operators.filters import is_unusable_page

# A detail page per part, as one SQL expression that both engines evaluate. Kinds
# by part: a blocked, a short and a nameless page; pages with two partition tables,
# with a short data row, with hidden zones and nested cells.
_Z = "cast(p_partkey%4+1 as string)"
_KEY = "cast(p_partkey as string)"
_SIZE = "cast(p_size as string)"
_PRICE = "cast(cast(p_retailprice as decimal(10,2)) as string)"


def _cell(label: str, value: str, tail: str = "") -> str:
    return f"'<tr><TD class=\"l\"> {label}{tail}</td>\n <td colspan=2>', {value}, '</td></tr>'"


def _partition_table(zone: str, top: str, review: str, cells: int = 4) -> str:
    columns = [
        "'<td style=\"padding: 8px;\">', p_type, ' <span class=\"z\" style=\"display:none\">9区</span>"
        f"<span style=\"color:red\">', {zone}, '区</span></td>'",
        "'<td style=\"padding:8px\"><table><tr><td style=\"padding:4px;\">', p_brand, "
        f"'</td><td><span style=\"\">', {zone}, '区</span></td></tr></table></td>'",
        f"'<TD style=\"padding:8px\">', {top}, '</TD>'",
        f"'<td style=\"padding:8px\">', {review}, '</td>'",
    ][:cells]
    return ("'<table><tr><th>大类学科</th><th>小类学科</th></tr><tr class=\"d\">', "
            + ", ".join(columns) + ", '</tr></table>'")


DETAIL_HTML = "concat(" + ", ".join([
    "'<html><body><!--', repeat('.', 900), '-->'",
    "case when p_partkey%31=5 then '系统提示：请求过于频繁' else '' end",
    "case when p_partkey%29=3 then '' else concat('<span>期刊名字</span><a><img alt=\"', p_name, '\"></a>') end",
    "'<table>'",
    _cell("期刊ISSN", f"'<b>', lpad({_KEY}, 8, '0'), '</b>&nbsp;'", " <i>(print)</i>"),
    _cell("e-issn", "case when p_partkey%2=0 then '-' else '' end"),
    _cell("出版商", "p_brand, ' &amp; Sons'"),
    _cell("出版语言", "'English'"),
    _cell("涉及的研究方向", "p_type"),
    _cell("是否OA开放访问", "case when p_partkey%2=0 then 'Yes' else 'No' end"),
    _cell("Gold OA文章占比", f"'约 ', {_SIZE}, '.5% of 100%'"),
    _cell("期刊官方网站", f"'<a>http://v.example.org/', {_KEY}, '</a> mirror'"),
    _cell("SCI收录类型", "case when p_partkey%4=0 then 'Emerging (ESCI)' when p_partkey%4=1 then 'x SCIE y' else 'none' end"),
    "case when p_partkey%4=2 then '<p>被最新的JCR期刊SCIE收录</p>' else '' end",
    _cell("2024-2025最新影响因子", f"{_PRICE}, ' (span 99)'"),
    _cell("实时影响因子", f"case when p_partkey%2=0 then concat('截止 2025-01-01：', {_SIZE}, '.25 x') else concat('about ', {_SIZE}, '.75') end"),
    _cell("五年影响因子", f"{_SIZE}, '.1'"),
    _cell("JCI期刊引文指标", f"'JCI ', {_SIZE}, '.2'"),
    _cell("2024-2025自引率", f"{_SIZE}, '%'"),
    _cell("平均审稿速度", f"'网友分享经验：', {_SIZE}, ' weeks'"),
    _cell("平均录用比例", "'网友分享经验 about 30%'"),
    f"'<tr><td>H-index</td><td> ', {_SIZE}, ' </td></tr>'",
    f"'<tr><td>年文章数 (x)</td><td colspan=\"2\"> ', {_SIZE}, '7 papers</td></tr></table>'",
    f"'<div>LetPub评分<span style=\"font-size:24px;\">', {_SIZE}, '.5</span></div>'",
    f"'<table><tr><th>CiteScore</th><th>SJR</th></tr><tr><td> ', {_SIZE}, '.4</td><td>1.5</td><td>0.9</td></tr></table>'",
    "'<table><tr><th>CiteScore排名</th></tr><tr><td style=\"padding:4px;\">大类：<b>', p_type, '</b></td>"
    f"<td style=\"padding:4px;\">Q1</td><td style=\"padding:4px;\">', {_SIZE}, ' / 70</td></tr>"
    "<tr><td style=\"padding:4px;\">other</td><td style=\"padding:4px;\">Q4</td><td style=\"padding:4px;\">1</td></tr></table>'",
    _partition_table(_Z, "'是'", "'否'"),
    _partition_table("cast(p_partkey%3+1 as string)", "case when p_partkey%10=1 then '是' else '否' end",
                     "'是'", 4),
    "case when p_partkey%7=0 then '' when p_partkey%7=1 then concat("
    + _partition_table(_Z, "'否'", "'N/A 是'", 3) + ") else concat("
    + _partition_table(_Z, "'否'", "'N/A 是'") + ") end",
    f"'<p>WOS分区等级：<b>x</b><span class=\"w\">', {_Z}, '区</span></p>'",
    f"'<h4>按JIF指标学科分区</h4><tr><td>学科：', p_type, ' </td><td>SCIE</td><td> Q', {_Z}, '</td><td>', {_SIZE}, '/50</td></tr>"
    "<tr><td>学科:', p_brand, '</td><td>ESCI</td><td>Q1</td><td>1/9</td></tr>'",
    f"'<h4>按JCI指标学科分区</h4><tr><td>学科：', p_brand, '</td><td>SCIE</td><td>Q2</td><td>', {_SIZE}, '/60</td></tr>'",
    "'</body></html>'",
]) + ")"
PAGE_HTML = f"case when p_partkey%37=7 then '<html>期刊名字</span> alt=\"x\"</html>' else {DETAIL_HTML} end"
PAGE_URL = f"concat('https://venues.example.org/?journalid=', {_KEY}, '&view=detail')"


def detail_pages(spark, sf):
    # Parts are a few bytes and their pages some kilobytes: spread the parts first.
    parts = d.table(spark, sf, "part").repartition(spark.sparkContext.defaultParallelism)
    return parts.selectExpr(
        "p_partkey as page_id", f"{PAGE_URL} as url", f"{PAGE_HTML} as html")


def _zip_text(column, *names):
    """An array of structs as text, for comparison."""
    return F.array_join(F.transform(column, lambda r: F.concat_ws("|", *[r[n] for n in names])), ";")


def flat_records(records):
    nested = {f"{v}_{f}": F.col(f"{v}.{f}") for v in ("xinrui", "cas2025", "cas2023")
              for f in ("bigCategory", "bigZone", "smallCategory", "smallZone", "isTop", "isReview")}
    lists = {
        "jif": _zip_text("jif", "subject", "subset", "quartile", "rank"),
        "jci_json": _zip_text("jci_json", "subject", "subset", "quartile", "rank"),
        "citescore_rankings": _zip_text("citescore_rankings", "category", "zone", "rank"),
    }
    present = {f"has_{v}": F.col(v).isNotNull() for v in ("xinrui", "cas2025", "cas2023")}
    return records.withColumns({**nested, **lists, **present}).drop("xinrui", "cas2025", "cas2023")


REASON = ("case when p_partkey%37=7 then 'too_short' when p_partkey%31=5 then 'blocked' "
          "when p_partkey%29=3 then 'no_name' end")


def _expected(version, zone, top, review, gap=""):
    """Fields of a partition as composed; ``gap`` is the condition under which they are NULL."""
    values = {"bigCategory": "p_type", "bigZone": f"concat({zone},'区')", "smallCategory": "p_brand",
              "smallZone": f"concat({zone},'区')", "isTop": top, "isReview": review}
    return ", ".join(f'{f"case when {gap} then null else {v} end" if gap else v} as "{version}_{f}"'
                     for f, v in values.items())


EXPECTED_SQL = f"""select p_partkey as page_id, {_KEY} as journalid, {PAGE_URL} as letpub_url, p_name as name,
  lpad({_KEY}, 8, '0') as issn, cast(null as string) as eissn, concat(p_brand, ' & Sons') as publisher,
  cast(null as string) as country, 'English' as language, cast(null as string) as periodicity,
  p_type as research_area, case when p_partkey%2=0 then 'Yes' else 'No' end as is_oa,
  concat({_SIZE}, '.5%') as gold_oa_ratio, concat('http://v.example.org/', {_KEY}) as official_url,
  cast(null as string) as submission_url,
  case p_partkey%4 when 0 then 'ESCI' when 1 then 'SCIE' when 2 then 'SCIE' end as sci_type,
  p_retailprice as impact_factor, cast(p_size + case when p_partkey%2=0 then 0.25 else 0.75 end as double) as realtime_if,
  cast(concat({_SIZE}, '.1') as double) as five_year_if, cast(concat({_SIZE}, '.2') as double) as jci_value,
  p_size as h_index, cast(concat({_SIZE}, '.4') as double) as cite_score, cast(1.5 as double) as sjr,
  cast(0.9 as double) as snip, concat({_SIZE}, '%') as self_citation_rate, concat({_SIZE}, ' weeks') as review_speed,
  'about 30%' as acceptance_rate, p_size*10+7 as article_count, cast(p_size+0.5 as double) as letpub_score, concat({_Z}, '区') as wos_zone,
  concat(p_type, '|SCIE|Q', {_Z}, '|', {_SIZE}, '/50;', p_brand, '|ESCI|Q1|1/9') as jif,
  concat(p_brand, '|SCIE|Q2|', {_SIZE}, '/60') as jci_json,
  concat('大类： ', p_type, '|Q1|', {_SIZE}, ' / 70') as citescore_rankings,
  case when p_partkey%7=0 then 2 else 3 end as partition_tables,
  {_expected('xinrui', _Z, 'true', 'false')},
  {_expected('cas2025', 'cast(p_partkey%3+1 as string)', 'p_partkey%10=1', 'true')},
  {_expected('cas2023', _Z, 'false', 'false', 'p_partkey%7<=1')},
  true as has_xinrui, true as has_cas2025, p_partkey%7<>0 as has_cas2023
from part where ({REASON}) is null"""

# --- the driver's own pages: one RE2 pattern per label, unlike the one-pass read

_RE2_WS = r"[\s\v\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def strip_sql(sql: str) -> str:
    return (f"trim(regexp_replace(replace(replace(regexp_replace({sql}, '<[^>]+>', ' ', 'g'), "
            f"'&nbsp;', ' '), '&amp;', '&'), '{_RE2_WS}+', ' ', 'g'), ' ')")


def cell_sql(label: str) -> str:
    pattern = rf"(?is)<td[^>]*>{_RE2_WS}*{re.escape(label)}.*?</td>{_RE2_WS}*<td[^>]*>(.*?)</td>"
    return strip_sql(f"regexp_extract(html, '{pattern}', 1)")


LABELLED = ["issn", "eissn", "publisher", "country", "language", "periodicity", "research_area", "is_oa"]
LINK = r'<a href="([^"]*)"[^>]*>[^<]*</a>'

QUERIES = {
    "page_text": (
        lambda spark, sf: d.table(spark, sf, "pages").select(
            "page_id", strip_markup(F.col("html")).alias("body")),
        f"select page_id, {strip_sql('html')} as body from pages"),
    "page_links": (
        lambda spark, sf: d.table(spark, sf, "pages").select("page_id", F.posexplode(
            F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("pos", "href")),
        f"select page_id, cast(unnest(range(len(l))) as integer) as pos, unnest(l) as href from "
        f"(select page_id, regexp_extract_all(html, '{LINK}', 1) as l from pages)"),
    "page_gate": (
        lambda spark, sf: d.table(spark, sf, "pages").select(
            "page_id", is_unusable_page(F.col("html")).alias("unusable")),
        "select page_id, contains(html,'速度过快') or contains(html,'过于频繁') or length(html)<1000 as unusable from pages"),
    "page_rejects": (
        lambda spark, sf: p.rejected(d.table(spark, sf, "pages")),
        "select page_id, url, case when length(html)<1000 then 'too_short' else 'no_name' end as reason from pages"),
    "page_fields_raw": (
        lambda spark, sf: p.extract_text(d.table(spark, sf, "pages")).select(
            "page_id", "name", *LABELLED, "h_index", "cite_score", "partition_tables"),
        "select page_id, '' as name, " + ", ".join(f"{cell_sql(p.CELL_LABELS[c])} as {c}" for c in LABELLED)
        + r""", regexp_extract(html, '(?is)h-index.*?</td>\s*<td[^>]*>\s*(\d+)\s*<', 1) as h_index,
          '' as cite_score, 0 as partition_tables from pages"""),
    "page_fields": (
        lambda spark, sf: flat_records(p.extract(detail_pages(spark, sf))),
        EXPECTED_SQL),
    "page_field_rejects": (
        lambda spark, sf: p.rejected(detail_pages(spark, sf)),
        f"select page_id, url, reason from (select p_partkey as page_id, {PAGE_URL} as url, {REASON} as reason from part) "
        "where reason is not null"),
    "page_label_cells": (
        lambda spark, sf: detail_pages(spark, sf).select("page_id", *[
            p.cell_after_label(F.col("html"), p.CELL_LABELS[c]).alias(c) for c in LABELLED]),
        f"select page_id, " + ", ".join(f"{cell_sql(p.CELL_LABELS[c])} as {c}" for c in LABELLED)
        + f" from (select p_partkey as page_id, {PAGE_HTML} as html from part)"),
}
