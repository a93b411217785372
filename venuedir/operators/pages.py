"""Attributes of venues from a table of raw pages ``(page_id, url, html)``.

One scan, built-in expressions only. Sections are cut out as columns before they are
searched, and a pattern that starts at a fixed text is tried at its first occurrence
only, so every search is linear in the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions import clean
from venuedir.functions.text import (
    WS, drop_label, first_number, first_percentage, first_token, strip_markup, trim_space,
)
from venuedir.functions.zones import index_category
from venuedir.operators.filters import MIN_PAGE_CHARS, is_blocked_page
from venuedir.operators.partitions import TABLE_HEADER, VERSIONS, with_partitions

# Output column -> label of its table cell. Fixed values.
CELL_LABELS = {
    "issn": "期刊ISSN",
    "eissn": "E-ISSN",
    "publisher": "出版商",
    "country": "出版国家或地区",
    "language": "出版语言",
    "periodicity": "出版周期",
    "research_area": "涉及的研究方向",
    "is_oa": "是否OA开放访问",
    "gold_oa_ratio": "Gold OA文章占比",
    "official_url": "期刊官方网站",
    "submission_url": "期刊投稿网址",
    "sci_type": "SCI收录类型",
    "impact_factor": "2024-2025最新影响因子",
    "realtime_if": "实时影响因子",
    "five_year_if": "五年影响因子",
    "jci_value": "JCI期刊引文指标",
    "self_citation_rate": "2024-2025自引率",
    "review_speed": "平均审稿速度",
    "acceptance_rate": "平均录用比例",
}
SHARED_EXPERIENCE = "网友分享经验"

# Other fixed values: headers and phrases of a page, and the patterns of its fields and rows.
CITESCORE_HEADER = ">CiteScore</th>"
RANKING_HEADER = ">CiteScore排名</th>"
RANKING_WORDS = ["大类", "小类", "学科"]
JIF_HEADER = "按JIF指标学科分区"
JCI_HEADER = "按JCI指标学科分区"

# Headers and the column of the first piece that starts with each; none is the beginning of another.
_HEADERS = {CITESCORE_HEADER: "_citescore_at", RANKING_HEADER: "_ranking_at", JIF_HEADER: "_jif_at",
            JCI_HEADER: "_jci_at", TABLE_HEADER: "_table_at"}
_HEADER_CUT = f"(?=[{''.join(sorted({h[0] for h in _HEADERS}))}])(?={'|'.join(map(re.escape, _HEADERS))})"

# Fields behind a fixed text as (the text, the rest of the pattern).
_NAME = ("期刊名字</span>", r'(?-i:.*?alt="([^"]+)")')
_H_INDEX = ("(?i)h-index", rf".*?</td>{WS}*<td[^>]*>{WS}*(\d+){WS}*<")
_ARTICLES = ("(?i)<td[^>]*>年文章数", rf'.*?</td>{WS}*<td[^>]*colspan="2"[^>]*>(.*?)</td>')
_SCORE = ("(?i)LetPub评分", r".*?font-size:24px[^>]*>([\d.]+)")
_JCR_ZONE = ("(?i)WOS分区等级[：:]*", r".*?<span[^>]*>(\d区)</span>")
_DATA_ROW = r"(?s)\A(?>.*?</tr>)(?>.*?(?=<tr))(<tr.*?</tr>)"
_NUMBER_CELL = rf"(?i)<td[^>]*>{WS}*([\d.]+){WS}*</td>"
_SMALL_CELL = r'<td[^>]*style="padding:4px;">(.*?)</td>'
_RANKING_ROW = rf"(?is){_SMALL_CELL}{WS}*{_SMALL_CELL}{WS}*{_SMALL_CELL}"
_SUBJECT_ROW = (rf"(?i)学科[：:]{WS}*([^<]+)</td>{WS}*<td[^>]*>{WS}*(\w+){WS}*</td>{WS}*"
                rf"<td[^>]*>{WS}*(Q\d){WS}*</td>{WS}*<td[^>]*>{WS}*(\d+/\d+)")

BLOCKED, TOO_SHORT, NO_NAME = "blocked", "too_short", "no_name"


def cell_after_label(html: Column, label: str) -> Column:
    """Stripped text of the cell that follows a label cell, ``''`` when there is none."""
    pattern = rf"(?is)<td[^>]*>{WS}*{re.escape(label)}.*?</td>{WS}*<td[^>]*>(.*?)</td>"
    return strip_markup(F.regexp_extract(html, pattern, 1))


def _with_label_cells(pages: DataFrame) -> DataFrame:
    """Add arrays of the labels found (lower case) and of the stripped cells behind them.

    One pass over the page for all labels, where one pattern per label takes
    nineteen: each match consumes the tag only and looks ahead for the label, the
    rest of its cell and the next cell. No label is the beginning of another.
    """
    any_label = "|".join(re.escape(label) for label in CELL_LABELS.values())
    both = rf"(?is)<td[^>]*>{WS}*(?=((?:{any_label}).*?</td>{WS}*<td[^>]*>.*?</td>))"
    value = rf"(?is)\A.*?</td>{WS}*<td[^>]*>(.*?)</td>\z"
    found = F.col("_pairs")
    staged = pages.withColumn("_pairs", F.regexp_extract_all("html", F.lit(both), F.lit(1)))
    return staged.withColumns({
        "_labels": F.transform(found, lambda pair: F.lower(F.regexp_extract(pair, rf"(?i)\A(?:{any_label})", 0))),
        "_values": F.transform(found, lambda pair: strip_markup(F.regexp_extract(pair, value, 1))),
    })


def _cell(column: str) -> Column:
    """First cell of a label; ``''`` when the page lacks it."""
    at = F.array_position("_labels", CELL_LABELS[column].lower()).cast("int") - 1
    return F.coalesce(F.get(F.col("_values"), at), F.lit(""))


def _header_kind(piece: Column, i: Column) -> Column:
    """Which header a piece starts with; the piece in front of all headers has none.

    A header's last character may belong to the next piece, where it starts another one.
    """
    kind = F.when(i == 0, F.lit(None).cast("int"))
    for k, header in enumerate(_HEADERS):
        kind = kind.when(piece.startswith(header[:-1]), k)
    return kind


def _with_sections(pages: DataFrame) -> DataFrame:
    """Cut out the sections that are searched for repeated rows; NULL where there is none.

    A section ends where the next one begins, at a later header of another kind, or with the page.
    The CiteScore data row needs no end, as its own tags delimit it. One pass cuts the page in front of
    all headers; the rest counts pieces.
    """
    staged = pages.withColumn("_cuts", F.split(F.concat(F.lit(" "), "html"), _HEADER_CUT, -1))
    staged = staged.withColumn("_kinds", F.transform("_cuts", _header_kind))
    staged = staged.withColumns({
        name: F.array_position("_kinds", F.lit(k)).cast("int") for k, name in enumerate(_HEADERS.values())})

    def between(at: Column, end: Column) -> Column:
        return F.when(at > 0, F.array_join(F.slice("_cuts", at, end - at), ""))

    def section(name: str, others: list[str]) -> Column:
        at = F.col(name)
        later = [F.when(F.col(o) > at, F.col(o)) for o in [*others, "_table_at"]]
        return between(at, F.coalesce(F.least(*later), F.size("_cuts") + 1))

    staged = staged.withColumns({
        "_citescore_row": citescore_row(between(F.col("_citescore_at"), F.size("_cuts") + 1)),
        "_jif_section": section("_jif_at", ["_jci_at", "_ranking_at"]),
        "_jci_section": section("_jci_at", ["_jif_at", "_ranking_at"]),
    })
    # Rankings count only on pages that have a CiteScore data row.
    rankings = section("_ranking_at", ["_jif_at", "_jci_at"])
    return staged.withColumns({
        "_numbers": citescore_numbers(F.col("_citescore_row")),
        "_ranking_section": F.when(F.col("_citescore_row") != "", rankings),
    })


def _behind(html: Column, field: tuple[str, str], word: str = "") -> Column:
    """First group of a field's pattern, ``''`` when it does not match.

    The page is cut at the first occurrence of the fixed text. If the lazy rest does
    not match from there it matches from no later occurrence, so one try decides.
    Pages without ``word`` are skipped.
    """
    start, rest = field
    tail = F.regexp_extract(html, f"(?s){start}.*", 0)
    found = F.regexp_extract(tail, rf"(?is)\A(?:{start}){rest}", 1)
    return F.when(html.contains(word), found).otherwise("") if word else found


def _records(text: Column, pattern: str, names: list[str]) -> Column:
    """All matches of a pattern as an array of structs, one field per group.

    The section is searched once; the groups are read from the short matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(matches, lambda m: F.struct(
        *[F.regexp_extract(m, pattern, i + 1).alias(n) for i, n in enumerate(names)]))


def citescore_row(section: Column) -> Column:
    """The data row under the CiteScore header, ``''`` when there is none."""
    return F.coalesce(F.regexp_extract(section, _DATA_ROW, 1), F.lit(""))


def citescore_numbers(row: Column) -> Column:
    """Number cells of the data row; CiteScore, SJR and SNIP are the first three, if three."""
    return F.regexp_extract_all(row, F.lit(_NUMBER_CELL), F.lit(1))


def citescore_rankings(section: Column) -> Column:
    """Ranking triples of a section whose category names a subject class."""
    triples = _records(section, _RANKING_ROW, ["category", "zone", "rank"])
    stripped = F.transform(triples, lambda r: F.struct(
        *[strip_markup(r[n]).alias(n) for n in ("category", "zone", "rank")]))
    kept = F.filter(stripped, lambda r: r["category"].rlike("|".join(RANKING_WORDS)))
    return F.coalesce(kept, F.array().cast(schema.CITESCORE_RANKINGS))


def subject_rankings(section: Column) -> Column:
    """Ranking rows of a JIF or JCI section."""
    rows = _records(section, _SUBJECT_ROW, ["subject", "subset", "quartile", "rank"])
    trimmed = F.transform(rows, lambda r: F.struct(
        trim_space(r["subject"]).alias("subject"), r["subset"].alias("subset"),
        r["quartile"].alias("quartile"), r["rank"].alias("rank")))
    return F.coalesce(trimmed, F.array().cast(schema.SUBJECT_RANKINGS))


def venue_name(html: Column) -> Column:
    return _behind(html, _NAME, "期刊名字")


def jcr_zone(html: Column) -> Column:
    return _behind(html, _JCR_ZONE, "分区等级")


def reject_reason(html: Column, min_chars: int = MIN_PAGE_CHARS) -> Column:
    """Why a page is not usable, NULL when it is. Lengths are code points."""
    return (
        F.when(is_blocked_page(html), BLOCKED)
        .when(F.length(html) < min_chars, TOO_SHORT)
        .when(venue_name(html) == "", NO_NAME)
    )


def _realtime(cell: Column) -> Column:
    dated = F.regexp_extract(cell, rf"截止[^：:]*[：:]{WS}*([\d.]+)", 1)
    final = F.regexp_extract(cell, rf"([\d.]+){WS}*\z", 1)
    return F.coalesce(F.nullif(dated, F.lit("")), final)


def extract_text(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """One record per page, fields as text, with ``reject_reason`` and ``partition_tables``.

    Missing fields are ``''``. Filter on ``reject_reason`` for the good and the
    rejected pages; the filter runs before the fields are read.
    """
    html = F.col("html")
    staged = pages.withColumn("reject_reason", reject_reason(html, min_chars))
    staged = _with_label_cells(with_partitions(staged))
    staged = _with_sections(staged)

    def number(i: int) -> Column:
        three = F.size("_numbers") >= 3
        return F.when(three, F.get(F.col("_numbers"), F.lit(i))).otherwise("")

    before_span = F.regexp_extract(_cell("impact_factor"), r"(?is)\A(.*?)(?:span|\z)", 1)
    articles = _behind(html, _ARTICLES, "年文章数")
    fields = {
        "journalid": F.regexp_extract("url", r"journalid=(\d+)", 1),
        "letpub_url": F.col("url"),
        "name": venue_name(html),
        **{c: _cell(c) for c in ("issn", "eissn", "publisher", "country", "language",
                                 "periodicity", "research_area", "is_oa")},
        "gold_oa_ratio": first_percentage(_cell("gold_oa_ratio")),
        "official_url": first_token(_cell("official_url")),
        "submission_url": first_token(_cell("submission_url")),
        "sci_type": index_category(_cell("sci_type"), html),
        "impact_factor": first_number(before_span),
        "realtime_if": _realtime(_cell("realtime_if")),
        "five_year_if": first_number(_cell("five_year_if")),
        "jci_value": first_number(_cell("jci_value")),
        "h_index": _behind(html, _H_INDEX),
        "cite_score": number(0),
        "sjr": number(1),
        "snip": number(2),
        "self_citation_rate": first_percentage(_cell("self_citation_rate")),
        "review_speed": drop_label(_cell("review_speed"), SHARED_EXPERIENCE),
        "acceptance_rate": drop_label(_cell("acceptance_rate"), SHARED_EXPERIENCE),
        "article_count": F.regexp_extract(articles, rf"\A{WS}*(\d+)", 1),
        "letpub_score": _behind(html, _SCORE, "评分"),
        "wos_zone": jcr_zone(html),
        "jif": subject_rankings(F.col("_jif_section")),
        "jci_json": subject_rankings(F.col("_jci_section")),
        "citescore_rankings": citescore_rankings(F.col("_ranking_section")),
    }
    return staged.select("page_id", *[c.alias(n) for n, c in fields.items()], *VERSIONS,
                         "partition_tables", "reject_reason")


def typed_fields(records: DataFrame) -> DataFrame:
    """Text records to catalogue types: sentinels to NULL, numbers parsed leniently."""
    text = [c for c in (*schema.VENUE_TEXT, *schema.RATE_TEXT, "wos_zone") if c in records.columns]
    casts = {c: clean.null_sentinel(F.col(c)) for c in text}
    casts |= {c: clean.lenient_double(F.col(c)) for c in schema.DOUBLE_METRICS}
    casts |= {c: clean.lenient_int(F.col(c)) for c in schema.INT_METRICS}
    return records.withColumns(casts)


def extract(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Typed records of the usable pages."""
    good = extract_text(pages, min_chars).where(F.col("reject_reason").isNull())
    return typed_fields(good).drop("reject_reason")


def rejected(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """``(page_id, url, reason)`` of the unusable pages."""
    judged = pages.select("page_id", "url", reject_reason(F.col("html"), min_chars).alias("reason"))
    return judged.where(F.col("reason").isNotNull())
