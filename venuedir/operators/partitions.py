"""Partition tables of a venue page: up to three, told apart by position.

Cells hold nested tables, so a cell ends where its own tag is balanced, which no
regular expression finds. The row is cut in front of every tag, each piece becomes
+1, -1 or 0, and a fold over those numbers finds the balance; each fold is linear in
the row. It all stays in built-in expressions, so page text never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions.text import WS, strip_markup

# The header that starts a partition table and the three versions in page order.
TABLE_HEADER = "大类学科</th>"
VERSIONS = ["xinrui", "cas2025", "cas2023"]
CELLS_NEEDED = 4

# Cuts in front of the tags that open and close a level.
_ROW_CUT, _CELL_CUT = r"(?i)(?=<tr)|(?=</tr>)", r"(?i)(?=<td[^>]*>)|(?=</td>)"
_PARTITION_CELL = rf"(?i)\A<td[^>]*padding:{WS}*8px[^>]*>"
_CATEGORY_CELL = r'(?is)<td[^>]*style="padding:4px;">(.*?)</td>'
_ZONE_SPAN = r'(?i)<span[^>]*style="([^"]*)"[^>]*>(\d)区</span>'
_HIDDEN, _HIDING = "display: ?none", "display:"
_YES, _NOT_APPLICABLE = "是", "N/A"


def visible_zone(html: Column) -> Column:
    """The first zone span that is not hidden, ``''`` when there is none.

    Only texts that may hide something are searched for all their spans.
    """
    first = F.regexp_extract(html, _ZONE_SPAN, 2)
    plain = F.when(first == "", first).otherwise(F.concat(first, F.lit("区")))
    return F.when(html.contains(_HIDING), _first_shown(html)).otherwise(F.coalesce(plain, F.lit("")))


def _first_shown(html: Column) -> Column:
    spans = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(_ZONE_SPAN), F.lit(1)).alias("style"),
        F.regexp_extract_all(html, F.lit(_ZONE_SPAN), F.lit(2)).alias("zone"))
    shown = F.get(F.filter(spans, lambda s: ~s["style"].rlike(_HIDDEN)), 0)["zone"]
    return F.coalesce(F.concat(shown, F.lit("区")), F.lit(""))


def _row_levels(pieces: Column) -> Column:
    """What each piece does to the nesting depth of rows; plain comparisons, as pieces are many."""
    return F.transform(pieces, lambda piece: F.when(F.lower(F.left(piece, F.lit(3))) == "<tr", 1)
                       .when(F.lower(F.left(piece, F.lit(5))) == "</tr>", -1).otherwise(0))


def _cell_levels(pieces: Column) -> Column:
    """The same for cells, whose opening tag has to end inside the piece."""
    return F.transform(pieces, lambda piece: F.when(
        (F.lower(F.left(piece, F.lit(3))) == "<td") & piece.contains(">"), 1)
        .when(F.lower(F.left(piece, F.lit(5))) == "</td>", -1).otherwise(0))


def _balanced(levels: Column, depth: int) -> Column:
    """How many pieces it takes until the depth returns to zero; NULL if it never does."""
    start = F.struct(F.lit(depth).alias("depth"), F.lit(0).alias("taken"))

    def step(acc: Column, level: Column) -> Column:
        # A depth of zero behind at least one piece is final.
        open_still = (acc["depth"] != 0) | (acc["taken"] == 0)
        return F.when(open_still, F.struct(
            (acc["depth"] + level).alias("depth"), (acc["taken"] + 1).alias("taken"))).otherwise(acc)

    return F.aggregate(levels, start, step,
                       lambda acc: F.when((acc["depth"] == 0) & (acc["taken"] > 0), acc["taken"]))


def sections(html: Column) -> Column:
    """Text behind each table header; the last section reaches to the end of the page."""
    return F.split(html, TABLE_HEADER, -1)


def _columns(prefix: str) -> list[str]:
    return [f"_{prefix}_{version}" for version in VERSIONS]


def with_partitions(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``xinrui, cas2025, cas2023`` and ``partition_tables``, the count of tables found.

    A table without a data row is NULL; a data row with fewer than four cells gives
    a partition whose fields are all NULL. Work is staged in columns because an
    expression inside a fold is not shared by Spark otherwise.
    """
    parts = F.col("_parts")
    staged = pages.withColumn("_parts", sections(F.col(html)))
    # From the first row behind the header row to the end of the section.
    staged = staged.withColumns({
        c: F.regexp_extract(F.get(parts, F.lit(i + 1)), r"(?s)\A(?>.*?</tr>).*?(<tr.*)\z", 1)
        for i, c in enumerate(_columns("tail"))})
    staged = staged.withColumns({
        c: F.split(F.col(t), _ROW_CUT) for c, t in zip(_columns("rows"), _columns("tail"))})
    staged = staged.withColumns({
        c: _first_row(F.col(r)) for c, r in zip(_columns("row"), _columns("rows"))})
    staged = staged.withColumns({
        c: F.split(F.col(r), _CELL_CUT) for c, r in zip(_columns("pieces"), _columns("row"))})
    staged = staged.withColumns({
        c: _cell_levels(F.col(t))
        for c, t in zip(_columns("levels"), _columns("pieces"))})
    staged = staged.withColumns({
        c: _partition_cells(F.col(t), F.col(n))
        for c, t, n in zip(_columns("cells"), _columns("pieces"), _columns("levels"))})
    staged = staged.withColumns({version: _partition(F.col(c), F.col(r))
                                 for version, c, r in zip(VERSIONS, _columns("cells"), _columns("row"))})
    return staged.select(*pages.columns, *VERSIONS,
                         (F.size(parts) - 1).alias("partition_tables"))


def _first_row(pieces: Column) -> Column:
    """The balanced row at the start, without its closing tag; NULL when it stays open."""
    taken = _balanced(_row_levels(pieces), 0)
    return F.array_join(F.slice(pieces, F.lit(1), taken - 1), "")


def _partition_cells(pieces: Column, levels: Column) -> Column:
    """Contents of the first four partition cells; NULL entries are unbalanced cells."""
    at = F.filter(
        F.transform(pieces, lambda piece, i: F.when(piece.contains("8") & piece.rlike(_PARTITION_CELL), i)),
        lambda i: i.isNotNull())

    def content(i: Column) -> Column:
        # Piece i is the opening tag with the text behind it; its close is piece i + taken.
        rest = F.slice(levels, i + 2, F.size(levels))
        head = F.substr(F.get(pieces, i), F.instr(F.get(pieces, i), F.lit(">")) + 1)
        inner = F.slice(pieces, i + 2, _balanced(rest, 1) - 1)
        return F.concat(head, F.array_join(inner, ""))

    return F.transform(F.slice(at, 1, CELLS_NEEDED), content)


def _partition(cells: Column, row: Column) -> Column:
    def cell(i: int) -> Column:
        return F.get(cells, F.lit(i))

    def category(text: Column) -> Column:
        return F.trim(F.regexp_replace(strip_markup(text), r"\d区", ""))

    named = F.regexp_extract(cell(1), _CATEGORY_CELL, 1)
    has_named = cell(1).rlike(_CATEGORY_CELL)
    def says(text: Column, word: str) -> Column:
        # Blanks and entities cannot make or break the word, and tags need a look only where it occurs.
        return text.contains(word) & F.regexp_replace(text, "<[^>]+>", " ").contains(word)

    found = F.struct(
        category(cell(0)).alias("bigCategory"),
        visible_zone(cell(0)).alias("bigZone"),
        F.when(has_named, strip_markup(named)).otherwise(category(cell(1))).alias("smallCategory"),
        visible_zone(cell(1)).alias("smallZone"),
        says(cell(2), _YES).alias("isTop"),
        (says(cell(3), _YES) & ~says(cell(3), _NOT_APPLICABLE)).alias("isReview"),
    ).cast(schema.PARTITION)
    complete = (F.size(cells) == CELLS_NEEDED) & ~F.exists(cells, lambda c: c.isNull())
    empty = F.from_json(F.lit("{}"), schema.PARTITION)
    return F.when(F.coalesce(row, F.lit("")) == "", F.lit(None)).when(complete, found).otherwise(empty)
