"""Resolving catalogue rows to external ids.

Candidates are rows ``(query_kind, query_key, pos, journalid, name)``: the result
list of one search, in page order. ``query_key`` is the text searched for: an ISSN,
a full name or an abbreviation. As the name searched for is on every candidate row,
all tiers are judged on the candidates alone, and each search is reduced to one
answer before the catalogue is joined. So no pair of catalogue rows and candidates
is ever formed, and a search shared by very many rows costs one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuedir.functions.text import normalize_name
from venuedir.operators.skew import lookup

ISSN, NAME, ABBR = "issn", "name", "abbr"

# Tiers in order of preference, and their names in the output. Fixed values.
NAME_TIERS = ["name_exact", "name_partial", "name_single", "name_first"]
NO_METHOD = "none"

# Links of a result page. Fixed values.
ID_LINK = r"(?i)journalid=(\d+)"
NAMED_LINK = r"(?i)journalid=(\d+)[^>]*>([^<]*)</a>"


def extract_candidates(result_pages: DataFrame) -> DataFrame:
    """Candidates of result pages ``(query_kind, query_key, html)`` in page order.

    An ISSN search takes every id on the page; the others take only named links.
    """
    html = F.col("html")
    plain = F.transform(
        F.regexp_extract_all(html, F.lit(ID_LINK), F.lit(1)),
        lambda i: F.struct(i.alias("journalid"), F.lit(None).cast("string").alias("name")))
    named = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(NAMED_LINK), F.lit(1)).alias("journalid"),
        F.regexp_extract_all(html, F.lit(NAMED_LINK), F.lit(2)).alias("name"))
    found = F.when(F.col("query_kind") == ISSN, plain).otherwise(named)
    return result_pages.select(
        "query_kind", "query_key", F.posexplode(found).alias("pos", "_c")
    ).select("query_kind", "query_key", "pos", "_c.journalid", "_c.name")


def _first(condition: Column) -> Column:
    """Id of the first candidate, in page order, that meets ``condition``."""
    at = F.min(F.when(condition, F.struct("pos", "journalid")))
    return at["journalid"]


def _contains(container: Column, part: Column) -> Column:
    """Containment of normalised names. An empty name contains and is contained in nothing."""
    return (container != "") & (part != "") & container.contains(part)


def answers(candidates: DataFrame, kind: str) -> DataFrame:
    """One row per search of a kind: the first candidate of each tier, and their count."""
    own = candidates.where(F.col("query_kind") == kind).select(
        "query_key", "pos", "journalid",
        normalize_name(F.col("name")).alias("found"),
        normalize_name(F.col("query_key")).alias("wanted"))
    found, wanted = F.col("found"), F.col("wanted")
    return own.groupBy("query_key").agg(
        _first(found == wanted).alias("exact_id"),
        _first(_contains(found, wanted) | _contains(wanted, found)).alias("partial_id"),
        _first(_contains(found, wanted)).alias("containing_id"),
        _first(F.lit(True)).alias("first_id"),
        F.count(F.lit(1)).alias("n"),
    )


def _with_answer(rows: DataFrame, candidates: DataFrame, kind: str, key: Column,
                 *columns: str) -> DataFrame:
    """Add the answers of one kind of search as ``_<kind>_<column>``; a NULL key has none.

    Very many rows may search for the same text, so this is a skew-tolerant lookup.
    Rows that search for nothing are spread by their own fields instead of meeting
    in one task.
    """
    found = answers(candidates, kind).select(
        F.col("query_key").alias("_key"), F.lit(0).cast("long").alias("_spread"),
        *[F.col(c).alias(f"_{kind}_{c}") for c in columns])
    own = F.coalesce(F.nullif(F.xxhash64("full", "abbr"), F.lit(0)), F.lit(1))
    spread = F.when(key.isNull(), own).otherwise(0)
    keyed = rows.withColumns({
        "_key": F.coalesce(key, F.lit("")), "_spread": spread.cast("long")})
    return lookup(keyed, found, ["_key", "_spread"]).drop("_key", "_spread")


def _usable(text: Column, *unusable: str) -> Column:
    return F.when(~F.coalesce(text, F.lit("")).isin(list(unusable)), text)


def resolve(catalogue: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add ``journalid, method`` to rows with ``issn, full, abbr``.

    Order: the first candidate of the ISSN search; an equal normalised name; a name
    contained either way; the only candidate; the first candidate; none.
    """
    joined = _with_answer(catalogue, candidates, ISSN, _usable(F.col("issn"), "", "-"), "first_id")
    joined = _with_answer(joined, candidates, NAME, F.col("full"),
                          "exact_id", "partial_id", "first_id", "n")
    journalid = F.coalesce("_issn_first_id", "_name_exact_id", "_name_partial_id", "_name_first_id")
    method = (
        F.when(F.col("_issn_first_id").isNotNull(), ISSN)
        .when(F.col("_name_exact_id").isNotNull(), NAME_TIERS[0])
        .when(F.col("_name_partial_id").isNotNull(), NAME_TIERS[1])
        .when(F.col("_name_n") == 1, NAME_TIERS[2])
        .when(F.col("_name_n") > 1, NAME_TIERS[3])
        .otherwise(NO_METHOD)
    )
    return joined.select(*catalogue.columns, journalid.alias("journalid"), method.alias("method"))


def resolve_with_abbreviation(catalogue: DataFrame, candidates: DataFrame) -> DataFrame:
    """The variant that also searches the abbreviation; methods are issn, name, none.

    When the name search gave several candidates and none matches, the first result
    of the abbreviation search that contains the abbreviation is taken before the
    first result of the name search. An abbreviation equal to the name adds nothing.
    """
    usable_abbr = F.when(F.col("abbr") != F.col("full"), _usable(F.col("abbr"), ""))
    joined = _with_answer(catalogue, candidates, ISSN, _usable(F.col("issn"), "", "-"), "first_id")
    joined = _with_answer(joined, candidates, NAME, F.col("full"),
                          "exact_id", "partial_id", "first_id", "n")
    joined = _with_answer(joined, candidates, ABBR, usable_abbr, "containing_id")
    by_name = F.when(F.col("_name_n") == 1, F.coalesce("_name_exact_id", "_name_partial_id", "_name_first_id"))
    by_name = by_name.when(F.col("_name_n") > 1, F.coalesce(
        "_name_exact_id", "_name_partial_id", "_abbr_containing_id", "_name_first_id"))
    method = (
        F.when(F.col("_issn_first_id").isNotNull(), ISSN)
        .when(by_name.isNotNull(), NAME)
        .otherwise(NO_METHOD)
    )
    return joined.select(*catalogue.columns,
                         F.coalesce(F.col("_issn_first_id"), by_name).alias("journalid"),
                         method.alias("method"))


def keep_known_ids(resolved: DataFrame, known: str = "known_id") -> DataFrame:
    """A known id beats the resolved one and is reported as ``cached_id``; ``'0'`` is unknown."""
    usable = F.when(~F.coalesce(known, F.lit("")).isin("", "0"), F.col(known))
    found = F.when(F.col("journalid") != "0", F.col("journalid"))
    return resolved.withColumns({
        "journalid": F.coalesce(usable, found),
        "method": F.when(usable.isNotNull(), "cached_id").otherwise(F.col("method")),
    })
