"""Table schemas of the catalogue, its annotations and its input records."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# --- nested values -----------------------------------------------------------

PARTITION = T.StructType(
    _strings("bigCategory", "bigZone", "smallCategory", "smallZone")
    + [T.StructField("isTop", T.BooleanType()), T.StructField("isReview", T.BooleanType())]
)
SUBJECT_RANKINGS = T.ArrayType(T.StructType(_strings("subject", "subset", "quartile", "rank")))
CITESCORE_RANKINGS = T.ArrayType(T.StructType(_strings("category", "zone", "rank")))
TAGS = T.ArrayType(T.StringType())

# --- entries -----------------------------------------------------------------
# Column names are fixed values: list requests, sort keys and exports use them.

REQUIRED_TEXT = ["type", "ccf_domain", "ccf_level", "ccf_abbr", "ccf_full"]
DEFAULTED_TEXT = ["ccf_publisher", "ccf_url"]
VENUE_TEXT = [
    "letpub_url", "journalid", "name", "issn", "eissn", "publisher", "country", "language",
    "periodicity", "research_area", "is_oa", "gold_oa_ratio", "official_url", "submission_url",
    "sci_type",
]
RATE_TEXT = ["self_citation_rate", "review_speed", "acceptance_rate"]
DOUBLE_METRICS = [
    "impact_factor", "realtime_if", "five_year_if", "jci_value", "cite_score", "sjr", "snip",
    "letpub_score",
]
INT_METRICS = ["h_index", "article_count"]
PARTITION_COLUMNS = ["xinrui", "cas2025", "cas2023"]

ENTRY = T.StructType(
    [T.StructField("id", T.LongType())]
    + _strings(*REQUIRED_TEXT, *DEFAULTED_TEXT, *VENUE_TEXT)
    + [
        T.StructField("impact_factor", T.DoubleType()),
        T.StructField("realtime_if", T.DoubleType()),
        T.StructField("five_year_if", T.DoubleType()),
        T.StructField("jci_value", T.DoubleType()),
        T.StructField("h_index", T.IntegerType()),
        T.StructField("cite_score", T.DoubleType()),
        T.StructField("sjr", T.DoubleType()),
        T.StructField("snip", T.DoubleType()),
    ]
    + _strings(*RATE_TEXT)
    + [
        T.StructField("article_count", T.IntegerType()),
        T.StructField("letpub_score", T.DoubleType()),
        T.StructField("xinrui", PARTITION),
        T.StructField("cas2025", PARTITION),
        T.StructField("cas2023", PARTITION),
        T.StructField("wos_zone", T.StringType()),
        T.StructField("jif", SUBJECT_RANKINGS),
        T.StructField("jci_json", SUBJECT_RANKINGS),
        T.StructField("citescore_rankings", CITESCORE_RANKINGS),
    ]
)

ENTRY_COLUMNS = ENTRY.fieldNames()  # 43, the full row

LIST_COLUMNS = [  # 19, the list row
    "id", "type", "ccf_domain", "ccf_level", "ccf_abbr", "ccf_full", "ccf_publisher", "ccf_url",
    "letpub_url", "issn", "impact_factor", "cite_score", "h_index", "cas2025", "xinrui",
    "wos_zone", "sci_type", "article_count", "letpub_score",
]


def with_defaults(table: T.StructType, defaults: dict[str, str]) -> T.StructType:
    """``table`` with column defaults, each a constant SQL expression.

    The Parquet scan fills them in where a file has no such column; a NULL that is stored stays NULL.
    """
    def field(f: T.StructField) -> T.StructField:
        if f.name not in defaults:
            return f
        sql = defaults[f.name]
        return T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "CURRENT_DEFAULT": sql, "EXISTS_DEFAULT": sql})

    unknown = set(defaults) - set(table.fieldNames())
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return T.StructType([field(f) for f in table.fields])


# --- annotations -------------------------------------------------------------

OWNER_KEY = ["owner_kind", "owner_id"]
ANNOTATION_KEY = [*OWNER_KEY, "entry_id"]

OPERATION = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("owner_kind", T.StringType()),
        T.StructField("owner_id", T.StringType()),
        T.StructField("entry_id", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("tags", TAGS),
        T.StructField("content", T.StringType()),
    ]
)

# --- input records -----------------------------------------------------------
# Import document field -> entries column, for journals. Fixed values.

JOURNAL_TEXT_FIELDS = {
    "ccfDomain": "ccf_domain", "ccfLevel": "ccf_level", "ccfAbbr": "ccf_abbr",
    "ccfFull": "ccf_full", "ccfPublisher": "ccf_publisher", "ccfUrl": "ccf_url",
    "letpubUrl": "letpub_url", "journalid": "journalid", "name": "name", "issn": "issn",
    "eissn": "eissn", "publisher": "publisher", "country": "country", "language": "language",
    "periodicity": "periodicity", "researchArea": "research_area", "isOA": "is_oa",
    "goldOARatio": "gold_oa_ratio", "officialUrl": "official_url",
    "submissionUrl": "submission_url", "sciType": "sci_type",
    "selfCitationRate": "self_citation_rate", "reviewSpeed": "review_speed",
    "acceptanceRate": "acceptance_rate", "wosZone": "wos_zone",
}
JOURNAL_NUMBER_FIELDS = {
    "impactFactor": "impact_factor", "realtimeIF": "realtime_if", "fiveYearIF": "five_year_if",
    "jciValue": "jci_value", "hIndex": "h_index", "citeScore": "cite_score", "sjr": "sjr",
    "snip": "snip", "articleCount": "article_count", "letpubScore": "letpub_score",
}
JOURNAL_NESTED_FIELDS = {
    "xinrui": "xinrui", "cas2025": "cas2025", "cas2023": "cas2023", "jif": "jif",
    "jci": "jci_json", "citeScoreRankings": "citescore_rankings",
}

# Numbers may arrive as JSON numbers or strings: they are read as VARIANT, which
# keeps the JSON type, then cleaned. Nested values are read as raw JSON text,
# because a malformed one must not spoil its record.
JOURNAL_IMPORT = T.StructType(
    _strings(*JOURNAL_TEXT_FIELDS)
    + [T.StructField(n, T.VariantType()) for n in JOURNAL_NUMBER_FIELDS]
    + _strings(*JOURNAL_NESTED_FIELDS)
)
CONFERENCE_IMPORT = T.StructType(_strings("domain", "level", "abbr", "full", "publisher", "url"))
IMPORT_DOCUMENT = T.StructType(
    [
        T.StructField("journals", T.ArrayType(JOURNAL_IMPORT)),
        T.StructField("conferences", T.ArrayType(CONFERENCE_IMPORT)),
    ]
)
SOURCE_RECORD = T.StructType(_strings("abbr", "full", "level", "publisher", "url"))
OLDER_METRIC = T.StructType(_strings("issn"))
WORKLIST_RECORD = T.StructType(
    _strings("abbr", "full", "domain", "level", "publisher", "url", "journalid", "reason")
)
LEDGER_RECORD = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        *_strings("journalid", "method", "reason", "timestamp"),
    ]
)
