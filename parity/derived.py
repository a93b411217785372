"""The catalogue, operation log and logins that Spark derives from the driver tables.

The expressions are plain SQL that Spark and DuckDB read alike, so both sides
start from the same derived rows; what is compared is what the operators do.
"""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions.tags import decode_tags
from venuedir.functions.zones import decode_partition

# --- entries (one per part) ---------------------------------------------------

ENTRY_EXPRESSIONS = {
    "id": "p_partkey",
    "type": "case when p_partkey%3=0 then 'conference' else 'journal' end",
    "ccf_domain": "p_type",
    "ccf_level": "case when p_size<=10 then 'A' when p_size<=25 then 'B' else 'C' end",
    "ccf_abbr": "concat(p_brand,'-',cast(p_partkey as string))",
    "ccf_full": "concat(p_name,' ',p_type)",
    "ccf_publisher": "p_brand",
    "ccf_url": "concat('https://venues.example.org/',cast(p_partkey as string))",
    "letpub_url": "case when p_partkey%3<>0 then concat('https://pages.example.org/',cast(p_partkey as string)) end",
    "journalid": "case when p_partkey%3<>0 then cast(p_partkey+1000 as string) end",
    "name": "case when p_partkey%3<>0 then p_name end",
    "issn": "case when p_partkey%5<>0 then lpad(cast(p_partkey as string),8,'0') end",
    "eissn": "cast(null as string)",
    "publisher": "case when p_partkey%3<>0 then p_brand end",
    "country": "cast(null as string)",
    "language": "case when p_partkey%3<>0 then 'English' end",
    "periodicity": "cast(null as string)",
    "research_area": "p_type",
    "is_oa": "case when p_partkey%2=0 then 'Yes' else 'No' end",
    "gold_oa_ratio": "concat(cast(p_size as string),'.5%')",
    "official_url": "cast(null as string)",
    "submission_url": "cast(null as string)",
    "sci_type": "case when p_partkey%3<>0 then case when p_partkey%4=0 then 'ESCI' else 'SCIE' end end",
    "impact_factor": "case when p_partkey%3<>0 and p_partkey%7<>0 then p_retailprice/100 end",
    "realtime_if": "case when p_partkey%3<>0 then p_retailprice/90 end",
    "five_year_if": "case when p_partkey%3<>0 then p_retailprice/80 end",
    "jci_value": "case when p_partkey%3<>0 then cast(p_size as double)/8 end",
    "h_index": "case when p_partkey%3<>0 then p_size end",
    "cite_score": "case when p_partkey%3<>0 and p_partkey%4<>0 then p_retailprice/200 end",
    "sjr": "cast(null as double)",
    "snip": "cast(null as double)",
    "self_citation_rate": "concat(cast(p_size as string),'%')",
    "review_speed": "cast(null as string)",
    "acceptance_rate": "cast(null as string)",
    "article_count": "case when p_partkey%3<>0 and p_partkey%8<>0 then p_size*7 end",
    "letpub_score": "case when p_partkey%3<>0 then cast(p_size as double)/5 end",
    "xinrui": "case when p_partkey%3<>0 and p_partkey%13<>0 then concat('{\"bigZone\":\"',cast(p_partkey%5 as string),"
              "'区\",\"isTop\":',case when p_partkey%17=1 then 'true' else 'false' end,'}') end",
    "cas2025": "case when p_partkey%3<>0 and p_partkey%11<>0 then concat('{\"bigCategory\":\"',p_type,'\",\"bigZone\":\"',"
               "cast(p_partkey%4+1 as string),'区\",\"isTop\":',case when p_partkey%10=1 then 'true' else 'false' end,'}') end",
    "cas2023": "case when p_partkey%3<>0 then case when p_partkey%6=1 then '{}' else concat('{\"smallCategory\":\"',p_type,"
               "'\",\"smallZone\":\"',cast(p_partkey%4+1 as string),'区\"}') end end",
    "wos_zone": "case when p_partkey%3<>0 and p_partkey%9<>0 then concat(cast(p_partkey%4+1 as string),'区') end",
    "jif": "case when p_partkey%3<>0 then concat('[{\"subject\":\"',p_type,'\",\"subset\":\"SCIE\",\"quartile\":\"Q',"
           "cast(p_partkey%4+1 as string),'\",\"rank\":\"',cast(p_size as string),'/50\"},{\"subject\":\"',p_brand,"
           "'\",\"subset\":\"ESCI\",\"quartile\":\"Q1\",\"rank\":\"1/9\"}]') end",
    "jci_json": "case when p_partkey%3<>0 then concat('[{\"subject\":\"',p_brand,'\",\"subset\":\"SCIE\",\"quartile\":\"Q2\",\"rank\":\"',"
                "cast(p_size as string),'/60\"}]') end",
    "citescore_rankings": "case when p_partkey%3<>0 then concat('[{\"category\":\"大类：',p_type,'\",\"zone\":\"Q1\",\"rank\":\"',"
                          "cast(p_size as string),'/70\"}]') end",
}

# --- operation log (one operation per event) ----------------------------------

OPERATION_EXPRESSIONS = {
    "event_id": "event_id",
    "ts": "ts",
    "owner_kind": "case when user_id%2=0 then 'user' else 'device' end",
    "owner_id": "cast(user_id as string)",
    # a third of the operations meet on twenty entries, the others reach over all of them
    "entry_id": "case when event_id%3=0 then event_id%20 else cast(floor(event_id/5) as bigint) end",
    "op": "case event_type when 'purchase' then 'fav_add' when 'error' then 'fav_remove' when 'click' then 'fav_tags' "
          "when 'view' then 'note_upsert' else 'note_delete' end",
    "tags": "concat('[\"t',cast(event_id%5 as string),'\",\"T',cast(event_id%3 as string),'\"]')",
    "content": "concat('note ',cast(value as string))",
}


def _select(expressions: dict[str, str]) -> str:
    return ", ".join(f"{sql} as {name}" for name, sql in expressions.items())


_OPENED: dict[tuple, DataFrame] = {}


def _opened(make):
    """Keep the (lazy) frame per session and folder, as a user keeps a table variable."""
    @wraps(make)
    def once(spark: SparkSession, sf_dir: str, *rest: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, make.__name__, sf_dir, *rest)
        if key not in _OPENED:
            _OPENED[key] = make(spark, sf_dir, *rest)
        return _OPENED[key]
    return once


@_opened
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with nested values still as JSON text."""
    part = table(spark, sf_dir, "part")
    return part.selectExpr(*[f"{sql} as {name}" for name, sql in ENTRY_EXPRESSIONS.items()])


@_opened
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_entries(spark, sf_dir)
    decoded = {c: decode_partition(F.col(c)) for c in schema.PARTITION_COLUMNS}
    decoded["jif"] = F.from_json("jif", schema.SUBJECT_RANKINGS)
    decoded["jci_json"] = F.from_json("jci_json", schema.SUBJECT_RANKINGS)
    decoded["citescore_rankings"] = F.from_json("citescore_rankings", schema.CITESCORE_RANKINGS)
    return rows.withColumns(decoded)


@_opened
def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.selectExpr(*[f"{sql} as {name}" for name, sql in OPERATION_EXPRESSIONS.items()])
    return rows.withColumn("tags", decode_tags(F.col("tags")))


@_opened
def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(device_id, user_id, ts)``: every device, at its first event; two neighbouring ones belong to one user."""
    events = table(spark, sf_dir, "events").where("user_id%2=1")
    first = events.groupBy("user_id").agg(F.min("ts").alias("ts"))
    return first.selectExpr(
        "cast(user_id as string) as device_id",
        "cast(user_id - user_id%4 + 2 as string) as user_id", "ts")


@_opened
def user_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag definitions ``(user_id, name, color, created_at)``: two per user that ever acted."""
    ops = operations(spark, sf_dir).where("owner_kind = 'user'")
    seen = ops.groupBy(F.col("owner_id").alias("user_id")).agg(F.min("ts").alias("created_at"))
    names = F.array(F.lit("t1"), F.lit("unused"))
    return seen.select("user_id", F.explode(names).alias("name"), F.lit("blue").alias("color"),
                       "created_at")


# --- DuckDB side --------------------------------------------------------------

ENTRIES_CTE = f"entries as (select {_select(ENTRY_EXPRESSIONS)} from part)"
OPS_CTE = f"ops as (select {_select(OPERATION_EXPRESSIONS)} from events)"

FAVORITES_CTE = f"""{OPS_CTE},
fav_ops as (select *, row_number() over (order by ts, event_id) as seq from ops where op like 'fav%'),
fav_b as (select *, max(case when op='fav_remove' then seq end)
            over (partition by owner_kind, owner_id, entry_id) as lr from fav_ops),
fav_c as (select *, min(case when op='fav_add' and seq>coalesce(lr,0) then seq end)
            over (partition by owner_kind, owner_id, entry_id) as fa from fav_b),
fav_d as (select *, row_number() over (partition by owner_kind, owner_id, entry_id order by seq desc) as rn,
            min(ts) over (partition by owner_kind, owner_id, entry_id) as created_at
          from fav_c where (op='fav_add' and seq=fa) or (op='fav_tags' and seq>fa)),
favorites as (select owner_kind, owner_id, entry_id,
                cast(from_json(tags,'["VARCHAR"]') as varchar[]) as tags, created_at from fav_d where rn=1)"""

NOTES_CTE = """note_ops as (select *, row_number() over (partition by owner_kind, owner_id, entry_id
                order by ts desc, event_id desc) as rn from ops where op like 'note%'),
notes as (select owner_kind, owner_id, entry_id, content, ts as updated_at
          from note_ops where rn=1 and op='note_upsert')"""

LOGINS_CTE = """logins as (select cast(user_id as string) as device_id,
    cast(user_id - user_id%4 + 2 as string) as user_id, min(ts) as ts
  from events where user_id%2=1 group by events.user_id)"""

USER_TAGS_CTE = """user_tags as (select user_id, unnest(['t1','unused']) as name, 'blue' as color, created_at
  from (select owner_id as user_id, min(ts) as created_at from ops where owner_kind='user' group by owner_id))"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


E_ = with_ctes(ENTRIES_CTE)
EF = with_ctes(ENTRIES_CTE, FAVORITES_CTE)
EFN = with_ctes(ENTRIES_CTE, FAVORITES_CTE, NOTES_CTE)
FN = with_ctes(FAVORITES_CTE, NOTES_CTE)
EFNL = with_ctes(ENTRIES_CTE, FAVORITES_CTE, NOTES_CTE, LOGINS_CTE, USER_TAGS_CTE)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
