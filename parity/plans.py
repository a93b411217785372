"""Multi-step plans: streaming replay, login merge, catalogue build."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import annotation, pages
from parity import derived as d
from parity.catalog import favorites, notes
from venuedir import schema
from venuedir.functions.tags import decode_tags
from venuedir.operators import merge
from venuedir.operators.replay import replay_toggles
from venuedir.plans.build import build_journals
from venuedir.plans.list_query import VenueQuery
from venuedir.plans.login import Annotations, merge_logins
from venuedir.session import shared_dir
from venuedir.sources import catalogue
from venuedir.streaming.changes import ChangeStore, start_replay


#: Micro-batches the events arrive in, and the files of one, which are read side by side.
BATCHES, FILES = 5, 8


def streamed(spark, sf) -> ChangeStore:
    """Replay the events as a file stream of several micro-batches, each reaching over the whole time."""
    events, arrived = d.table(spark, sf, "events"), shared_dir(spark, "arrived")
    events.repartition(BATCHES * FILES).write.parquet(arrived)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(arrived)
    ops = source.selectExpr(*[f"{sql} as {name}" for name, sql in d.OPERATION_EXPRESSIONS.items()])
    store = ChangeStore(shared_dir(spark, "changes"), buckets=4)
    start_replay(ops.withColumn("tags", decode_tags(F.col("tags"))), store).awaitTermination()
    return store


def streamed_logins(spark, sf):
    """Operations and logins as one stream of several micro-batches, with logins before, among and after the operations."""
    arrived = shared_dir(spark, "arrived-logins")
    login = d.logins(spark, sf).selectExpr(
        "-cast(device_id as bigint) as event_id", "ts", "'device' as owner_kind", "device_id as owner_id", "cast(null as bigint) as entry_id",
        "'login' as op", "cast(null as array<string>) as tags", "user_id as content")
    ops = d.operations(spark, sf).select(*schema.OPERATION.fieldNames()).unionByName(login)
    ops.repartition(BATCHES * FILES, F.xxhash64("event_id", "ts")).write.parquet(arrived)
    source = spark.readStream.schema(schema.OPERATION).option("maxFilesPerTrigger", FILES).parquet(arrived)
    store = ChangeStore(shared_dir(spark, "changes"), buckets=4)
    start_replay(source, store).awaitTermination()
    return store.annotations(spark, d.user_tags(spark, sf))


def all_logins(spark, sf):
    """Every device logs in at its first event of each kind, as one of three users."""
    events = d.table(spark, sf, "events").where("user_id%2=1")
    first = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    return first.selectExpr(
        "cast(user_id as string) as device_id",
        "cast(user_id + 2*length(event_type)%6 - 1 as string) as user_id", "ts")


# The claims of an entry one by one, in the order of the logins, with what has moved so far.
MANY_USERS = """all_logins as (select cast(user_id as varchar) as device_id,
    cast(user_id + 2*length(event_type)%6 - 1 as varchar) as user_id, min(ts) as ts from events where user_id%2=1
    group by events.user_id, event_type),
claims as (select n.entry_id, device_id, user_id, row_number() over (partition by n.entry_id order by min(ts), device_id, user_id) as k
  from notes n join all_logins l on n.owner_kind='device' and n.owner_id=l.device_id
  where not exists (select 1 from notes u where u.owner_kind='user' and u.owner_id=l.user_id and u.entry_id=n.entry_id)
  group by n.entry_id, device_id, user_id),
steps as (select entry_id, cast(0 as bigint) as k, cast([] as varchar[]) as devices, cast([] as varchar[]) as users
    from (select distinct entry_id from claims)
  union all select s.entry_id, c.k,
    case when list_contains(devices, c.device_id) or list_contains(users, c.user_id) then devices else list_append(devices, c.device_id) end,
    case when list_contains(devices, c.device_id) or list_contains(users, c.user_id) then users else list_append(users, c.user_id) end
  from steps s join claims c on c.entry_id=s.entry_id and c.k=s.k+1),
moves as (select entry_id, unnest(devices) as device_id, unnest(users) as user_id
  from (select *, row_number() over (partition by entry_id order by k desc) as last from steps) where last=1)"""


def merged(spark, sf):
    before = Annotations(favorites(spark, sf), notes(spark, sf), d.user_tags(spark, sf))
    return merge_logins(before, d.logins(spark, sf))


def built(spark, sf):
    part = d.table(spark, sf, "part")
    key = "cast(p_partkey as string)"
    sources = part.selectExpr("p_type as domain", f"concat('J', {key}) as abbr", f"concat(p_name, ' ', {key}) as full",
                                "'A' as level", "p_brand as publisher", "cast(null as string) as url")
    older = part.selectExpr(f"concat('J', {key}) as abbr", "'-' as issn")
    found = part.where("p_size > 10").selectExpr(
        "'name' as query_kind", f"concat(p_name, ' ', {key}) as query_key", "0 as pos",
        f"{key} as journalid", f"upper(concat(p_name, '-', {key})) as name")
    return build_journals(sources, older, found, pages.detail_pages(spark, sf))


BUILT = f"""(select *, case when p_size<=10 or p_partkey=0 then 'not_found' when ({pages.REASON}) is not null then 'parse_failed'
  else 'success' end as status from part)"""

STORED = ["id", "type", "ccf_domain", "ccf_level", "ccf_abbr", "issn", "impact_factor", "h_index", "wos_zone"]


def stored(spark, sf):
    """Entries written as the catalogue table and read back."""
    path = shared_dir(spark, "entries")
    catalogue.load_if_absent(d.entries(spark, sf), path)
    return catalogue.read_entries(spark, path)


def exported(spark, sf):
    """Entries exported as import records, then imported again."""
    path = shared_dir(spark, "export")
    catalogue.write_export(d.entries(spark, sf), path)
    return catalogue.import_catalogue(
        spark.read.schema(schema.JOURNAL_IMPORT).json(f"{path}/journals"),
        spark.read.schema(schema.CONFERENCE_IMPORT).json(f"{path}/conferences"))


QUERIES = {
    "stored_entries": (
        lambda spark, sf: stored(spark, sf).select(*STORED, F.col("cas2025.bigZone").alias("cas_zone")),
        d.E_ + f"select {', '.join(STORED)}, json_extract_string(cas2025, '$.bigZone') as cas_zone from entries"),
    "stored_entries_filtered": (
        lambda spark, sf: stored(spark, sf).where(VenueQuery(
            type="journal", level="A", zones={"xinrui": "1,2"}).predicate()).select("id", "ccf_abbr"),
        d.E_ + "select id, ccf_abbr from entries where type='journal' and ccf_level='A' "
               "and json_extract_string(xinrui, '$.bigZone') in ('1区','2区')"),
    "exported_entries": (
        lambda spark, sf: exported(spark, sf).select(
            *STORED[1:], F.col("cas2025.bigZone").alias("cas_zone"), F.size("jif").alias("n_jif")),
        # conferences keep their six own fields only
        d.E_ + "select type, ccf_domain, ccf_level, ccf_abbr, case when type='journal' then issn end as issn, "
               "impact_factor, h_index, wos_zone, json_extract_string(cas2025, '$.bigZone') as cas_zone, "
               "cast(json_array_length(jif) as integer) as n_jif from entries"),
    "stream_replay": (
        lambda spark, sf: annotation.text_tags(streamed(spark, sf).favorites(spark)),
        annotation.QUERIES["replay_favorites"][1]),
    "stream_replay_notes": (
        lambda spark, sf: streamed(spark, sf).notes(spark),
        annotation.QUERIES["replay_notes"][1]),
    "stream_logins": (
        lambda spark, sf: annotation.text_tags(streamed_logins(spark, sf).favorites),
        annotation.QUERIES["merge_favorites"][1]),
    "stream_logins_notes": (
        lambda spark, sf: streamed_logins(spark, sf).notes,
        annotation.QUERIES["merge_notes"][1]),
    "replay_toggles": (
        lambda spark, sf: replay_toggles(d.operations(spark, sf).withColumn("op", F.lit("fav_toggle"))),
        d.with_ctes(d.OPS_CTE) + "select owner_kind, owner_id, entry_id, max(ts) as created_at from ops "
                                 "group by all having count(*)%2=1"),
    "merge_logins_notes": (
        lambda spark, sf: merged(spark, sf).notes,
        annotation.QUERIES["merge_notes"][1]),
    "merge_notes_many_users": (
        lambda spark, sf: merge.merge_notes(notes(spark, sf), all_logins(spark, sf)),
        d.with_ctes(d.OPS_CTE, d.NOTES_CTE, MANY_USERS).replace("with ", "with recursive ", 1) + """
          select case when m.user_id is null then n.owner_kind else 'user' end as owner_kind, coalesce(m.user_id, n.owner_id) as owner_id,
            n.entry_id, n.content, n.updated_at
          from notes n left join moves m on n.owner_kind='device' and m.device_id=n.owner_id and m.entry_id=n.entry_id"""),
    "build_catalogue": (
        lambda spark, sf: built(spark, sf).entries.select(
            "journalid", "type", "ccf_domain", "ccf_level", "ccf_abbr", "ccf_full", "ccf_publisher", "ccf_url",
            "name", "publisher", "impact_factor", "wos_zone", F.col("cas2025.bigZone").alias("cas_zone")),
        f"""select cast(p_partkey as string) as journalid, 'journal' as type, p_type as ccf_domain, 'A' as ccf_level,
          concat('J', cast(p_partkey as string)) as ccf_abbr, concat(p_name, ' ', cast(p_partkey as string)) as ccf_full,
          p_brand as ccf_publisher, '' as ccf_url, p_name as name, concat(p_brand, ' & Sons') as publisher,
          p_retailprice as impact_factor, concat(cast(p_partkey%4+1 as string), '区') as wos_zone,
          concat(cast(p_partkey%3+1 as string), '区') as cas_zone from {BUILT} where status='success'"""),
    "build_outcomes": (
        lambda spark, sf: built(spark, sf).outcomes.select("type", "domain", "abbr", "status", "journalid", "method"),
        f"""select 'journal' as type, p_type as domain, concat('J', cast(p_partkey as string)) as abbr, status,
          case when status<>'not_found' then cast(p_partkey as string) end as journalid,
          case when status='success' then 'name_exact' end as method from {BUILT}"""),
    "build_rejects": (
        lambda spark, sf: built(spark, sf).rejected,
        f"select p_partkey as page_id, {pages.PAGE_URL} as url, {pages.REASON} as reason from part "
        f"where p_size>10 and p_partkey<>0 and ({pages.REASON}) is not null"),
}

