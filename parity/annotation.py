"""Replay, lists, merges, definitions and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import derived as d
from parity.catalog import USER, favorites, notes
from venuedir.operators import annotations as a
from venuedir.operators import definitions, integrity, merge
from venuedir.operators.owners import Owner
from venuedir.operators.replay import replay_notes, trimmed_notes

OWNER = Owner("user", USER)
OWN = f"owner_kind='user' and owner_id='{USER}'"
KEY = "owner_kind, owner_id, entry_id"


def text_tags(rows):
    return rows.withColumn("tags", F.array_join("tags", ","))


def _keys(spark, sf):
    """Every (owner, entry) ever named in the log, as lookup requests."""
    return d.operations(spark, sf).select("owner_kind", "owner_id", "entry_id").distinct()


def _requests(spark, sf):
    """One tag request per click: clashes, taken names and an over-long name occur."""
    ops = d.operations(spark, sf).where("op = 'fav_tags'")
    return ops.selectExpr(
        "event_id as request_id", "owner_id as user_id",
        "case when event_id%9=0 then repeat('x', 21) when event_id%4=0 then 't1' "
        "else concat('tag', cast(event_id%6 as string)) end as name", "'red' as color", "ts as created_at")


REQUESTS_CTE = """requests as (select event_id as request_id, owner_id as user_id,
    case when event_id%9=0 then repeat('x', 21) when event_id%4=0 then 't1'
    else concat('tag', cast(event_id%6 as string)) end as name, 'red' as color, ts as created_at
    from ops where op='fav_tags')"""

MERGED_FAV = """merged_favorites as (select owner_kind, owner_id, entry_id, tags, created_at from (
  select *, row_number() over (partition by owner_kind, owner_id, entry_id order by pri, login_ts, device) as rn from (
    select case when l.user_id is null then f.owner_kind else 'user' end as owner_kind,
      coalesce(l.user_id, f.owner_id) as owner_id, entry_id, tags, created_at,
      case when l.user_id is null then 0 else 1 end as pri, l.ts as login_ts, f.owner_id as device
    from favorites f left join logins l on f.owner_kind='device' and f.owner_id=l.device_id)) where rn=1)"""

MERGED_NOTES = """claims as (
  select n.*, l.user_id as login_user, l.ts as login_ts,
    exists (select 1 from notes u where u.owner_kind='user' and u.owner_id=l.user_id and u.entry_id=n.entry_id) as taken
  from notes n left join logins l on n.owner_kind='device' and n.owner_id=l.device_id),
ranked as (select *, row_number() over (partition by login_user, entry_id, taken order by login_ts, owner_id) as rn from claims),
merged_notes as (select
    case when login_user is not null and not taken and rn=1 then 'user' else owner_kind end as owner_kind,
    case when login_user is not null and not taken and rn=1 then login_user else owner_id end as owner_id,
    entry_id, content, updated_at from ranked)"""

GUEST_TAGS = """guest_tags as (select owner_kind, owner_id, name, first.created_at as first_at,
    first.entry_id as first_entry, cast(first.pos as integer) as first_pos from (
  select owner_kind, owner_id, name, min({'created_at': created_at, 'entry_id': entry_id, 'pos': pos}) as first from (
    select *, unnest(tags) as name, unnest(range(len(tags))) as pos from favorites where owner_kind='device')
  group by all))"""

DELETED = "id%4=0"

QUERIES = {
    "replay_favorites": (
        lambda spark, sf: text_tags(favorites(spark, sf)),
        d.EF + f"select {KEY}, array_to_string(tags, ',') as tags, created_at from favorites"),
    "replay_notes": (
        lambda spark, sf: notes(spark, sf),
        d.FN + f"select {KEY}, content, updated_at from notes"),
    "notes_with_entry": (
        lambda spark, sf: a.notes_with_entry(notes(spark, sf), d.entries(spark, sf)),
        d.EFN + f"select {KEY}, ccf_abbr, ccf_full, ccf_level, content, updated_at "
                "from notes join entries on entry_id=id"),
    "owner_notes_recent": (
        lambda spark, sf: a.list_notes(notes(spark, sf), d.entries(spark, sf), OWNER),
        d.EFN + f"select {KEY}, ccf_abbr, ccf_full, ccf_level, content, updated_at "
                f"from notes join entries on entry_id=id where {OWN} order by updated_at desc, entry_id"),
    "favorite_ids_recent": (
        lambda spark, sf: a.list_favorite_ids(favorites(spark, sf), OWNER),
        d.EF + f"select entry_id, created_at from favorites where {OWN} order by created_at desc, entry_id"),
    "annotated_for_owners": (
        lambda spark, sf: text_tags(a.annotate_for_owners(
            d.entries(spark, sf), favorites(spark, sf), notes(spark, sf), ["id", "ccf_abbr", "ccf_level"])),
        d.EFN + """select coalesce(f.owner_kind, n.owner_kind) as owner_kind, coalesce(f.owner_id, n.owner_id) as owner_id,
            e.id, e.ccf_abbr, e.ccf_level, coalesce(array_to_string(f.tags,','),'') as tags,
            coalesce(n.content,'') as note, f.entry_id is not null as is_favorite
          from favorites f full join notes n using (owner_kind, owner_id, entry_id)
          join entries e on e.id=coalesce(f.entry_id, n.entry_id)"""),
    "favorite_flags": (
        lambda spark, sf: a.is_favorite(_keys(spark, sf), favorites(spark, sf)),
        d.EF + f"select k.*, f.entry_id is not null as is_favorite from (select distinct {KEY} from ops) k "
               f"left join favorites f using ({KEY})"),
    "favorite_tags_or_empty": (
        lambda spark, sf: text_tags(a.tags_or_empty(_keys(spark, sf), favorites(spark, sf))),
        d.EF + f"select k.*, coalesce(array_to_string(f.tags,','),'') as tags from (select distinct {KEY} from ops) k "
               f"left join favorites f using ({KEY})"),
    "note_or_empty": (
        lambda spark, sf: a.note_or_empty(_keys(spark, sf), notes(spark, sf)),
        d.FN + f"select k.*, coalesce(n.content,'') as content from (select distinct {KEY} from ops) k "
               f"left join notes n using ({KEY})"),
    "tags_for_entries": (
        lambda spark, sf: text_tags(a.tags_for_entries(
            favorites(spark, sf), OWNER, d.entries(spark, sf).selectExpr("id as entry_id"))),
        d.EF + f"select entry_id, array_to_string(tags,',') as tags from favorites "
               f"where {OWN} and entry_id in (select id from entries)"),
    "notes_for_entries": (
        lambda spark, sf: a.notes_for_entries(
            notes(spark, sf), OWNER, d.entries(spark, sf).selectExpr("id as entry_id")),
        d.EFN + f"select entry_id, content from notes where {OWN} and entry_id in (select id from entries)"),
    "favorite_counts": (
        lambda spark, sf: a.favorite_counts(favorites(spark, sf)),
        d.EF + "select owner_kind, owner_id, count(*) as n from favorites group by all"),
    "guest_tags": (
        lambda spark, sf: a.guest_tags(favorites(spark, sf)),
        d.with_ctes(d.FAVORITES_CTE, GUEST_TAGS) + "select * from guest_tags"),
    "tag_in_use": (
        lambda spark, sf: a.tag_in_use(d.user_tags(spark, sf), favorites(spark, sf)),
        d.EFNL + """select t.*, exists (select 1 from favorites f where f.owner_kind='user' and f.owner_id=t.user_id
            and list_contains(f.tags, t.name)) as in_use from user_tags t"""),
    "list_user_tags": (
        lambda spark, sf: a.list_tags(favorites(spark, sf), d.user_tags(spark, sf), OWNER),
        d.EFNL + f"select name, color from user_tags where user_id='{USER}' order by name"),
    "remove_tags": (
        lambda spark, sf: text_tags(definitions.remove_tags(favorites(spark, sf), d.user_tags(spark, sf))),
        d.EF + f"""select {KEY}, array_to_string(case when owner_kind='user'
            then list_filter(tags, lambda t: t not in ('t1','unused')) else tags end, ',') as tags, created_at from favorites"""),
    "create_tags": (
        lambda spark, sf: definitions.create_tags(d.user_tags(spark, sf), _requests(spark, sf)),
        d.with_ctes(d.OPS_CTE, d.USER_TAGS_CTE, REQUESTS_CTE) + """select *,
            case when length(name)>20 then 'invalid'
              when exists (select 1 from user_tags t where t.user_id=requests.user_id and t.name=requests.name) then 'conflict'
              when row_number() over (partition by user_id, name order by created_at, request_id)>1 then 'conflict'
              else 'inserted' end as status from requests"""),
    "insert_absent_tags": (
        lambda spark, sf: definitions.insert_absent(
            d.user_tags(spark, sf),
            _requests(spark, sf).select("user_id", "name", "color", "created_at"), ["user_id", "name"]),
        d.with_ctes(d.OPS_CTE, d.USER_TAGS_CTE, REQUESTS_CTE) + """select * from user_tags
          union all select user_id, name, 'red', min(created_at) from requests
          where not exists (select 1 from user_tags t where t.user_id=requests.user_id and t.name=requests.name)
          group by user_id, name"""),
    "trimmed_notes": (
        lambda spark, sf: replay_notes(trimmed_notes(d.operations(spark, sf).withColumn(
            "content", F.concat(F.lit("\u3000 \n"), F.col("content"), F.lit(" \t\u00a0"))))),
        d.FN + f"select {KEY}, content, updated_at from notes"),
    "update_tags": (
        lambda spark, sf: definitions.update_tags(
            d.user_tags(spark, sf),
            d.logins(spark, sf).selectExpr("user_id", "'t1' as name", "'renamed' as new_name",
                                           "'green' as new_color").distinct()),
        d.EFNL + """select user_id, case when l then 'renamed' else name end as name,
            case when l then 'green' else color end as color, created_at
          from (select *, name='t1' and user_id in (select user_id from logins) as l from user_tags)"""),
    "delete_tags": (
        lambda spark, sf: definitions.delete_tags(
            d.user_tags(spark, sf), d.user_tags(spark, sf).select("user_id", "name"), favorites(spark, sf)),
        d.EFNL + """select * from user_tags t where exists (select 1 from favorites f where f.owner_kind='user'
            and f.owner_id=t.user_id and list_contains(f.tags, t.name))"""),
    "register_users": (
        lambda spark, sf: definitions.register_users(
            d.table(spark, sf, "customer").selectExpr("c_name as username").distinct(),
            d.operations(spark, sf).selectExpr(
                "event_id as request_id",
                "case when event_id%50=0 then 'ab' when event_id%3=0 then concat('Customer#', lpad(owner_id, 9, '0')) "
                "else concat('guest-', owner_id) end as username", "ts as created_at")),
        d.with_ctes(d.OPS_CTE) + """select *, case when length(username)<3 then 'invalid'
            when username in (select c_name from customer) then 'conflict'
            when row_number() over (partition by username order by created_at, request_id)>1 then 'conflict'
            else 'inserted' end as status
          from (select event_id as request_id, case when event_id%50=0 then 'ab'
              when event_id%3=0 then concat('Customer#', lpad(owner_id, 9, '0'))
              else concat('guest-', owner_id) end as username, ts as created_at from ops)"""),
    "merge_favorites": (
        lambda spark, sf: text_tags(merge.merge_favorites(favorites(spark, sf), d.logins(spark, sf))),
        d.with_ctes(d.FAVORITES_CTE, d.LOGINS_CTE, MERGED_FAV)
        + f"select {KEY}, array_to_string(tags, ',') as tags, created_at from merged_favorites"),
    "merge_notes": (
        lambda spark, sf: merge.merge_notes(notes(spark, sf), d.logins(spark, sf)),
        d.with_ctes(d.OPS_CTE, d.NOTES_CTE, d.LOGINS_CTE, MERGED_NOTES) + "select * from merged_notes"),
    "merge_tags": (
        lambda spark, sf: merge.merge_tags(d.user_tags(spark, sf), favorites(spark, sf), d.logins(spark, sf)),
        d.with_ctes(d.FAVORITES_CTE, d.LOGINS_CTE, d.USER_TAGS_CTE, GUEST_TAGS) + """
          select user_id, name, color, created_at from user_tags
          union all select user_id, name, '' as color, min(ts) from logins join guest_tags on owner_id=device_id
          where not exists (select 1 from user_tags t where t.user_id=logins.user_id and t.name=guest_tags.name)
          group by user_id, name"""),
    "orphans": (
        lambda spark, sf: text_tags(integrity.orphans(
            favorites(spark, sf), d.entries(spark, sf).where("type = 'journal'"))),
        d.EF + f"select {KEY}, array_to_string(tags, ',') as tags, created_at from favorites "
               "where entry_id not in (select id from entries where type='journal')"),
    "known_notes": (
        lambda spark, sf: integrity.with_known_entry(
            notes(spark, sf), d.entries(spark, sf).where("type = 'journal'")),
        d.EFN + f"select {KEY}, content, updated_at from notes "
                "where entry_id in (select id from entries where type='journal')"),
    "ownerless_notes": (
        lambda spark, sf: integrity.ownerless(notes(spark, sf), d.logins(spark, sf)),
        d.EFNL + f"select {KEY}, content, updated_at from notes where owner_kind='user' "
                 "and owner_id not in (select user_id from logins)"),
    "cascade_entries": (
        lambda spark, sf: integrity.without_entries(
            notes(spark, sf), d.entries(spark, sf).where("ccf_level = 'B'")),
        d.EFN + f"select {KEY}, content, updated_at from notes "
                "where entry_id not in (select id from entries where ccf_level='B')"),
    "cascade_users": (
        lambda spark, sf: text_tags(integrity.without_users(favorites(spark, sf), d.logins(spark, sf))),
        d.with_ctes(d.FAVORITES_CTE, d.LOGINS_CTE) + f"""select {KEY}, array_to_string(tags, ',') as tags, created_at
          from favorites where not (owner_kind='user' and owner_id in (select user_id from logins))"""),
    "cascade_user_tags": (
        lambda spark, sf: integrity.tags_without_users(d.user_tags(spark, sf), d.logins(spark, sf)),
        d.EFNL + "select * from user_tags where user_id not in (select user_id from logins)"),
}
