"""Keyword index, facet bitmaps, ranked rows, dense ids, and answers to odd input."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import catalog, plans
from parity import derived as d
from venuedir import schema
from venuedir.operators import annotations, bitmaps, definitions
from venuedir.operators.keyword_index import KeywordIndex
from venuedir.operators.owners import Owner
from venuedir.operators.ranks import RankedRows
from venuedir.plans.list_query import VenueQuery
from venuedir.session import shared_dir
from venuedir.sources import catalogue, large, records


def indexed(spark, rows, text):
    """Rows that hold the keyword, through an index built for them."""
    index = KeywordIndex(shared_dir(spark, "keywords"), buckets=8)
    index.build(rows)
    return index.search(rows, text)


def texts_as_names(spark, sf):
    """Whole documents in the place of names."""
    return d.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("ccf_abbr"), F.col("text").alias("ccf_full"), F.col("source").alias("ccf_publisher"))


def positioned(spark, sf):
    """Entries with dense positions in the order of the filter columns."""
    return catalogue.load_order_ids(d.entries(spark, sf), bitmaps.POSITION_ORDER, "position", first=0)


def stored_bitmaps(spark, rows):
    path = shared_dir(spark, "bitmaps")
    bitmaps.facet_bitmaps(rows).write.parquet(path)
    return spark.read.parquet(path)


def filtered_facets(query):
    return lambda spark, sf: bitmaps.filtered_facets(stored_bitmaps(spark, positioned(spark, sf)), query)


def favorite_facets(spark, sf):
    """Facets of what one user has as favourites, among top venues."""
    rows = positioned(spark, sf)
    own = catalog.favorites(spark, sf).where(f"owner_kind='user' and owner_id='{catalog.USER}'").select(F.col("entry_id").alias("id"))
    held = bitmaps.position_bitmaps(rows.join(own, "id", "left_semi"), "favorites")
    return bitmaps.filtered_facets(stored_bitmaps(spark, rows), VenueQuery(top=True), held)


def facets_sql(test):
    zone = catalog.ZONE.format(c="cas2025")
    return f"""select 'type' as dimension, type as key, count(*) as n from entries where {test} group by all
      union all select 'domain', ccf_domain, count(*) from entries where {test} group by all
      union all select 'level', ccf_level, count(*) from entries where {test} group by all
      union all select 'cas_zone', coalesce(case when {zone} in ('1区','2区','3区','4区') then {zone} end, '未分区'), count(*)
        from entries where type='journal' and {test} group by all"""


def ranked_page(spark, sf):
    """A page in the middle of all entries by impact factor, out of ranges of a hundred rows."""
    ranked = RankedRows(shared_dir(spark, "ranked"), "impact_factor", "desc")
    ranked.build(d.entries(spark, sf), range_rows=100)
    return catalog.flat(ranked.page(spark, 3, 60).select(*schema.LIST_COLUMNS))


def loaded_when_empty(spark, sf):
    """Into a table without rows, then again with other rows, which stay out."""
    path, rows = shared_dir(spark, "entries"), d.entries(spark, sf)
    catalogue.write_entries(rows.where("false"), path)
    first = catalogue.load_if_empty(rows.where("id % 2 = 0"), path)
    again = catalogue.load_if_empty(rows, path)
    stored = catalogue.read_entries(spark, path)
    return stored.select("id", "type", "ccf_abbr", F.lit(first).alias("first"), F.lit(again).alias("again"))


# One keyed document per supplier: a sound member, and odd ones that must not spoil it.
ODD_KEYED = ("concat('{\"S', cast(s_suppkey as string), '\":{\"issn\":\"', lpad(cast(s_suppkey as string), 8, '0'), '\"},', "
             "case s_suppkey%5 when 0 then '\"n\":7' when 1 then '\"t\":\"x{y\"' when 2 then '\"l\":[{\"issn\":\"1\"}]' "
             "when 3 then '\"z\":null' else '\"T\":{\"issn\":\"9\"}' end, '}')")


def keyed_members(spark, sf):
    documents = d.table(spark, sf, "supplier").selectExpr(f"{ODD_KEYED} as value")
    good = records.flatten_keyed(documents, schema.OLDER_METRIC).selectExpr("abbr as key", "issn as text", "'record' as kind")
    return good.unionByName(records.keyed_rejects(documents, schema.OLDER_METRIC).selectExpr("key", "value as text", "reject_reason as kind"))


ODD_DOMAINS = ("concat('{\"', p_brand, '\":[{\"abbr\":\"a', cast(p_partkey as string), '\",\"level\":\"A\"},', "
               "case p_partkey%3 when 0 then '7' when 1 then '\"x\"' else '{\"abbr\":\"second\"}' end, '],\"odd\":5}')")


def domain_members(spark, sf):
    documents = d.table(spark, sf, "part").selectExpr(f"{ODD_DOMAINS} as value")
    good = records.flatten_by_domain(documents).selectExpr("domain as key", "abbr as text", "'record' as kind")
    return good.unionByName(records.by_domain_rejects(documents).selectExpr("key", "value as text", "reject_reason as kind"))


# Tag updates: renames onto free, taken and over-long names, a swap, colours, and tags nobody has.
UPDATES = [
    "event_id as request_id", "owner_id as user_id",
    "case when event_id%5=0 then 'none' when event_id%2=0 then 't1' else 'unused' end as name",
    "case event_id%7 when 0 then 't1' when 1 then 'unused' when 2 then repeat('y', 21) when 3 then 'fresh' when 4 then 'fresh' end as new_name",
    "case when event_id%3=0 then 'red' end as new_color"]


def tag_updates(spark, sf):
    return d.operations(spark, sf).where("owner_kind = 'user' and op = 'note_delete'").selectExpr(*UPDATES)


UPDATES_CTE = f"""updates as (select {', '.join(UPDATES)}
    from ops where owner_kind='user' and op='note_delete'),
asked as (select *, coalesce(length(new_name), 1) between 1 and 20 as valid,
    exists (select 1 from user_tags t where t.user_id=updates.user_id and t.name=updates.name) as known from updates),
best as (select * from (select user_id, name, new_name, new_color, row_number() over (partition by user_id, name
    order by new_name desc nulls last, new_color desc nulls last) as rn from asked where valid and known) where rn=1),
decided as (select b.*, case when new_name is null or new_name=name then true
    when exists (select 1 from user_tags t where t.user_id=b.user_id and t.name=b.new_name) then false
    else name=(select min(o.name) from best o where o.user_id=b.user_id and o.new_name=b.new_name and o.name<>o.new_name) end as done from best b)"""
UPDATE_STATUS = """select a.request_id, a.user_id, a.name, a.new_name, a.new_color, case when not known then 'not_found' when not valid then 'invalid'
    when a.new_name is distinct from x.new_name or a.new_color is distinct from x.new_color then 'superseded'
    when done then 'updated' else 'conflict' end as status
  from asked a left join decided x on x.user_id=a.user_id and x.name=a.name"""

NESTED = ["xinrui", "cas2025", "cas2023", "jif", "jci_json", "citescore_rankings"]


def full_rows(spark, sf):
    """All 43 columns of the stored catalogue, nested ones as JSON."""
    path = shared_dir(spark, "entries")
    catalogue.write_entries(d.entries(spark, sf), path)
    return catalogue.read_entries(spark, path).withColumns({c: F.to_json(c) for c in NESTED})


def users(spark, sf):
    return d.table(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as username", "c_mktsegment as created_at")


def found_users(spark, sf):
    """By the names of some customers and unknown ones, and by the ids of orders."""
    names = d.table(spark, sf, "orders").selectExpr("concat('Customer#', lpad(cast(o_custkey*2 as string), 9, '0')) as username")
    ids = d.table(spark, sf, "orders").selectExpr("o_custkey + 5 as id")
    table = users(spark, sf)
    return definitions.lookup_users(table, names).withColumn("found_by", F.lit("name")).unionByName(
        definitions.lookup_users(table, ids, by="id").withColumn("found_by", F.lit("id")))


def large_export(spark, sf):
    """Entries written as one document in parts, read back from its pieces."""
    path = shared_dir(spark, "document")
    large.write_large_export(d.entries(spark, sf), path)
    journals, conferences, _ = large.read_large_import(spark, path, whole_folder=True)
    return catalogue.import_catalogue(journals, conferences)


def large_keyed(spark, sf):
    """One keyed document in parts, a line per supplier, with the odd members among them."""
    path = shared_dir(spark, "keyed")
    lines = d.table(spark, sf, "supplier").selectExpr("s_suppkey as k", f"substr({ODD_KEYED}, 2, length({ODD_KEYED}) - 2) as value")
    first = d.table(spark, sf, "supplier").agg(F.min("s_suppkey").alias("k")).withColumn("leads", F.lit(True))
    lines = lines.join(first, "k", "left").select("k", F.concat(F.when(F.col("leads"), "{").otherwise(","), "value").alias("value"))
    lines = lines.unionByName(d.table(spark, sf, "supplier").agg((F.max("s_suppkey") + 1).alias("k"), F.lit("}").alias("value")))
    lines.repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)
    good, bad = large.read_large_keyed(spark, path, schema.OLDER_METRIC, whole_folder=True)
    return good.selectExpr("abbr as key", "issn as text", "'record' as kind").unionByName(
        bad.selectExpr("key", "value as text", "reject_reason as kind"))


GUEST = Owner("device", "3")


def _sorted_page(sort, order, sql_order):
    return (catalog.listing(VenueQuery(sort=sort, order=order, page=2, per_page=40)),
            d.E_ + f"select {catalog.LIST}{catalog.ANON} from entries order by {sql_order}, id limit 40 offset 40")


QUERIES = {
    "search_keyword_indexed": (
        lambda spark, sf: indexed(spark, d.entries(spark, sf), "WIDGET eco").select("id", "type", "ccf_full"),
        catalog.QUERIES["search_keyword"][1]),
    "search_literal_indexed": (
        lambda spark, sf: indexed(spark, d.entries(spark, sf), "#1_").select("id", "type", "ccf_full"),
        catalog.QUERIES["search_literal_wildcard"][1]),
    "search_texts_indexed": (
        lambda spark, sf: indexed(spark, texts_as_names(spark, sf), "://").select("id", "ccf_abbr"),
        "select doc_id as id, lang as ccf_abbr from documents where contains(lang,'://') or contains(text,'://') or contains(source,'://')"),
    "facets_filtered": (
        filtered_facets(VenueQuery(level="A,B", zones={"wos_zone": "1,2"})),
        d.E_ + facets_sql("ccf_level in ('A','B') and wos_zone in ('1区','2区')")),
    "facets_unfiltered": (
        filtered_facets(VenueQuery()), catalog.QUERIES["facet_stats"][1]),
    "facets_of_favorites": (
        favorite_facets,
        d.EF + facets_sql(f"{catalog.TOP} and id in (select entry_id from favorites where owner_kind='user' and owner_id='{catalog.USER}')")),
    "list_envelope_bitmaps": (
        lambda spark, sf: bitmaps.filtered_envelope(
            stored_bitmaps(spark, positioned(spark, sf)), VenueQuery(type="journal", level="A,B", page=2, per_page=30)),
        catalog.QUERIES["list_envelope"][1]),
    "list_page_ranked": (
        ranked_page,
        d.E_ + f"select {catalog.LIST} from entries order by impact_factor desc nulls last, id limit 60 offset 120"),
    "load_order_ids": (
        lambda spark, sf: catalogue.load_order_ids(d.entries(spark, sf).select("ccf_full", "ccf_abbr"), ["ccf_full", "ccf_abbr"]),
        d.E_ + "select ccf_full, ccf_abbr, row_number() over (order by ccf_full, ccf_abbr) as id from entries"),
    "duplicate_entries": (
        lambda spark, sf: catalogue.duplicate_entries(d.entries(spark, sf).withColumn(
            "id", F.expr("case when id%10=3 then id - 1 else id end")).unionByName(d.entries(spark, sf).where("id%4 = 1"))),
        d.E_ + """select id, count(*) as n_rows, count(distinct ccf_abbr) as n_keys from (
            select case when id%10=3 then id-1 else id end as id, ccf_abbr from entries
            union all select id, ccf_abbr from entries where id%4=1) group by 1 having count(*)>1"""),
    "load_if_empty": (
        loaded_when_empty,
        d.E_ + "select id, type, ccf_abbr, true as first, false as again from entries where id%2=0"),
    "keyed_odd_members": (
        keyed_members,
        """select concat('S', cast(s_suppkey as string)) as key, lpad(cast(s_suppkey as string), 8, '0') as text, 'record' as kind from supplier
          union all select 'T', '9', 'record' from supplier where s_suppkey%5=4
          union all select case s_suppkey%5 when 0 then 'n' when 1 then 't' when 2 then 'l' else 'z' end,
            case s_suppkey%5 when 0 then '7' when 1 then 'x{y' when 2 then '[{"issn":"1"}]' end, 'bad_json' from supplier where s_suppkey%5<>4"""),
    "large_keyed_members": (
        large_keyed,
        """select concat('S', cast(s_suppkey as string)) as key, lpad(cast(s_suppkey as string), 8, '0') as text, 'record' as kind from supplier
          union all select 'T', '9', 'record' from supplier where s_suppkey%5=4
          union all select case s_suppkey%5 when 0 then 'n' when 1 then 't' when 2 then 'l' else 'z' end,
            case s_suppkey%5 when 0 then '7' when 1 then 'x{y' when 2 then '[{"issn":"1"}]' end, 'bad_json' from supplier where s_suppkey%5<>4"""),
    "domain_odd_members": (
        domain_members,
        """select p_brand as key, concat('a', cast(p_partkey as string)) as text, 'record' as kind from part
          union all select p_brand, 'second', 'record' from part where p_partkey%3=2
          union all select p_brand, case p_partkey%3 when 0 then '7' else 'x' end, 'bad_json' from part where p_partkey%3<>2
          union all select 'odd', '5', 'bad_json' from part"""),
    "large_export_and_back": (
        lambda spark, sf: large_export(spark, sf).select(
            *plans.STORED[1:], F.col("cas2025.bigZone").alias("cas_zone"), F.size("jif").alias("n_jif")),
        plans.QUERIES["exported_entries"][1]),
    "tag_update_status": (
        lambda spark, sf: definitions.update_outcomes(d.user_tags(spark, sf), tag_updates(spark, sf)),
        d.with_ctes(d.OPS_CTE, d.USER_TAGS_CTE, UPDATES_CTE) + UPDATE_STATUS),
    "tag_updates_applied": (
        lambda spark, sf: definitions.update_tags(d.user_tags(spark, sf), tag_updates(spark, sf)),
        d.with_ctes(d.OPS_CTE, d.USER_TAGS_CTE, UPDATES_CTE) + """select t.user_id, coalesce(x.new_name, t.name) as name,
            coalesce(x.new_color, t.color) as color, created_at
          from user_tags t left join (select * from decided where done) x on x.user_id=t.user_id and x.name=t.name"""),
    "full_row": (
        full_rows,
        d.E_ + f"select {', '.join(schema.ENTRY_COLUMNS)} from entries"),
    "lookup_users": (
        found_users,
        """select c_custkey as id, c_name as username, c_mktsegment as created_at, 'name' as found_by from customer
            where c_name in (select concat('Customer#', lpad(cast(o_custkey*2 as string), 9, '0')) from orders)
          union all select c_custkey, c_name, c_mktsegment, 'id' from customer where c_custkey in (select o_custkey+5 from orders)"""),
    "list_guest_tags": (
        lambda spark, sf: annotations.list_tags(catalog.favorites(spark, sf), d.user_tags(spark, sf), GUEST),
        d.with_ctes(d.FAVORITES_CTE) + "select distinct unnest(tags) as name, '' as color from favorites "
                                       "where owner_kind='device' and owner_id='3'"),
    "list_page_by_articles": _sorted_page("article_count", "", "article_count desc nulls last"),
    "list_page_by_score": _sorted_page("letpub_score", "asc", "letpub_score asc nulls first"),
    "list_page_by_level": _sorted_page("ccf_level", "desc", "ccf_level desc nulls last"),
}
