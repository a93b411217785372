"""List, facet and detail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import derived as d
from venuedir.operators import details, facets, filters, paging
from venuedir.plans.list_query import VenueQuery, matching, page

# A user with favourites at every scale.
USER = "2"

LIST = ("id, type, ccf_domain, ccf_level, ccf_abbr, ccf_full, ccf_publisher, ccf_url, letpub_url, issn, "
        "impact_factor, cite_score, h_index, json_extract_string(cas2025,'$.bigZone') as cas_zone, "
        "json_extract_string(xinrui,'$.bigZone') as xinrui_zone, wos_zone, sci_type, article_count, letpub_score")


def flat(rows):
    """List rows with the nested partitions reduced to their zones and tags to text."""
    out = rows.withColumns({"cas_zone": F.col("cas2025.bigZone"), "xinrui_zone": F.col("xinrui.bigZone")})
    out = out.drop("cas2025", "xinrui")
    return out.withColumn("tags", F.array_join("tags", ",")) if "tags" in out.columns else out


def listing(query: VenueQuery, after=None):
    def run(spark, sf):
        needs = query.owner is not None
        fav = favorites(spark, sf) if needs else None
        note = notes(spark, sf) if needs else None
        return flat(page(d.entries(spark, sf), query, fav, note, after))
    return run


def favorites(spark, sf):
    from venuedir.operators.replay import replay_favorites
    return replay_favorites(d.operations(spark, sf))


def notes(spark, sf):
    from venuedir.operators.replay import replay_notes
    return replay_notes(d.operations(spark, sf))


def filtered(query: VenueQuery, *columns: str):
    def run(spark, sf):
        needs = query.favorites and query.owner is not None
        fav = favorites(spark, sf) if needs else None
        return matching(d.entries(spark, sf), query, fav).select("id", "type", *columns)
    return run


ANON = ", '' as tags, '' as note, false as is_favorite"
ZONE = "json_extract_string({c},'$.bigZone')"
TOP = ("(coalesce(json_extract_string(cas2025,'$.isTop'),'false')='true' "
       "or coalesce(json_extract_string(xinrui,'$.isTop'),'false')='true')")
FOLD = "translate({c},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


def _keyword(text: str) -> str:
    tests = " or ".join(f"contains({FOLD.format(c=c)}, '{text}')"
                        for c in ("ccf_abbr", "ccf_full", "ccf_publisher"))
    return f"({tests})"


# Keyset start of the deep page: the row (impact_factor 9.5, id 500).
AFTER = {"impact_factor": 9.5, "id": 500}

QUERIES = {
    "list_page_by_metric": (
        listing(VenueQuery(type="journal", sort="impact_factor")),
        d.E_ + f"select {LIST}{ANON} from entries where type='journal' "
               "order by impact_factor desc nulls last, id limit 20"),
    "list_page_default_desc": (
        listing(VenueQuery(order="desc", page=2, per_page=50)),
        d.E_ + f"select {LIST}{ANON} from entries order by ccf_level, ccf_abbr desc, id limit 50 offset 50"),
    "list_page_nulls_first": (
        listing(VenueQuery(type="journal", sort="cite_score", order="asc", per_page=100)),
        d.E_ + f"select {LIST}{ANON} from entries where type='journal' "
               "order by cite_score asc nulls first, id limit 100"),
    "list_page_by_name": (
        listing(VenueQuery(type="conference", sort="name", page=3)),
        d.E_ + f"select {LIST}{ANON} from entries where type='conference' order by ccf_abbr, id limit 20 offset 40"),
    "list_page_deep": (
        listing(VenueQuery(type="journal", sort="impact_factor", per_page=100), AFTER),
        d.E_ + f"select {LIST}{ANON} from entries where type='journal' "
               "and (impact_factor<9.5 or (impact_factor=9.5 and id>500) or impact_factor is null) "
               "order by impact_factor desc nulls last, id limit 100"),
    "list_past_the_end": (
        listing(VenueQuery(type="journal", page=1000000, per_page=1)),
        d.E_ + f"select {LIST}{ANON} from entries where type='journal' "
               "order by ccf_level, ccf_abbr, id limit 1 offset 999999"),
    "list_envelope": (
        lambda spark, sf: paging.envelope(
            matching(d.entries(spark, sf), VenueQuery(type="journal", level="A,B")), 2, 30),
        d.E_ + "select count(*) as total, 2 as page, 30 as per_page, cast(ceil(count(*)/30.0) as bigint) as total_pages "
               "from entries where type='journal' and ccf_level in ('A','B')"),
    "list_annotated": (
        listing(VenueQuery(user_id=USER, sort="h_index", order="asc", per_page=100)),
        d.EFN + f"""select {LIST}, coalesce(array_to_string(f.tags,','),'') as tags, coalesce(n.content,'') as note,
            f.entry_id is not null as is_favorite
          from (select * from entries order by h_index asc nulls first, id limit 100) e
          left join (select entry_id, tags from favorites where owner_kind='user' and owner_id='{USER}') f on f.entry_id=e.id
          left join (select entry_id, content from notes where owner_kind='user' and owner_id='{USER}') n on n.entry_id=e.id"""),
    "filter_domain_level": (
        filtered(VenueQuery(domain="ECONOMY, PROMO", level="A,C"), "ccf_domain", "ccf_level"),
        d.E_ + "select id, type, ccf_domain, ccf_level from entries "
               "where ccf_domain in ('ECONOMY','PROMO') and ccf_level in ('A','C')"),
    "filter_zone": (
        filtered(VenueQuery(cas_zone="1,3区"), "ccf_abbr"),
        d.E_ + f"select id, type, ccf_abbr from entries where {ZONE.format(c='cas2025')} in ('1区','3区')"),
    "filter_zone_xinrui": (
        filtered(VenueQuery(zones={"xinrui": "2", "wos_zone": "1区,2"}), "wos_zone"),
        d.E_ + f"select id, type, wos_zone from entries where {ZONE.format(c='xinrui')}='2区' "
               "and wos_zone in ('1区','2区')"),
    "filter_top": (
        filtered(VenueQuery(top=True), "ccf_abbr"),
        d.E_ + f"select id, type, ccf_abbr from entries where {TOP}"),
    "search_keyword": (
        filtered(VenueQuery(q="WIDGET eco"), "ccf_full"),
        d.E_ + f"select id, type, ccf_full from entries where {_keyword('widget eco')}"),
    "search_literal_wildcard": (
        filtered(VenueQuery(q="#1_"), "ccf_full"),
        d.E_ + f"select id, type, ccf_full from entries where {_keyword('#1_')}"),
    # Whole document texts as names; as a wildcard the character would match them all.
    "search_texts_percent": (
        lambda spark, sf: d.table(spark, sf, "documents").select(
            F.col("doc_id").alias("id"), F.col("lang").alias("ccf_abbr"), F.col("text").alias("ccf_full"),
            F.col("source").alias("ccf_publisher")).where(VenueQuery(q="%").predicate()).select("id", "ccf_abbr"),
        "select doc_id as id, lang as ccf_abbr from documents "
        "where contains(lang,'%') or contains(text,'%') or contains(source,'%')"),
    "filter_everything": (
        filtered(VenueQuery(type="journal", level="B,C", cas_zone="2", q="brand#1"), "ccf_abbr", "impact_factor"),
        d.E_ + f"select id, type, ccf_abbr, impact_factor from entries where type='journal' and ccf_level in ('B','C') "
               f"and {ZONE.format(c='cas2025')}='2区' and {_keyword('brand#1')}"),
    "favorites_only": (
        filtered(VenueQuery(user_id=USER, favorites=True), "ccf_abbr"),
        d.EF + f"select id, type, ccf_abbr from entries where exists (select 1 from favorites f "
               f"where f.entry_id=id and owner_kind='user' and owner_id='{USER}')"),
    "favorites_by_tag": (
        filtered(VenueQuery(device_id="3", favorites=True, tag="T1"), "ccf_abbr"),
        d.EF + "select id, type, ccf_abbr from entries where exists (select 1 from favorites f where f.entry_id=id "
               "and owner_kind='device' and owner_id='3' and len(list_filter(tags, lambda t: lower(t)='t1'))>0)"),
    "favorites_without_identity": (
        filtered(VenueQuery(favorites=True, tag="T1", level="A"), "ccf_abbr"),
        d.E_ + "select id, type, ccf_abbr from entries where ccf_level='A'"),
    "point_lookups": (
        lambda spark, sf: filters.by_ids(
            d.entries(spark, sf), d.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
        ).select("id", "ccf_abbr"),
        d.E_ + "select id, ccf_abbr from entries where id in (select l_partkey from lineitem)"),
    "facet_stats": (
        lambda spark, sf: facets.all_facets(d.entries(spark, sf)),
        d.E_ + f"""select 'type' as dimension, type as key, count(*) as n from entries group by all
          union all select 'domain', ccf_domain, count(*) from entries group by all
          union all select 'level', ccf_level, count(*) from entries group by all
          union all select 'cas_zone', coalesce(case when {ZONE.format(c='cas2025')} in ('1区','2区','3区','4区')
             then {ZONE.format(c='cas2025')} end, '未分区'), count(*) from entries where type='journal' group by all"""),
    "type_totals": (
        lambda spark, sf: facets.type_totals(d.entries(spark, sf)),
        d.E_ + "select count(*) filter (type='journal') as total_journals, "
               "count(*) filter (type='conference') as total_conferences from entries"),
    "domain_counts": (
        lambda spark, sf: facets.domain_counts(d.entries(spark, sf)),
        d.E_ + "select ccf_domain, count(*) as n from entries group by all"),
    "level_counts": (
        lambda spark, sf: facets.level_counts(d.entries(spark, sf)),
        d.E_ + "select ccf_level, count(*) as n from entries group by all order by 1"),
    "zone_buckets": (
        lambda spark, sf: facets.zone_buckets(d.entries(spark, sf)),
        d.E_ + f"select coalesce({ZONE.format(c='cas2025')}, '未分区') as zone, count(*) as n "
               "from entries where type='journal' group by all"),
    "entry_detail": (
        lambda spark, sf: details.entry_detail(
            d.entries(spark, sf), favorites(spark, sf), 7, _owner()
        ).select("id", "ccf_abbr", "issn", "impact_factor", "five_year_if", "self_citation_rate",
                 F.col("cas2025.bigCategory").alias("cas_category"),
                 F.size("jif").alias("n_jif"), "is_favorite"),
        d.EF + f"""select id, ccf_abbr, issn, impact_factor, five_year_if, self_citation_rate,
            json_extract_string(cas2025,'$.bigCategory') as cas_category,
            cast(json_array_length(jif) as integer) as n_jif,
            exists (select 1 from favorites where owner_kind='user' and owner_id='{USER}' and entry_id=7) as is_favorite
          from entries where id=7"""),
    "partition_compare": (
        lambda spark, sf: details.partition_comparison(d.entries(spark, sf)),
        d.E_ + "select id, position, version, j is not null as has_data, " + ", ".join(
            f"json_extract_string(j,'$.{f}') as {f}" for f in ("bigZone", "bigCategory", "smallZone", "smallCategory"))
        + """, coalesce(json_extract_string(j,'$.isTop'),'false')='true' as "isTop" from (
            select id, 0 as position, '新锐 2026' as version, xinrui as j from entries
            union all select id, 1, '中科院 2025', cas2025 from entries
            union all select id, 2, '中科院 2023', cas2023 from entries)"""),
    "rankings_jif": (
        lambda spark, sf: details.jif_rankings(d.entries(spark, sf)),
        d.E_ + """select id, cast(i as integer) as position, """ + ", ".join(
            f"json_extract_string(jif, '$[' || i || '].{f}') as {f}" for f in ("subject", "subset", "quartile", "rank"))
        + " from (select id, jif, unnest(range(json_array_length(jif)::bigint)) as i from entries)"),
    "rankings_jci": (
        lambda spark, sf: details.jci_rankings(d.entries(spark, sf)),
        d.E_ + "select id, 0 as position, " + ", ".join(
            f"json_extract_string(jci_json, '$[0].{f}') as {f}" for f in ("subject", "subset", "quartile", "rank"))
        + " from entries where jci_json is not null"),
    "rankings_citescore": (
        lambda spark, sf: details.citescore_rankings(d.entries(spark, sf)),
        d.E_ + "select id, 0 as position, " + ", ".join(
            f"json_extract_string(citescore_rankings, '$[0].{f}') as {f}" for f in ("category", "zone", "rank"))
        + " from entries where citescore_rankings is not null"),
    "metric_panel": (
        lambda spark, sf: details.metric_panel(d.entries(spark, sf)),
        d.E_ + " union all ".join(
            f"select id, '{m}' as metric, cast({m} as double) as value, "
            + (f"cast({m} as string)" if k is None else
               # C rounding breaks exact ties to even; the display rounds them up
               f"printf('%.{k}f', {m} + case when {m}*8=floor({m}*8) then 1e-6 else 0 end)")
            + " as display from entries" for m, k in details.PANEL_METRICS.items())),
}


def _owner():
    from venuedir.operators.owners import Owner
    return Owner("user", USER)
