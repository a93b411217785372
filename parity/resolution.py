"""Candidates, id resolution, worklists and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import derived as d
from venuedir import schema
from venuedir.operators import ledger, resolve
from venuedir.sources import records

# A catalogue row per customer, and the result pages of its three searches.
_ID = "cast(c_custkey as string)"
CATALOGUE = (f"c_custkey as id, 'journal' as type, c_mktsegment as domain, concat('C', {_ID}) as abbr, c_name as {{full}}, "
             f"case when c_custkey%4=0 then lpad({_ID}, 8, '0') else '-' end as issn")


def _link(base: int, name: str) -> str:
    return f"'<a class=x href=\"/?journalid=', cast({base}+c_custkey as string), '&v=1\">', {name}, '</a>'"


NAME_PAGE = ("concat('<ul>', " + _link(200000, "'Other'")
             + ", case c_custkey%5 when 1 then concat(" + _link(300000, "upper(replace(c_name,'#',' '))")
             + ") when 2 then concat(" + _link(400000, "concat(c_name,' Ltd')")
             + ") when 4 then concat(" + _link(500000, "'Another'") + ") else '' end, '</ul>')")
ISSN_PAGE = "concat('<img href=\"?JOURNALID=', cast(100000+c_custkey as string), '\"><p>journalid=7</p>')"
ABBR_PAGE = ("concat(" + _link(700000, "'Zzz'") + ", case when c_custkey%2=0 then concat("
             + _link(600000, f"concat('The c-', {_ID}, ' review')") + ") else '' end)")


def catalogue(spark, sf):
    rows = d.table(spark, sf, "customer").selectExpr(
        *[c.strip() for c in _top_level(CATALOGUE.format(full="full"))])
    return rows


def _top_level(expressions: str) -> list[str]:
    """Split a select list at its outer commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(expressions):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(expressions[start:i])
            start = i + 1
    return [*out, expressions[start:]]


def result_pages(spark, sf):
    cust = d.table(spark, sf, "customer")
    kinds = [
        cust.where("c_custkey%5<>0").selectExpr("'name' as query_kind", "c_name as query_key", f"{NAME_PAGE} as html"),
        cust.where("c_custkey%4=0 and c_custkey%8<>4").selectExpr(
            "'issn' as query_kind", f"lpad({_ID}, 8, '0') as query_key", f"{ISSN_PAGE} as html"),
        cust.selectExpr("'abbr' as query_kind", f"concat('C', {_ID}) as query_key", f"{ABBR_PAGE} as html"),
    ]
    return d.union_all(kinds)


def candidates(spark, sf):
    return resolve.extract_candidates(result_pages(spark, sf))


CANDIDATES_SQL = f"""
select 'issn' as query_kind, lpad({_ID}, 8, '0') as query_key, 0 as pos, cast(100000+c_custkey as string) as journalid,
  cast(null as string) as name from customer where c_custkey%8=0
union all select 'issn', lpad({_ID}, 8, '0'), 1, '7', null from customer where c_custkey%8=0
union all select 'name', c_name, 0, cast(200000+c_custkey as string), 'Other' from customer where c_custkey%5<>0
union all select 'name', c_name, 1, cast(case c_custkey%5 when 1 then 300000 when 2 then 400000 else 500000 end + c_custkey as string),
  case c_custkey%5 when 1 then upper(replace(c_name,'#',' ')) when 2 then concat(c_name,' Ltd') else 'Another' end
  from customer where c_custkey%5 in (1,2,4)
union all select 'abbr', concat('C', {_ID}), 0, cast(700000+c_custkey as string), 'Zzz' from customer
union all select 'abbr', concat('C', {_ID}), 1, cast(600000+c_custkey as string), concat('The c-', {_ID}, ' review')
  from customer where c_custkey%2=0"""

# Tiers by joining catalogue and candidates row by row, unlike the aggregated answers.
NORM = "regexp_replace(upper({c}),'[^A-Z0-9]','','g')"
RESOLVED_SQL = f"""with cat as (select {CATALOGUE.format(full='full_name')} from customer),
cand as ({CANDIDATES_SQL}),
hits as (
  select id, 1 as tier, pos, journalid from cat join cand on query_kind='issn' and query_key=issn and issn not in ('','-')
  union all select id, case when a=b then 2 when contains(a,b) or contains(b,a) then 3 else 4 end, pos, journalid
    from (select id, pos, journalid, {NORM.format(c='name')} as a, {NORM.format(c='full_name')} as b
          from cat join cand on query_kind='name' and query_key=full_name)
  union all select id, 3.5, pos, journalid from cat join cand on query_kind='abbr' and query_key=abbr
    and contains({NORM.format(c='name')}, {NORM.format(c='abbr')})),
names as (select query_key, count(*) as n from cand where query_kind='name' group by all),
best as (select id, first(tier order by tier, pos) as tier, first(journalid order by tier, pos) as journalid
         from hits where {{tiers}} group by id)
"""
METHOD = ("case when tier is null then 'none' when tier=1 then 'issn' when tier=2 then 'name_exact' "
          "when tier=3 then 'name_partial' when n=1 then 'name_single' else 'name_first' end")
# The abbreviation counts only where the name search had several results.
ABBR_TIERS = ("tier<>3.5 or id in (select c.id from cat c join names on query_key=c.full_name where n>1)")

# Attempts: one per order, keyed by customer.
ATTEMPTS = ("'journal' as type, cast(o_custkey%7 as string) as domain, cast(o_custkey as string) as abbr, "
            "case o_orderpriority when '1-URGENT' then cast(o_orderkey as string) when '2-HIGH' then '0' end as journalid, "
            "'name_exact' as method, case o_orderstatus when 'F' then 'n' else '' end as name, o_orderkey as ts")


def attempts(spark, sf):
    return d.table(spark, sf, "orders").selectExpr(*_top_level(ATTEMPTS))


def ledger_rows(spark, sf):
    return ledger.outcomes(attempts(spark, sf))


OUTCOMES = f"""attempts as (select {ATTEMPTS} from orders),
outcomes as (select type, domain, abbr, s as status, case when s<>'not_found' then journalid end as journalid,
    case when s='success' then method end as method, ts
  from (select *, case when coalesce(journalid,'') in ('','0') then 'not_found' when name='' then 'parse_failed' else 'success' end as s from attempts)),
current as (select * exclude (rn) from (select *, row_number() over (partition by type, domain, abbr
  order by case when status='success' then 0 else 1 end, ts desc) as rn from outcomes) where rn=1)"""


def worklist(spark, sf):
    return d.table(spark, sf, "customer").selectExpr(
        "'journal' as type", "cast(c_custkey%7 as string) as domain", "cast(c_custkey as string) as abbr", "c_name")


def results(spark, sf, *status):
    rows = d.table(spark, sf, "orders").where(F.col("o_orderstatus").isin(*status))
    return rows.selectExpr("'journal' as type", "'x' as domain", "cast(o_custkey as string) as abbr",
                           "o_totalprice as price", "o_orderkey as ts")


QUERIES = {
    "extract_candidates": (
        lambda spark, sf: candidates(spark, sf),
        CANDIDATES_SQL),
    "resolve_ids": (
        lambda spark, sf: resolve.resolve(catalogue(spark, sf), candidates(spark, sf)).select("id", "journalid", "method"),
        RESOLVED_SQL.format(tiers="tier<>3.5")
        + f"select cat.id, journalid, {METHOD} as method from cat left join best using (id) left join names on query_key=full_name"),
    "resolve_with_abbreviation": (
        lambda spark, sf: resolve.resolve_with_abbreviation(
            catalogue(spark, sf), candidates(spark, sf)).select("id", "journalid", "method"),
        RESOLVED_SQL.format(tiers=ABBR_TIERS)
        + "select cat.id, journalid, case when tier is null then 'none' when tier=1 then 'issn' else 'name' end as method "
          "from cat left join best using (id)"),
    "resolve_known_ids": (
        lambda spark, sf: resolve.keep_known_ids(resolve.resolve(
            catalogue(spark, sf).withColumn("known_id", F.expr(
                "case when id%6=0 then '0' when id%6=1 then cast(id as string) end")),
            candidates(spark, sf))).select("id", "journalid", "method"),
        RESOLVED_SQL.format(tiers="tier<>3.5")
        + f"select cat.id, case when cat.id%6=1 then cast(cat.id as string) else journalid end as journalid, "
          f"case when cat.id%6=1 then 'cached_id' else {METHOD} end as method "
          "from cat left join best using (id) left join names on query_key=full_name"),
    "resolve_methods": (
        lambda spark, sf: resolve.resolve(catalogue(spark, sf), candidates(spark, sf)).groupBy("method").agg(
            F.count(F.lit(1)).alias("n")),
        RESOLVED_SQL.format(tiers="tier<>3.5")
        + f"select {METHOD} as method, count(*) as n from cat left join best using (id) left join names on query_key=full_name group by 1"),
    "catalogue_issn": (
        lambda spark, sf: ledger.with_issn(
            d.table(spark, sf, "customer").selectExpr("c_custkey", f"concat('S', {_ID}) as abbr"),
            records.flatten_keyed(_keyed(spark, sf), schema.OLDER_METRIC)),
        f"select c_custkey, concat('S', {_ID}) as abbr, case when s_suppkey is null then '' else lpad(cast(s_suppkey as string), 8, '0') end as issn "
        "from customer left join supplier on s_suppkey=c_custkey"),
    "outcome_ledger": (
        lambda spark, sf: ledger.current_ledger(ledger_rows(spark, sf)),
        f"with {OUTCOMES} select * from current"),
    "outcome_summary": (
        lambda spark, sf: ledger.run_summary(ledger.current_ledger(ledger_rows(spark, sf))),
        f"with {OUTCOMES} select status, count(*) as n from current group by all"),
    "resume_worklist": (
        lambda spark, sf: ledger.remaining(worklist(spark, sf), ledger_rows(spark, sf)),
        f"with {OUTCOMES} select 'journal' as type, cast(c_custkey%7 as string) as domain, cast(c_custkey as string) as abbr, c_name "
        "from customer where cast(c_custkey as string) not in (select abbr from outcomes where status='success')"),
    "merge_extracted": (
        lambda spark, sf: ledger.merge_extracted(
            d.table(spark, sf, "orders").selectExpr("cast(o_custkey as string) as journalid", "o_orderkey", "o_orderstatus as publisher"),
            d.table(spark, sf, "customer").selectExpr(
                f"{_ID} as journalid", "case when c_custkey%2=0 then c_name end as publisher", "c_mktsegment as area")),
        f"select {_ID} as journalid, o_orderkey, coalesce(case when c_custkey%2=0 then c_name end, o_orderstatus) as publisher, "
        "c_mktsegment as area from orders join customer on o_custkey=c_custkey"),
    "upsert_results": (
        lambda spark, sf: ledger.upsert_results(results(spark, sf, "F", "P"), results(spark, sf, "O")),
        """select 'journal' as type, 'x' as domain, cast(o_custkey as string) as abbr, price, ts from (
            select o_custkey, o_totalprice as price, o_orderkey as ts, row_number() over (partition by o_custkey
              order by case o_orderstatus when 'O' then 0 else 1 end, o_orderkey desc) as rn
            from orders) where rn=1"""),
}


def _keyed(spark, sf):
    from parity.ingest import keyed_documents
    return keyed_documents(spark, sf)
