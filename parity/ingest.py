"""Cleaning, reading and combining."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import derived as d
from parity.pages import strip_sql
from venuedir import schema
from venuedir.functions import clean, tags, text, zones
from venuedir.session import shared_dir
from venuedir.sources import catalogue, records

# --- journal documents: one JSON text per part, with the dirt real imports carry ---

_K, _S = "cast(p_partkey as string)", "cast(p_size as string)"
JOURNAL_JSON = "concat(" + ", ".join([
    "'{\"ccfDomain\":\"', p_type, '\",\"ccfLevel\":\"A\",\"ccfAbbr\":\"J', " + _K + ", '\",\"ccfFull\":\"', p_name, '\"'",
    "',\"publisher\":\"', case when p_partkey%4=0 then '-' when p_partkey%4=1 then '' else p_brand end, '\"'",
    "',\"issn\":\"', lpad(" + _K + ", 8, '0'), '\",\"wosZone\":\"', cast(p_partkey%4+1 as string), '区\"'",
    "',\"impactFactor\":', case when p_partkey%5=0 then '\"-\"' when p_partkey%5=1 then concat('\"', " + _S + ", '.5abc\"')"
    " when p_partkey%5=2 then '\"n/a\"' when p_partkey%5=3 then concat(" + _S + ", '.25') else 'null' end",
    "',\"hIndex\":', case when p_partkey%3=0 then concat(" + _S + ", '.9') when p_partkey%3=1 then concat('\" ', " + _S
    + ", 'abc\"') else '\"abc\"' end",
    "',\"cas2025\":', case when p_partkey%6=0 then '{}' when p_partkey%6=1 then '\"\"' when p_partkey%6=2 then 'null'"
    " else concat('{\"isTop\":', case when p_partkey%2=0 then 'true' else 'false' end, ',\"bigZone\":\"', cast(p_partkey%4+1 as string), '区\"}') end",
    "',\"jif\":', case when p_partkey%6=0 then '[]' else concat('[{\"subject\":\"', p_type, '\",\"rank\":\"1/9\"}]') end",
    "case when p_partkey%41=17 then ',\"broken\"' else '' end",
    "'}'"]) + ")"


def journal_documents(spark, sf):
    return d.table(spark, sf, "part").selectExpr(f"{JOURNAL_JSON} as value")


def parsed_journals(spark, sf):
    return records.parse_records(journal_documents(spark, sf), schema.JOURNAL_IMPORT,
                                 ["ccfAbbr", "ccfFull"])


def conference_records(spark, sf):
    return d.table(spark, sf, "supplier").selectExpr(
        "concat('D', cast(s_nationkey as string)) as domain", "'B' as level",
        "concat('S', cast(s_suppkey as string)) as abbr", "s_name as full",
        "cast(null as string) as publisher", "'' as url")


def domain_documents(spark, sf):
    """``{domain: [record]}`` documents of at most a hundred parts each."""
    part = d.table(spark, sf, "part").selectExpr(
        "p_type as domain", "p_partkey div 100 as chunk",
        "named_struct('abbr', p_brand, 'full', p_name, 'level', 'A', 'publisher', 'P', "
        "'url', cast(p_partkey as string)) as r")
    lists = part.groupBy("domain", "chunk").agg(F.collect_list("r").alias("rs"))
    return lists.select(F.to_json(F.create_map("domain", "rs")).alias("value"))


def keyed_documents(spark, sf):
    """``{abbr: {issn}}`` documents, one per supplier."""
    return d.table(spark, sf, "supplier").selectExpr(
        "concat('{\"S', cast(s_suppkey as string), '\":{\"issn\":\"', lpad(cast(s_suppkey as string), 8, '0'), '\"}}') as value")


def cut_documents(documents, cut):
    """The same texts, some of them without their last character."""
    return documents.selectExpr(f"case when {cut} then left(value, length(value) - 1) else value end as value")


def combined_documents(spark, sf):
    """``{journals: [], conferences: []}`` documents, one per part; every seventh is cut off."""
    documents = d.table(spark, sf, "part").selectExpr(
        "p_partkey", "to_json(named_struct('journals', array(named_struct('ccfAbbr', p_brand, 'ccfFull', p_name)), "
        "'conferences', array(named_struct('abbr', p_type, 'full', cast(p_partkey as string))))) as value")
    return cut_documents(documents, "p_partkey % 7 = 3")


def imported_documents(spark, sf):
    journals, conferences, rejected = records.import_records(combined_documents(spark, sf))
    return (journals.selectExpr("'journal' as kind", "ccfAbbr as abbr", "ccfFull as full")
            .unionByName(conferences.selectExpr("'conference' as kind", "abbr", "full"))
            .unionByName(rejected.selectExpr("'rejected' as kind", "reject_reason as abbr", "cast(null as string) as full")))


def flat_entries(rows):
    return rows.select(
        "type", "ccf_domain", "ccf_level", "ccf_abbr", "ccf_full", "ccf_publisher", "publisher", "issn",
        "impact_factor", "h_index", "wos_zone", F.col("cas2025").isNotNull().alias("has_cas"),
        F.col("cas2025.bigZone").alias("cas_zone"), F.col("cas2025.isTop").alias("cas_top"),
        F.when(F.col("jif").isNotNull(), F.size("jif")).alias("n_jif"),
        F.get(F.col("jif"), 0)["subject"].alias("jif_subject"))


JOURNALS_SQL = f"""select 'journal' as type, p_type as ccf_domain, 'A' as ccf_level, concat('J', {_K}) as ccf_abbr,
  p_name as ccf_full, '' as ccf_publisher, case when p_partkey%4>1 then p_brand end as publisher,
  lpad({_K}, 8, '0') as issn, case p_partkey%5 when 1 then p_size+0.5::double when 3 then p_size+0.25::double end as impact_factor,
  case when p_partkey%3<2 then p_size end as h_index, concat(cast(p_partkey%4+1 as string), '区') as wos_zone,
  p_partkey%6 not in (1, 2) as has_cas, case when p_partkey%6>2 then concat(cast(p_partkey%4+1 as string), '区') end as cas_zone,
  case when p_partkey%6>2 then p_partkey%2=0 end as cas_top, case when p_partkey%6=0 then 0 else 1 end as n_jif,
  case when p_partkey%6<>0 then p_type end as jif_subject from part where p_partkey%41<>17"""
CONFERENCES_SQL = """select 'conference', concat('D', cast(s_nationkey as string)), 'B', concat('S', cast(s_suppkey as string)),
  s_name, '', null, null, null, null, null, false, null, null, null, null from supplier"""

# One value as number, as string and as something else, so that only its JSON type tells what it means.
TYPED_JSON = ("concat('{\"ccfAbbr\":\"', " + _K + ", '\",\"ccfFull\":\"f\",\"hIndex\":', v, ',\"impactFactor\":', v, '}')")
TYPED_VALUES = ("case p_partkey%8 when 0 then '1e7' when 1 then '\"1e7\"' when 2 then '\"1.0E7\"' when 3 then '1e20' when 4 then concat("
                + _S + ", '.5') when 5 then 'true' when 6 then 'null' else concat('\" ', " + _S + ", 'abc\"') end")


def typed_numbers(spark, sf):
    documents = d.table(spark, sf, "part").selectExpr("*", f"{TYPED_VALUES} as v").selectExpr(f"{TYPED_JSON} as value")
    rows = catalogue.journal_rows(records.accepted(records.parse_records(documents, schema.JOURNAL_IMPORT)))
    return rows.select("ccf_abbr", "h_index", "impact_factor")


def counted_import(spark, sf):
    """Counts that the write observed beside those of the rows it stored."""
    accepted, rejected, counts = records.write_counted(parsed_journals(spark, sf), shared_dir(spark, "counted"))
    stored = (accepted.agg(F.lit(None).cast("string").alias("reject_reason"), F.count("*").alias("stored"))
              .unionByName(rejected.groupBy("reject_reason").agg(F.count("*").alias("stored"))))
    observed = F.lit(None).cast("long")
    for reason, n in counts.items():
        observed = F.when(F.col("reject_reason").eqNullSafe(F.lit(reason)), F.lit(n).cast("long")).otherwise(observed)
    return stored.withColumn("observed", observed)


def two_ages(spark, sf):
    """A catalogue whose even ids were written before the column ``letpub_score`` existed."""
    path, rows = shared_dir(spark, "two-ages"), d.entries(spark, sf)
    catalogue.write_entries(rows.where("id % 2 = 0").drop("letpub_score"), path)
    catalogue.write_entries(rows.where("id % 2 = 1"), path, mode="append")
    return catalogue.read_entries(spark, path, {"letpub_score": "-1.0D"})


# Dirty texts from real ones: a number, a label and a unit around document fields.
NUMBER_TEXTS = ("case doc_id%6 when 0 then cast(n_chars as string) when 1 then concat(cast(n_chars as string), '.5abc') "
                "when 2 then concat('  -', cast(n_chars as string), '.') when 3 then '-' when 4 then concat('n', cast(n_chars as string)) "
                "else concat('.', cast(n_chars as string), 'e1x') end")
DOUBLE_RE = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def number_texts(spark, sf):
    return d.table(spark, sf, "documents").selectExpr("doc_id", f"{NUMBER_TEXTS} as raw")


def _folded_words(spark, sf):
    docs = d.table(spark, sf, "documents")
    return docs.select("doc_id", text.fold_ascii(F.col("text")).alias("folded"),
                       text.contains_folded(F.col("text"), "ÉTION").alias("hit"))


QUERIES = {
    "import_journals": (
        lambda spark, sf: flat_entries(catalogue.import_catalogue(
            records.accepted(parsed_journals(spark, sf)), conference_records(spark, sf))),
        f"{JOURNALS_SQL} union all {CONFERENCES_SQL}"),
    "import_rejects": (
        lambda spark, sf: records.rejects(parsed_journals(spark, sf)),
        f"select {JOURNAL_JSON} as value, 'bad_json' as reject_reason from part where p_partkey%41=17"),
    "import_reject_counts": (
        lambda spark, sf: records.reject_counts(parsed_journals(spark, sf)),
        "select case when p_partkey%41=17 then 'bad_json' end as reject_reason, count(*) as n from part group by all"),
    "import_numbers": (
        typed_numbers,
        f"""select {_K} as ccf_abbr, case p_partkey%8 when 0 then 10000000 when 1 then 1 when 2 then 1 when 4 then p_size when 7 then p_size
            end as h_index, case when p_partkey%8<3 then 1e7 when p_partkey%8=3 then 1e20 when p_partkey%8=4 then p_size+0.5::double
            when p_partkey%8=7 then p_size::double end as impact_factor from part"""),
    "import_counts_observed": (
        counted_import,
        "select case when p_partkey%41=17 then 'bad_json' end as reject_reason, count(*) as stored, count(*) as observed from part group by all"),
    "ensure_columns_stored": (
        lambda spark, sf: two_ages(spark, sf).where("letpub_score < 5").select("id", "type", "letpub_score"),
        d.E_ + "select * from (select id, type, case when id%2=0 then -1.0::double else letpub_score end as letpub_score from entries) "
               "where letpub_score<5"),
    "flatten_catalogue": (
        lambda spark, sf: records.flatten_by_domain(domain_documents(spark, sf)),
        "select p_type as domain, p_brand as abbr, p_name as \"full\", 'A' as level, 'P' as publisher, "
        "cast(p_partkey as string) as url from part"),
    "import_document": (
        imported_documents,
        "select 'journal' as kind, p_brand as abbr, p_name as \"full\" from part where p_partkey%7<>3 "
        "union all select 'conference', p_type, cast(p_partkey as string) from part where p_partkey%7<>3 "
        "union all select 'rejected', 'bad_json', null from part where p_partkey%7=3"),
    "flatten_rejects": (
        lambda spark, sf: records.keyed_rejects(
            cut_documents(keyed_documents(spark, sf), "value like '%7\"}}'"), schema.OLDER_METRIC).drop("key"),
        "select concat('{\"S', cast(s_suppkey as string), '\":{\"issn\":\"', lpad(cast(s_suppkey as string), 8, '0'), '\"}') "
        "as value, 'bad_json' as reject_reason from supplier where s_suppkey%10=7"),
    "flatten_keyed": (
        lambda spark, sf: records.flatten_keyed(keyed_documents(spark, sf), schema.OLDER_METRIC),
        "select concat('S', cast(s_suppkey as string)) as abbr, lpad(cast(s_suppkey as string), 8, '0') as issn from supplier"),
    "combine_catalogue": (
        lambda spark, sf: catalogue.combine(
            d.table(spark, sf, "part").selectExpr("'journal' as type", "p_name as ccf_full", "p_size as h_index"),
            d.table(spark, sf, "nation").selectExpr("'conference' as type", "n_name as ccf_full")),
        "select 'journal' as type, p_name as ccf_full, p_size as h_index from part "
        "union all select 'conference', n_name, null from nation"),
    "surrogate_ids": (
        # the hash itself has no SQL counterpart: what is compared is that ids are
        # stable between loads and split no natural key
        lambda spark, sf: catalogue.with_ids(d.entries(spark, sf)).join(
            catalogue.with_ids(d.entries(spark, sf).repartition(3, "ccf_full")).select("id"), "id", "left_semi"
        ).groupBy("ccf_domain").agg(F.countDistinct("id").alias("ids")),
        d.E_ + "select ccf_domain, count(distinct (type, ccf_domain, ccf_abbr, ccf_full)) as ids from entries group by all"),
    "ensure_columns": (
        lambda spark, sf: catalogue.ensure_columns(
            d.table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("label")),
            {"label": F.lit("none"), "added": F.lit(0)}),
        "select n_nationkey, case when n_regionkey>1 then n_name else 'none' end as label, 0 as added from nation"),
    "clean_numbers": (
        lambda spark, sf: number_texts(spark, sf).select(
            "doc_id", clean.lenient_double(F.col("raw")).alias("x"), clean.lenient_int(F.col("raw")).alias("n")),
        f"select doc_id, try_cast(nullif(regexp_extract(raw, '{DOUBLE_RE}', 1), '') as double) as x, "
        r"try_cast(nullif(regexp_extract(raw, '^\s*([+-]?\d+)', 1), '') as int) as n "
        f"from (select doc_id, {NUMBER_TEXTS} as raw from documents)"),
    "truncated_numbers": (
        lambda spark, sf: d.table(spark, sf, "customer").select(
            "c_custkey", clean.truncated_int(F.col("c_acctbal")).alias("n")),
        "select c_custkey, cast(trunc(c_acctbal) as int) as n from customer"),
    "clean_sentinels": (
        lambda spark, sf: number_texts(spark, sf).select("doc_id", clean.null_sentinel(F.col("raw")).alias("v")),
        f"select doc_id, nullif({NUMBER_TEXTS}, '-') as v from documents"),
    "canonical_json": (
        lambda spark, sf: d.table(spark, sf, "events").select("event_id", clean.canonical_json(F.concat(
            F.lit('{"z": '), F.col("props"), F.lit(' , "a":"'), F.col("event_type"), F.lit('"}'))).alias("j")),
        """select event_id, concat('{"a":"', event_type, '","z":', replace(props, ' ', ''), '}') as j from events"""),
    "normalize_names": (
        lambda spark, sf: d.table(spark, sf, "supplier").select(
            "s_suppkey", text.normalize_name(F.concat(F.col("s_name"), F.lit(" & Co. 期刊"))).alias("norm")),
        "select s_suppkey, regexp_replace(upper(concat(s_name, ' & Co.')), '[^A-Z0-9]', '', 'g') as norm from supplier"),
    "fold_and_search": (
        _folded_words,
        "select doc_id, translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') as folded, "
        "contains(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), 'Étion') as hit from documents"),
    "strip_documents": (
        lambda spark, sf: d.table(spark, sf, "documents").select("doc_id", text.strip_markup(F.col("text")).alias("body")),
        f"select doc_id, {strip_sql('text')} as body from documents"),
    "first_values": (
        lambda spark, sf: d.table(spark, sf, "documents").select(
            "doc_id", text.first_number(F.col("text")).alias("number"),
            text.first_percentage(F.concat(F.lit("about "), F.col("n_chars"), F.lit(".5% or 7%"))).alias("pct"),
            text.first_token(F.col("text")).alias("token")),
        r"select doc_id, regexp_extract(text, '[\d.]+', 0) as number, concat(cast(n_chars as string), '.5%') as pct, "
        r"regexp_extract(text, '^[^\s\v\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]*', 0) as token from documents"),
    "label_prefix": (
        lambda spark, sf: d.table(spark, sf, "nation").select("n_nationkey", text.drop_label(
            F.concat(F.lit("网友分享经验：　"), F.col("n_name"), F.lit(" 网友分享经验 ")), "网友分享经验").alias("v")),
        "select n_nationkey, concat(n_name, ' 网友分享经验') as v from nation"),
    "zone_labels": (
        lambda spark, sf: d.raw_entries(spark, sf).select(
            "id", zones.big_zone(F.col("cas2025")).alias("zone"), zones.top_flag(F.col("xinrui")).alias("top"),
            zones.zone_number(F.concat(F.lit("JCR"), F.col("wos_zone"))).alias("number"),
            zones.zone_label(F.concat(F.lit("中科院"), F.col("wos_zone"))).alias("label"),
            zones.is_top_venue(zones.decode_partition(F.col("cas2025")), zones.decode_partition(F.col("xinrui"))).alias("venue_top"),
            zones.index_category(F.coalesce("sci_type", F.lit("")), F.col("ccf_full")).alias("category")),
        d.E_ + """select id, coalesce(json_extract_string(cas2025,'$.bigZone'),'') as zone,
            coalesce(json_extract_string(xinrui,'$.isTop'),'false')='true' as top,
            case when wos_zone is not null then wos_zone[1:1] end as number, wos_zone as label,
            coalesce(json_extract_string(cas2025,'$.isTop'),'false')='true'
              or coalesce(json_extract_string(xinrui,'$.isTop'),'false')='true' as venue_top,
            coalesce(sci_type,'') as category from entries"""),
    "tag_arrays": (
        lambda spark, sf: d.operations(spark, sf).select(
            "event_id", F.array_join(tags.toggled_tag(F.col("tags"), "T1"), ",").alias("toggled"),
            F.array_join(tags.without_tag(F.col("tags"), "t2"), ",").alias("without"),
            tags.has_tag(F.col("tags"), "T2").alias("has")),
        d.with_ctes(d.OPS_CTE) + """select event_id,
            array_to_string(case when list_contains(l,'T1') then list_filter(l, lambda t: t<>'T1') else list_append(l,'T1') end, ',') as toggled,
            array_to_string(list_filter(l, lambda t: t<>'t2'), ',') as without,
            len(list_filter(l, lambda t: lower(t)='t2'))>0 as has
          from (select event_id, cast(from_json(tags,'["VARCHAR"]') as varchar[]) as l from ops)"""),
    "split_items": (
        lambda spark, sf: d.table(spark, sf, "nation").select("n_nationkey", F.array_join(clean.split_items(
            F.concat(F.lit(" , "), F.col("n_name"), F.lit(" ,, B "))), "|").alias("items"),
            clean.split_items(F.lit(" , ")).isNull().alias("none")),
        "select n_nationkey, concat(n_name, '|B') as items, true as none from nation"),
    "record_constraints": (
        lambda spark, sf: d.table(spark, sf, "customer").select(
            "c_custkey", clean.valid_entry_id(F.col("c_custkey")).alias("id_ok"),
            clean.valid_tag_name(F.concat(F.col("c_name"), F.col("c_mktsegment"))).alias("tag_ok"),
            clean.valid_username(F.col("c_mktsegment")).alias("user_ok")),
        "select c_custkey, c_custkey>=1 as id_ok, length(c_name)+length(c_mktsegment) between 1 and 20 as tag_ok, "
        "length(c_mktsegment) between 3 and 32 as user_ok from customer"),
    "fixed_decimals": (
        lambda spark, sf: d.table(spark, sf, "customer").select(
            "c_custkey", clean.fixed_decimals(F.col("c_acctbal") / 8, 2).alias("two"),
            clean.fixed_decimals(F.col("c_acctbal"), 1).alias("one")),
        # an exact tie is nudged outwards, since C rounds it to even
        "select c_custkey, printf('%.2f', x + case when x*8=floor(x*8) then sign(x)*1e-9 else 0 end) as two, "
        "printf('%.1f', c_acctbal + case when c_acctbal*4=floor(c_acctbal*4) then sign(c_acctbal)*1e-9 else 0 end) as one "
        "from (select *, c_acctbal/8 as x from customer)"),
}
