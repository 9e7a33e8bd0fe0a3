"""Every query of the record-resolution part by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import barcode as B
from matchloom.functions import text as T
from matchloom.functions.similarity import metaphone_code, token_sort_ratio
from matchloom.operators import agreement as A
from matchloom.operators import calibration as C
from matchloom.operators import decisions as D
from matchloom.operators import evaluation as E
from matchloom.operators import retrieval as V
from matchloom.operators import routing as R
from matchloom.operators import state as S
from matchloom.plans.fixtures import SQL_CATALOG, SQL_EVENTS, catalog, events, sql_gtin14, sql_make_gtin, sql_normalize_quantity, sql_normalize_text, sql_ratio, sql_tokens, sql_valid13, sql_valid_gtin, table
from matchloom.sources import records as IO

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Scalars


@query(f"with {SQL_EVENTS} select event_id, {sql_normalize_text('supplier_brand')} as norm_brand, {sql_normalize_text('supplier_name')} as norm_name from events0")
def q_normalize_text(spark, sf):
    return events(spark, sf).select("event_id", T.normalize_text("supplier_brand").alias("norm_brand"), T.normalize_text("supplier_name").alias("norm_name"))


@query(f"with {SQL_EVENTS} select event_id, {sql_normalize_quantity('supplier_quantity')} as supplier, {sql_normalize_quantity('artwork_quantity')} as artwork, {sql_normalize_quantity('master_quantity')} as master from events0")
def q_normalize_quantity(spark, sf):
    return events(spark, sf).select("event_id", *(T.normalize_quantity(f"{s}_quantity").alias(s) for s in ("supplier", "artwork", "master")))


@query(f"with {SQL_CATALOG} select brand, count(*) as n, sum(case when {sql_valid13('gtin')} then 1 else 0 end)::bigint as valid, count(distinct gtin) as codes, sum(case when {sql_valid13('substr(gtin, 1, 12)')} then 1 else 0 end)::bigint as cut_valid from catalog group by brand")
def q_gtin_build_validate(spark, sf):
    valid = lambda c: F.sum(B.is_valid_ean13(c).cast("long"))
    return catalog(spark, sf).groupBy("brand").agg(F.count("*").alias("n"), valid("gtin").alias("valid"), F.countDistinct("gtin").alias("codes"), valid(F.substring("gtin", 1, 12)).alias("cut_valid"))


_FORMAT = "case when not regexp_full_match({0}, '[0-9]+') then 'non_numeric' when length({0}) = 8 then 'ean8' when length({0}) = 12 then 'upc12' when length({0}) = 13 then 'ean13' when length({0}) = 14 then 'gtin14' else 'len' || length({0}) end"
_STATUS = f"case when not regexp_full_match(supplier_gtin, '[0-9]+') then 'non_numeric' when length(supplier_gtin) = 13 then case when {sql_valid13('supplier_gtin')} then 'ean13' else 'ean13_bad_check' end when length(supplier_gtin) = 12 then 'upc12' when length(supplier_gtin) = 8 then 'ean8' else 'other_length' end"


@query(f"with {SQL_EVENTS} select {_FORMAT.format('artwork_gtin')} as format, count(*) as n from events0 group by 1")
def q_gtin_format(spark, sf):
    return events(spark, sf).groupBy(B.gtin_format("artwork_gtin").alias("format")).agg(F.count("*").alias("n"))


@query(f"with {SQL_EVENTS} select {_STATUS} as status, count(*) as n from events0 group by 1")
def q_barcode_status(spark, sf):
    return events(spark, sf).groupBy(B.barcode_status("supplier_gtin").alias("status")).agg(F.count("*").alias("n"))


@query(f"with {SQL_EVENTS} select event_id, {sql_gtin14('artwork_gtin')} as padded, {sql_valid_gtin('artwork_gtin')} as ok, {sql_valid_gtin(sql_gtin14('supplier_gtin'))} as padded_ok from events0")
def q_gtin14(spark, sf):
    return events(spark, sf).select("event_id", B.gtin14("artwork_gtin").alias("padded"), B.is_valid_gtin("artwork_gtin").alias("ok"), B.is_valid_gtin(B.gtin14("supplier_gtin")).alias("padded_ok"))


def _label(e: DataFrame) -> DataFrame:
    body = F.concat_ws("\n", F.upper("master_brand"), "master_name", F.concat(F.lit("Net Weight "), "master_quantity"), F.concat(F.substring("artwork_gtin", 1, 4), F.lit(" "), F.substring("artwork_gtin", 5, 13)))
    return e.select("event_id", body.alias("scan"))


_SCAN = "events1 as (select event_id, artwork_gtin, upper(master_brand) as b, master_name as m, upper('Net Weight ' || master_quantity) as w, regexp_replace(artwork_gtin, ' ', '', 'g') as g from events0)"


@query(f"with {SQL_EVENTS}, {_SCAN} select event_id, trim(b) as brand, trim(m) as product_name, trim(replace(w, 'NET WEIGHT', '')) as quantity, case when length(g) in (12, 13) then g else '' end as gtin from events1")
def q_ocr_fields(spark, sf):
    return _label(events(spark, sf)).select("event_id", B.extract_fields("scan").alias("f")).select("event_id", "f.*")


@query(f"with {SQL_EVENTS} select event_id, case when {sql_valid13('supplier_gtin')} then supplier_gtin when {sql_valid13('artwork_gtin')} then artwork_gtin when length(supplier_gtin) = 13 then supplier_gtin when length(artwork_gtin) = 13 then artwork_gtin when length(supplier_gtin) = 12 then supplier_gtin when length(artwork_gtin) = 12 then artwork_gtin else '' end as picked from events0")
def q_pick_barcode(spark, sf):
    return events(spark, sf).select("event_id", B.pick_barcode(F.concat("supplier_gtin", F.lit("\n"), "artwork_gtin")).alias("picked"))


@query(f"with {SQL_CATALOG} select source, lang, sum(case when contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'apache') then 1 else 0 end)::bigint as found, sum(case when contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'mit') and false then 1 else 0 end)::bigint as too_short from documents group by source, lang")
def q_found_in(spark, sf):
    n = lambda brand: F.sum(T.found_in(F.lit(brand), "text").cast("long"))
    return table(spark, sf, "documents").groupBy("source", "lang").agg(n("Apache").alias("found"), n("MIT").alias("too_short"))


@query(f"with {SQL_EVENTS} select event_id, case when supplier_gtin = '' then 0.0::double when supplier_gtin = master_gtin then 1.0::double when {sql_valid13('supplier_gtin')} then 0.0::double else greatest(0.0::double, 0.5 * (1 - levenshtein(supplier_gtin, master_gtin) / 3.0::double)) end as similarity from events0")
def q_gtin_similarity(spark, sf):
    return events(spark, sf).select("event_id", B.gtin_similarity("supplier_gtin", "master_gtin").alias("similarity"))


@query(f"with {SQL_EVENTS}, t as (select event_id, {sql_tokens('supplier_name')} as x, {sql_tokens('master_name')} as y from events0) select event_id, round({sql_ratio('x', 'y')}, 9) as ratio from t")
def q_token_sort_ratio(spark, sf):
    return events(spark, sf).select("event_id", F.round(token_sort_ratio("supplier_name", "master_name"), 9).alias("ratio"))


#: Fixed value: the tables' brands are one word and a number, so all sound alike, and those with a second word don't.
_SOUNDS = "supplier_brand not like '% Ltd.'"


@query(f"with {SQL_EVENTS}, b as (select distinct brand from catalog) select brand, count(*) as fired, sum((brand <> master_brand)::int)::bigint as wrong from events0 join b on {_SOUNDS} group by brand")
def q_phonetic_join(spark, sf):
    """Supplier brands that sound like a catalogue brand, and how many are of another brand."""
    e, c = events(spark, sf), catalog(spark, sf)
    asked = e.groupBy("supplier_brand", "master_brand").agg(F.count("*").alias("n")).withColumn("code", metaphone_code("supplier_brand"))
    brands = c.select("brand").distinct().withColumn("code", metaphone_code("brand"))
    return asked.join(brands, "code").groupBy("brand").agg(F.sum("n").alias("fired"), F.sum(F.when(F.col("master_brand") != F.col("brand"), F.col("n")).otherwise(0)).alias("wrong"))


@query(f"with {SQL_EVENTS} select event_id, supplier_name, supplier_quantity, supplier_gtin from events0")
def q_corrupt_feed(spark, sf):
    return events(spark, sf).select("event_id", "supplier_name", "supplier_quantity", "supplier_gtin")


@query(f"with {SQL_EVENTS} select regexp_replace(lower(supplier_brand || ' ' || supplier_name), '\\s+', ' ', 'g') as alias_key, count(*) as n from events0 group by 1")
def q_alias_key(spark, sf):
    return events(spark, sf).groupBy(T.alias_key("supplier_brand", "supplier_name").alias("alias_key")).agg(F.count("*").alias("n"))


# Agreement and barcodes

_NORM = f"""{SQL_EVENTS}, norm as (select *, {sql_normalize_text('artwork_brand')} as ab, {sql_normalize_text('supplier_brand')} as sb, {sql_normalize_text('master_brand')} as mb,
  {sql_normalize_quantity('artwork_quantity')} as aq, {sql_normalize_quantity('supplier_quantity')} as sq, {sql_normalize_quantity('master_quantity')} as mq from events0),
flags as (select *, (ab <> '' and ab = sb) as b1, (ab <> '' and ab = mb) as b2, (sb <> '' and sb = mb) as b3, (aq <> '' and aq = sq) as q1, (aq <> '' and aq = mq) as q2, (sq <> '' and sq = mq) as q3,
  (artwork_gtin <> '' and artwork_gtin = supplier_gtin) as g1, (artwork_gtin <> '' and artwork_gtin = master_gtin) as g2, (supplier_gtin <> '' and supplier_gtin = master_gtin) as g3 from norm),
checks as (select *, (b1 and b2 and b3)::int + (q1 and q2 and q3)::int + (g1 and g2 and g3)::int as full_n, 3 - b2::int - q2::int - g2::int as aw, 3 - b3::int - q3::int - g3::int as sw from flags)"""
_CHECK_STATUS = "case full_n when 3 then 'full_agreement' when 0 then 'disagreement' else 'partial_agreement' end"


@query(
    f"with {_NORM} select event_id, true_master_id, b1 as brand_artwork_vs_supplier, b2 as brand_artwork_vs_master, b3 as brand_supplier_vs_master, q1 as quantity_artwork_vs_supplier, q2 as quantity_artwork_vs_master, q3 as quantity_supplier_vs_master, g1 as gtin_artwork_vs_supplier, g2 as gtin_artwork_vs_master, g3 as gtin_supplier_vs_master, (b1 and b2 and b3) as brand_all_agree, (q1 and q2 and q3) as quantity_all_agree, (g1 and g2 and g3) as gtin_all_agree, full_n as fields_fully_agreed, 3::int as fields_compared, round(full_n / 3.0::double, 2) as agreement_score, {_CHECK_STATUS} as cross_check_status, aw::int as artwork_fields_wrong_vs_master, sw::int as supplier_fields_wrong_vs_master from checks"
)
def q_cross_check(spark, sf):
    return A.cross_check(events(spark, sf))


@query(f"with {_NORM} select {_CHECK_STATUS} as cross_check_status, count(*) as n, round(avg(aw), 9) as artwork_wrong, round(avg(sw), 9) as supplier_wrong from checks group by 1")
def q_cross_check_summary(spark, sf):
    mean = lambda c: F.round(F.avg(c), 9)
    return A.cross_check(events(spark, sf)).groupBy("cross_check_status").agg(F.count("*").alias("n"), mean("artwork_fields_wrong_vs_master").alias("artwork_wrong"), mean("supplier_fields_wrong_vs_master").alias("supplier_wrong"))


_THREE = f"""{SQL_EVENTS}, codes as (select event_id, artwork_gtin as a, supplier_gtin as s, master_gtin as m, {sql_valid_gtin('artwork_gtin')} as av, {sql_valid_gtin('supplier_gtin')} as sv, {sql_valid_gtin('master_gtin')} as mv,
  {sql_gtin14('artwork_gtin')} as af, {sql_gtin14('supplier_gtin')} as sfull, {sql_gtin14('master_gtin')} as mf from events0),
three as (select *, av::int + sv::int + mv::int as n, coalesce((av and sv and af = sfull), false) as eas, coalesce((av and mv and af = mf), false) as eam, coalesce((sv and mv and sfull = mf), false) as esm from codes),
verdicts as (select *, case when n < 2 then 'insufficient_data' when n = 3 and eas and eam then 'all_three_agree' when eas or eam or esm then 'two_of_three' else 'full_mismatch' end as verdict from three)"""


@query(
    f"with {_THREE} select event_id, verdict, case verdict when 'all_three_agree' then 1.0::double when 'two_of_three' then 0.65::double else 0.0::double end as score, case when n < 2 then '' else concat_ws('|', case when eas or eam then 'artwork' end, case when eam or esm then 'master' end, case when eas or esm then 'supplier' end) end as agreeing, concat_ws('|', case when a <> '' and not av then 'artwork' end, case when m <> '' and not mv then 'master' end, case when s <> '' and not sv then 'supplier' end) as corrupt from verdicts"
)
def q_barcode_three_way(spark, sf):
    checked = events(spark, sf).select("event_id", A.verify_three_way("artwork_gtin", "supplier_gtin", "master_gtin").alias("b"))
    return checked.select("event_id", "b.verdict", "b.score", F.array_join("b.agreeing", "|").alias("agreeing"), F.array_join("b.corrupt_sources", "|").alias("corrupt"))


# Routing: scores by a rule of the event's number, so that every band is reached

_TOP, _NEXT = "0.5 + (true_master_id % 50) / 100.0::double", "(true_master_id % 37) / 40.0::double"
_ROUTED = f"""{_NORM}, {_THREE.split(SQL_EVENTS + ', ', 1)[1]}, sig as (select c.event_id, (b1::int + q1::int + g1::int) / 3.0::double as agreement, (artwork_brand <> '' or artwork_name <> '' or artwork_gtin <> '') as second, {_TOP} as top, {_NEXT} as nxt, v.verdict, case v.verdict when 'all_three_agree' then 1.0::double when 'two_of_three' then 0.65::double else 0.0::double end as score,
  av and sv and not eas as conflict0, true_master_id % 23 = 0 as alias_hit from checks c join verdicts v using (event_id)),
parts as (select *, least(1.0::double, greatest(0.0::double, top - nxt) / 0.40::double) as text, verdict <> 'insufficient_data' as coded, conflict0 and agreement < 1 as conflict from sig),
means as (select *, (0.35::double * text + case when second then 0.25::double * agreement else 0.0::double end + case when coded then 0.40::double * score else 0.0::double end) / (0.35::double + case when second then 0.25::double else 0.0::double end + case when coded then 0.40::double else 0.0::double end) as mean from parts),
finals as (select *, least(case when alias_hit then least(1.0::double, mean + 0.10::double) else mean end, case when (not second and not coded) or conflict then 0.90::double - 1e-9::double else 1.0::double end, case when verdict = 'full_mismatch' or top - nxt <= 0.08::double then 0.60::double else 1.0::double end) as confidence from means),
routed as (select *, case when confidence >= 0.90::double then 'auto_merge' when confidence >= 0.60::double then 'hold_for_review' else 'reject' end as route from finals)"""
_OVERRIDES = "concat_ws('|', case when not second or not coded then 'signals_unavailable:' || concat_ws(',', case when not coded then 'barcode' end, case when not second then 'source_agreement' end) end, case when alias_hit then 'alias_cache_hit' end, case when not second and not coded then 'single_signal_no_corroboration' end, case when verdict = 'full_mismatch' then 'barcode_three_way_mismatch' end, case when top - nxt <= 0.08::double then 'retrieval_ambiguous' end, case when conflict then 'artwork_supplier_barcode_conflict' end)"
_CLASS = "case when route = 'reject' then 'unresolved' when second and agreement < 1 and route = 'hold_for_review' then 'both' when second and agreement < 1 then 'supplier_data_entry_error' when route = 'hold_for_review' then 'resolution_ambiguity' else 'clean' end"


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    k = F.col("true_master_id")
    # Event ids have six digits, so beyond a million products some are shared: then what the cross-check goes by comes from its own side of the join, as in SQL.
    codes = e.select("event_id", "artwork_gtin", "supplier_gtin", "master_gtin")
    rows = A.cross_check(e.withColumn("second", A.second_source(e)), ("second",)).join(codes, "event_id").withColumn("agreement", A.source_agreement())
    rows = rows.withColumn("top", 0.5 + (k % 50) / 100.0).withColumn("nxt", (k % 37) / 40.0).withColumn("barcode", A.verify_three_way("artwork_gtin", "supplier_gtin", "master_gtin"))
    return rows.withColumn("d", R.route(F.col("agreement"), F.col("top"), F.col("nxt"), F.col("barcode"), F.col("second"), k % 23 == 0))


@query(f"with {_ROUTED} select event_id, round(text, 9) as text_match from routed")
def q_text_signal(spark, sf):
    return _routed(spark, sf).select("event_id", F.round("d.sig_text_match", 9).alias("text_match"))


@query(
    f"with {_ROUTED} select event_id, route, round(confidence, 9) as confidence, {_OVERRIDES} as overrides from routed"
)
def q_route(spark, sf):
    return _routed(spark, sf).select("event_id", "d.route", F.round("d.confidence", 9).alias("confidence"), F.array_join("d.overrides", "|").alias("overrides"))


@query(f"with {_ROUTED} select event_id, {_CLASS} as problem_class from routed")
def q_problem_class(spark, sf):
    return _routed(spark, sf).select("event_id", R.problem_class(F.col("agreement"), F.col("d.route"), F.col("second")).alias("problem_class"))


@query(f"with {_ROUTED} select route, {_CLASS} as problem_class, count(*) as n, round(avg(confidence), 6) as confidence from routed group by 1, 2")
def q_pipeline_summary(spark, sf):
    rows = _routed(spark, sf).select("d.route", R.problem_class(F.col("agreement"), F.col("d.route"), F.col("second")).alias("problem_class"), "d.confidence")
    return rows.groupBy("route", "problem_class").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


# Ambiguity

_RANKED = f"{SQL_EVENTS}, ranked as (select event_id, true_master_id as k, true_master_id % 29 = 0 as conflict, true_master_id as s1, true_master_id + 1 as s2, 0.9::double as p1, 0.9::double - (true_master_id % 20) / 100.0::double as p2, case when true_master_id % 6 = 0 then true_master_id + 2 else true_master_id end as a1, 0.8::double as r1, 0.8::double - (true_master_id % 13) / 60.0::double as r2 from events0)"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("true_master_id")
    pick = lambda i, s: F.struct(i.cast("long").alias("master_id"), s.cast("double").alias("score"))
    supplier = F.array(pick(k, F.lit(0.9)), pick(k + 1, 0.9 - (k % 20) / 100.0))
    artwork = F.array(pick(F.when(k % 6 == 0, k + 2).otherwise(k), F.lit(0.8)), pick(k + 3, 0.8 - (k % 13) / 60.0))
    return events(spark, sf).select("event_id", k.alias("k"), (k % 29 == 0).alias("conflict"), supplier.alias("supplier"), artwork.alias("artwork"))


@query(
    f"with {_RANKED} select event_id, (conflict or s1 <> a1 or p1 - p2 < 0.08::double or r1 - r2 < 0.08::double) as invoke, case when conflict then 'conflict' when s1 <> a1 then 'ids' when p1 - p2 < 0.08::double then 'supplier' when r1 - r2 < 0.08::double then 'artwork' else 'none' end as why from ranked"
)
def q_needs_disambiguation(spark, sf):
    rows = _ranked(spark, sf).select("event_id", R.needs_disambiguation(F.col("conflict"), F.col("supplier"), F.col("artwork")).alias("n"))
    reason = F.col("n.reason")
    why = F.when(reason.startswith("code and"), "conflict").when(reason.startswith("best record"), "ids").when(reason.startswith("supplier:"), "supplier").when(reason.startswith("artwork:"), "artwork").otherwise("none")
    return rows.select("event_id", "n.invoke", why.alias("why"))


@query(f"with {_RANKED} select event_id, array_to_string(case when a1 = s1 then [s1, s2, k + 3] else [s1, s2, a1, k + 3] end, ',') as ids from ranked")
def q_shortlist(spark, sf):
    return _ranked(spark, sf).select("event_id", F.array_join(R.shortlist(F.col("supplier"), F.col("artwork")), ",").alias("ids"))


@query(f"with {_RANKED} select event_id, case when k % 4 <> 3 then k + k % 4 end as master_id, case when k % 4 <> 3 or k % 4 = 3 and false then least((k % 100) / 100.0::double, 0.75::double) else 0.0::double end as confidence, (k % 4 <> 3 and (k % 100) / 100.0::double > 0.75::double) as capped from (select * from ranked where true) x")
def q_llm_guardrail(spark, sf):
    k = F.col("k")
    rows = _ranked(spark, sf).withColumn("list", F.array(k, k + 1, k + 2))
    answer = R.llm_guardrail(F.col("list"), k + k % 4, (k % 100) / 100.0)
    return rows.select("event_id", answer.alias("a")).select("event_id", "a.master_id", "a.confidence", "a.capped")


# Retrieval: queries are the rows whose id is divisible by 100, against all

_ASKED = 100


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter(F.col("true_master_id") % _ASKED == 0).select(F.col("true_master_id").alias("query_id"), F.col("supplier_brand").alias("brand"), F.col("supplier_name").alias("name"), F.col("supplier_gtin").alias("gtin"))


_TFIDF = f"""{SQL_EVENTS}, texts as (select master_id, lower(trim(brand || ' ' || product_name)) as text from catalog),
asked as (select true_master_id as query_id, lower(trim(supplier_brand || ' ' || supplier_name)) as text from events0 where true_master_id % 100 = 0),
alltexts as (select distinct text from texts union select distinct text from asked),
words as (select text, ' ' || unnest(string_split_regex(text, '\\s+')) || ' ' as w from alltexts),
grams as (select text, unnest(flatten(list_transform(range(2, least(4, length(w)) + 1), lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))))) as gram from words),
counts as (select text, gram, count(*) as n from grams group by 1, 2),
copies as (select text, count(*) as c from texts group by 1),
idf as (select gram, ln((1 + (select count(*) from texts)) / (1.0::double + sum(c))) + 1 as idf from counts join copies using (text) group by 1),
raw as (select text, gram, (1 + ln(n)) * idf as w from counts join idf using (gram)),
norms as (select text, sqrt(sum(w * w)) as norm from raw group by 1),
vectors as (select text, gram, w / norm as weight from raw join norms using (text))"""


@query(f"with {_TFIDF} select gram, count(*) as texts, round(sum(weight), 6) as total, round(max(idf), 9) as idf from vectors join copies using (text) join idf using (gram) group by gram")
def q_tfidf_vectors(spark, sf):
    index = V.TfidfIndex(catalog(spark, sf), "master_id", V.blob("brand", "product_name"))
    return index.postings.join(index.idf, "gram").groupBy("gram").agg(F.count("*").alias("texts"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("idf"), 9).alias("idf"))


@query(
    f"with {_TFIDF}, pairs as (select a.text as q, b.text as t, sum(a.weight * b.weight) as sim from vectors a join vectors b using (gram) where a.text in (select text from asked) and b.text in (select text from texts) group by 1, 2), best as (select query_id, master_id as candidate_id, sim, row_number() over (partition by query_id order by round(sim, 9) desc, master_id) as rank from asked join pairs on asked.text = q join texts on texts.text = t) select query_id, candidate_id, round(sim, 6) as similarity, rank::int as rank from best where rank <= 50"
)
def q_tfidf_topk(spark, sf):
    index = V.TfidfIndex(catalog(spark, sf), "master_id", V.blob("brand", "product_name"))
    found = V.tfidf_neighbours(index, _asked(spark, sf), "query_id", V.blob("brand", "name"), 50)
    return found.filter("similarity > 0").select("query_id", "candidate_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v), p as (select q.vec_id as query_id, c.vec_id as candidate_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) as s from n q join n c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id), r as (select *, row_number() over (partition by query_id order by round(s, 9) desc, candidate_id) as rank from p) select query_id, candidate_id, round(s, 6) as similarity, rank::int as rank from r where rank <= 10"
)
def q_embedding_knn(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = V.cosine_neighbours(rows, rows.filter(F.col("vec_id") % _ASKED == 0), 10)
    return found.select("query_id", "candidate_id", F.round("similarity", 6).alias("similarity"), "rank")


_STAGE04 = f"""{_TFIDF}, sims as (select a.text as q, b.text as t, sum(a.weight * b.weight) as sim from vectors a join vectors b using (gram) where a.text in (select text from asked) and b.text in (select text from texts) group by 1, 2),
pairs as (select e.true_master_id as query_id, c.master_id, coalesce(sim, 0.0::double) as vector, case when {_SOUNDS} then 1.0::double else 0.0::double end as phonetic, {sql_tokens("supplier_brand || ' ' || supplier_name")} as x, {sql_tokens("brand || ' ' || product_name")} as y,
  case when supplier_gtin = '' then 0.0::double when supplier_gtin = c.gtin then 1.0::double when {sql_valid13('supplier_gtin')} then 0.0::double else greatest(0.0::double, 0.5 * (1 - levenshtein(supplier_gtin, c.gtin) / 3.0::double)) end as barcode
  from events0 e join asked a on a.query_id = e.true_master_id cross join catalog c join texts t on t.master_id = c.master_id left join sims on q = a.text and sims.t = t.text),
cheap as (select *, 0.15::double * phonetic + 0.35::double * vector + 0.30::double * barcode as part from pairs),
able as (select *, nth_value(part, 3) over (partition by query_id order by part desc rows between unbounded preceding and unbounded following) as third from cheap),
scored as (select *, {sql_ratio('x', 'y')} as text from able where third is null or part + 0.2::double + 1e-9::double >= third),
combined as (select *, 0.20::double * text + 0.15::double * phonetic + 0.35::double * vector + 0.30::double * barcode as combined from scored),
ranked as (select *, row_number() over (partition by query_id order by round(combined, 9) desc, master_id) as rank from combined)"""


@query(f"with {_STAGE04} select query_id, rank::int as rank, master_id, round(combined, 9) as combined, round(text, 9) as text, phonetic, round(vector, 9) as vector, round(barcode, 9) as barcode from ranked where rank <= 3")
def q_stage04_topk(spark, sf):
    ranked = V.rank_candidates(_asked(spark, sf), catalog(spark, sf))
    return ranked.select("query_id", "rank", "master_id", *(F.round(c, 9).alias(c) for c in ("combined", "text", "phonetic", "vector", "barcode")))


@query(f"with {_STAGE04} select query_id, max(case when rank = 1 then master_id end) as top_id, round(max(case when rank = 1 then combined end), 9) as top_score, round(max(case when rank = 1 then combined end) - coalesce(max(case when rank = 2 then combined end), 0.0::double), 9) as margin from ranked where rank <= 2 group by query_id")
def q_margin(spark, sf):
    m = V.margins(V.rank_candidates(_asked(spark, sf), catalog(spark, sf)))
    return m.select("query_id", "top_id", F.round("top_score", 9).alias("top_score"), F.round(F.col("top_score") - F.col("runner_up_score"), 9).alias("margin"))


@query(
    f"with {SQL_EVENTS}, owners as (select gtin, min(master_id) as gtin_pick from catalog group by gtin), texts as (select {sql_tokens("brand || ' ' || product_name")} as y, lower(brand || ' ' || product_name) as raw, max(master_id) as id from catalog group by all), asked as (select true_master_id as query_id, gtin_pick, {sql_tokens("supplier_brand || ' ' || supplier_name")} as x from events0 join owners on gtin = supplier_gtin where true_master_id % 100 = 0 and {sql_valid13('supplier_gtin')}), r as (select query_id, gtin_pick, id, {sql_ratio('x', 'y')} as text from asked, texts where 2.0 * least(length(x), length(y)) >= 0.85 * (length(x) + length(y))), b as (select *, row_number() over (partition by query_id order by text desc, id desc) as n from r) select query_id, id as text_pick, gtin_pick, round(text, 3) as text_score from b where n = 1 and id <> gtin_pick and text >= 0.85"
)
def q_signal_conflict(spark, sf):
    return V.signal_conflicts(_asked(spark, sf), catalog(spark, sf))


def _decisions_sql() -> str:
    """The routing rules over ranked candidates: scores from the ranking, and the winner's own code for the master's."""
    win = "win as (select query_id, max(case when rank = 1 then master_id end) as top_id, max(case when rank = 1 then combined end) as top, coalesce(max(case when rank = 2 then combined end), 0.0::double) as nxt from ranked where rank <= 2 group by query_id)"
    own = lambda x: x.split(SQL_EVENTS + ", ", 1)[1]
    codes = own(_THREE).replace("master_gtin", "w.gtin").replace("from events0", "from events0 join win on query_id = true_master_id join catalog w on w.master_id = top_id")
    rules = _ROUTED[_ROUTED.index("sig as (") :].replace(f"{_TOP} as top, {_NEXT} as nxt", "top, nxt").replace("true_master_id % 23 = 0 as alias_hit", "false as alias_hit")
    rules = rules.replace("join verdicts v using (event_id)", "join verdicts v using (event_id) join win on query_id = c.true_master_id")
    columns = f"event_id, true_master_id, top_id as resolved_id, top_id = true_master_id as correct, {_CLASS} as problem_class, route, round(confidence, 9) as confidence, round(agreement, 9) as sig_source_agreement, round(text, 9) as sig_text_match, score as sig_barcode, {_OVERRIDES} as overrides, verdict as barcode_verdict"
    return f"with {_STAGE04}, {win}, {own(_NORM)}, {codes}, {rules}, placed as (select routed.*, e.true_master_id, w.top_id from routed join events0 e using (event_id) join win w on w.query_id = e.true_master_id) select {columns} from placed"


@query(_decisions_sql())
def q_decisions(spark, sf):
    """The full decision on each asked event, from retrieval to route; without the sentences that explain it."""
    c = catalog(spark, sf)
    e = events(spark, sf).filter(F.col("true_master_id") % _ASKED == 0)
    ranked = V.margins(V.rank_candidates(_asked(spark, sf), c))
    rounded = (F.round(n, 9).alias(n) for n in ("confidence", "sig_source_agreement", "sig_text_match"))
    return D.decide(e, ranked, c, key="true_master_id", joined=True).select("event_id", "true_master_id", "resolved_id", "correct", "problem_class", "route", *rounded, "sig_barcode", "overrides", "barcode_verdict")


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """A pick is right if it is the same product text."""
    c = catalog(spark, sf).select("master_id", V.blob("brand", "product_name").alias("t"))
    asked = c.filter(F.col("master_id") % _ASKED == 0).select(F.col("master_id").alias("left_id"), "t")
    return asked.join(c, "t").select("left_id", F.col("master_id").alias("right_id"))


def _sweep_sql(mixes: tuple, thresholds: tuple) -> str:
    """Signals of each block, the best of it under each mix, and measures at each threshold. First words of brands all sound alike in these tables."""
    values = ", ".join("(" + ", ".join(f"{w!r}::double" if isinstance(w, float) else str(w) for w in (k, *map(float, m), *map(float, V.normalized_weights(*m)))) + ")" for k, m in enumerate(mixes))
    return f"""with {_TFIDF}, sims as (select a.text as q, b.text as t, sum(a.weight * b.weight) as sim from vectors a join vectors b using (gram) where a.text in (select text from asked) and b.text in (select text from texts) group by 1, 2),
near as (select query_id, a.text as q, t.text as t, master_id, coalesce(sim, 0.0::double) as vector, row_number() over (partition by query_id order by round(coalesce(sim, 0.0::double), 9) desc, master_id) as pos from asked a cross join texts t left join sims s on s.q = a.text and s.t = t.text),
tokens as (select query_id, master_id, vector, pos, {sql_tokens('q')} as x, {sql_tokens('t')} as y from near where pos <= 50),
signals as (select query_id, master_id, vector, pos, {sql_ratio('x', 'y')} as text from tokens),
mixes as (select * from (values {values}) v(mix, w_text, w_phonetic, w_vector, t, p, v)),
scored as (select mix, query_id, master_id, pos, round(t * text + p * 1.0::double + v * vector, 9) as score from signals, mixes),
picked as (select *, row_number() over (partition by mix, query_id order by score desc, pos) as n from scored),
gold as (select a.query_id, t.master_id from texts a0 join asked a on a.query_id = a0.master_id join texts t on t.text = a0.text),
joined as (select k.mix, k.score, (g.master_id is not null) as hit, (k.query_id in (select query_id from gold)) as known from picked k left join gold g on g.query_id = k.query_id and g.master_id = k.master_id where n = 1),
sums as (select mix, th::double as threshold, sum((score >= th)::int)::bigint as predicted, sum((score >= th and hit)::int)::bigint as correct, sum((hit and known)::int)::double / nullif(sum(known::int), 0) as top1, (select count(*) from gold) as truth_pairs from joined, (values {", ".join(f"({t!r}::double)" for t in thresholds)}) h(th) group by 1, 2),
m as (select *, coalesce(correct::double / nullif(predicted, 0), 0.0::double) as pr, coalesce(correct::double / nullif(truth_pairs, 0), 0.0::double) as re from sums)
select mix, w_text, w_phonetic, w_vector, threshold, round(pr, 9) as precision, round(re, 9) as recall, round(case when pr + re = 0 then 0.0::double else 2 * pr * re / (pr + re) end, 9) as f1, round(coalesce(top1, 0.0::double), 9) as top1_accuracy, predicted, correct, truth_pairs from m join mixes using (mix)"""


@query(_sweep_sql((V.BENCHMARK_WEIGHTS,), (0.5,)))
def q_eval_prf(spark, sf):
    signals = V.blocked_signals(_asked(spark, sf), catalog(spark, sf))
    return _rounded(E.evaluate(E.picks(signals, (V.BENCHMARK_WEIGHTS,)), _gold(spark, sf), (0.5,)))


@query(_sweep_sql(E.MIXES, E.THRESHOLDS))
def q_weight_threshold_sweep(spark, sf):
    signals = V.blocked_signals(_asked(spark, sf), catalog(spark, sf))
    return _rounded(E.evaluate(E.picks(signals), _gold(spark, sf)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes))


# A plain evaluation whose scores SQL has too: a label's document against its length

_EVAL = "scores as (select doc_id, quality, least(1.0::double, n_chars / 4000.0::double) as p from labels join documents using (doc_id))"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"))


_GRID = "select t::double as threshold from (values " + ", ".join(f"({t})" for t in E.THRESHOLDS) + ") v(t)"


@query(
    f"with {_EVAL}, grid as ({_GRID}), s as (select threshold, sum((p >= threshold)::int)::bigint as predicted, sum((p >= threshold and quality = 1)::int)::bigint as correct, (select sum(quality)::bigint from scores) as truth_pairs from scores, grid group by threshold), m as (select *, case when predicted = 0 then 0.0::double else correct::double / predicted end as pr, case when truth_pairs = 0 then 0.0::double else correct::double / truth_pairs end as re from s) select threshold, predicted, correct, truth_pairs, round(pr, 9) as precision, round(re, 9) as recall, round(case when pr + re = 0 then 0.0::double else 2 * pr * re / (pr + re) end, 9) as f1 from m"
)
def q_eval_thresholds(spark, sf):
    rows = _scores(spark, sf)
    picked = rows.select(F.lit(0).alias("mix"), *(F.lit(0.0).alias(c) for c in ("w_text", "w_phonetic", "w_vector")), F.col("doc_id").alias("query_id"), F.col("doc_id").alias("cand_id"), F.col("p").alias("score"))
    gold = rows.filter("quality = 1").select(F.col("doc_id").alias("left_id"), F.col("doc_id").alias("right_id"))
    out = E.evaluate(picked, gold)
    return out.select("threshold", "predicted", "correct", "truth_pairs", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"with {_EVAL}, c as (select quality as y, p, least(1 - 1e-12::double, greatest(1e-12::double, p)) as q from scores) select round(avg((p - y) * (p - y)), 9) as brier, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 9) as log_loss from c")
def q_brier_logloss(spark, sf):
    return _scores(spark, sf).agg(F.round(E.brier(F.col("p"), F.col("quality")), 9).alias("brier"), F.round(E.log_loss(F.col("p"), F.col("quality")), 9).alias("log_loss"))


@query(f"with {_EVAL}, r as (select quality as y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as r from scores), s as (select sum(case when y = 1 then r else 0 end) as r, sum(y)::double as a, sum(1 - y)::double as b from r) select round((r - a * (a + 1) / 2) / (a * b), 9) as auc from s")
def q_auc(spark, sf):
    return E.auc(_scores(spark, sf), "p", "quality").select(F.round("auc", 9).alias("auc"))


_BINS = f"{_EVAL}, bins as (select (" + " + ".join(f"(p >= {i / 10}::double)::int" for i in range(1, 10)) + ") as bin, avg(p) as claimed, avg(quality::double) as observed, count(*) as n from scores group by 1)"


@query(f"with {_BINS} select bin, round(claimed, 9) as claimed, round(observed, 9) as observed, n from bins")
def q_reliability(spark, sf):
    return _rounded(E.reliability(_scores(spark, sf), "p", "quality"))


@query(f"with {_BINS} select round(sum(n * abs(claimed - observed)) / sum(n), 9) as ece, round(max(abs(claimed - observed)), 9) as max_bin_gap from bins")
def q_ece(spark, sf):
    return _rounded(E.calibration_error(E.reliability(_scores(spark, sf), "p", "quality")))


def _platt_sql(rounds: int = 14) -> str:
    steps = ["i0 as (select 1.0::double as a, 0.0::double as b)"]
    for k in range(rounds):
        steps.append(f"p{k} as (select p as x, quality as y, a, b, 1 / (1 + exp(-(a * p + b))) as pr from scores, i{k})")
        steps.append(f"s{k} as (select max(a) as a, max(b) as b, sum((pr - y) * x) as g1, sum(pr - y) as g2, sum(greatest(pr * (1 - pr), 1e-9) * x * x) as h1, sum(greatest(pr * (1 - pr), 1e-9) * x) as h2, sum(greatest(pr * (1 - pr), 1e-9)) as h3 from p{k})")
        steps.append(f"i{k + 1} as materialized (select a - (h3 * g1 - h2 * g2) / (h1 * h3 - h2 * h2) as a, b - (h1 * g2 - h2 * g1) / (h1 * h3 - h2 * h2) as b from s{k})")
    return f"with {_EVAL}, {', '.join(steps)} select round(a, 6) as a, round(b, 6) as b from i{rounds}"


@query(_platt_sql())
def q_platt_fit(spark, sf):
    fit = C.fit_platt(_scores(spark, sf), "p", "quality")
    return spark.range(1).select(F.round(F.lit(fit.a), 6).alias("a"), F.round(F.lit(fit.b), 6).alias("b"))


#: Each point's step is the largest, over starts before it, of the smallest mean up to any end after it.
_ISOTONIC = f"""{_EVAL}, pts as (select p, sum(quality)::double as s, count(*)::double as w, row_number() over (order by p) as k from scores group by p),
acc as (select k, p, sum(s) over (order by k) as cs, sum(w) over (order by k) as cw, s, w from pts),
spans as (select a.k as j, b.k as l, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) as m from acc a join acc b on b.k >= a.k),
low as (select j, l as k, min(m) over (partition by j order by l desc) as m from spans),
fit as (select k, max(m) as fitted from low group by k)"""


@query(f"with {_ISOTONIC} select round(p, 9) as p, round(fitted, 9) as fitted from fit join pts using (k)")
def q_isotonic_fit(spark, sf):
    rows = _scores(spark, sf)
    fit = C.fit_isotonic(rows, "p", "quality")
    return rows.select("p").distinct().select(F.round("p", 9).alias("p"), F.round(fit(F.col("p")), 9).alias("fitted"))


def _bands_sql(auto: str) -> str:
    return f"with {_EVAL}, b as (select quality = 1 as ok, {auto} as auto, p >= 0.6 and not ({auto}) as hold, p < 0.6 as reject from scores) select sum(auto::int)::bigint as auto, sum(hold::int)::bigint as hold, sum(reject::int)::bigint as reject, round(coalesce(sum((auto and ok)::int)::double / nullif(sum(auto::int), 0), 0), 9) as auto_precision, round(coalesce(sum((hold and ok)::int)::double / nullif(sum(hold::int), 0), 0), 9) as hold_precision, sum((reject and ok)::int)::bigint as correct_rejected from b"


@query(_bands_sql("p >= 0.9"))
def q_operational_bands(spark, sf):
    return _rounded(E.bands(_scores(spark, sf), "p", "quality", True))


@query(_bands_sql("false"))
def q_operational_single_signal(spark, sf):
    return _rounded(E.bands(_scores(spark, sf), "p", "quality", False))


# State

_ALIASES = "aliases as (select regexp_replace(lower(supplier_brand || ' ' || supplier_name), '\\s+', ' ', 'g') as alias_key, min(true_master_id) as resolved_id from events0 where true_master_id % 5 = 0 group by 1)"


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).filter(F.col("true_master_id") % 5 == 0)
    rows = e.groupBy(T.alias_key("supplier_brand", "supplier_name").alias("alias_key")).agg(F.min("true_master_id").alias("resolved_id"))
    return rows.select("alias_key", "resolved_id", F.lit("old").alias("resolved_name"), F.lit("ann").alias("approved_by"), F.lit("2024-01-01").cast("timestamp").alias("approved_at"), (F.col("resolved_id") % 3).alias("times_reused"))


@query(f"with {SQL_EVENTS}, {_ALIASES} select event_id, a.alias_key is not null as alias_hit, a.resolved_id as alias_resolved_id from events0 e left join aliases a on a.alias_key = regexp_replace(lower(supplier_brand || ' ' || supplier_name), '\\s+', ' ', 'g')")
def q_alias_lookup(spark, sf):
    return S.with_alias_hits(events(spark, sf), _aliases(spark, sf), "supplier_brand", "supplier_name").select("event_id", "alias_hit", "alias_resolved_id")


@query(
    f"with {SQL_EVENTS}, {_ALIASES}, new as (select regexp_replace(lower(supplier_brand || ' ' || supplier_name), '\\s+', ' ', 'g') as alias_key, max(true_master_id) as resolved_id from events0 where true_master_id % 7 = 0 group by 1) select coalesce(n.alias_key, a.alias_key) as alias_key, coalesce(n.resolved_id, a.resolved_id) as resolved_id, case when n.alias_key is null then 'ann' else 'bob' end as approved_by, coalesce(a.resolved_id % 3, 0)::bigint as times_reused from aliases a full join new n on a.alias_key = n.alias_key"
)
def q_alias_upsert(spark, sf):
    e = events(spark, sf).filter(F.col("true_master_id") % 7 == 0)
    new = e.select(T.alias_key("supplier_brand", "supplier_name").alias("alias_key"), F.col("true_master_id").alias("resolved_id"), F.col("master_name").alias("resolved_name"), F.lit("bob").alias("approved_by"), F.lit("2024-02-01").cast("timestamp").alias("approved_at"))
    return S.approve(_aliases(spark, sf), new).select("alias_key", "resolved_id", "approved_by", "times_reused")


@query(f"with {SQL_EVENTS}, {_ALIASES}, hits as (select regexp_replace(lower(supplier_brand || ' ' || supplier_name), '\\s+', ' ', 'g') as alias_key, count(*) as n from events0 group by 1) select a.alias_key, (resolved_id % 3 + coalesce(n, 0))::bigint as times_reused from aliases a left join hits using (alias_key)")
def q_alias_reuse(spark, sf):
    hits = events(spark, sf).select(T.alias_key("supplier_brand", "supplier_name").alias("alias_key"))
    return S.record_reuse(_aliases(spark, sf), hits).select("alias_key", "times_reused")


@query(
    f"with {_ROUTED}, {_ALIASES}, log as (select route, {_CLASS} as problem_class from routed) select 'route' as what, route as name, count(*) as n from log group by 2 union all select 'problem_class', problem_class, count(*) from log group by 2 union all select 'alias', 'entries', count(*) from aliases union all select 'alias', 'uses', coalesce(sum(resolved_id % 3), 0)::bigint from aliases"
)
def q_audit_summary(spark, sf):
    log = _routed(spark, sf).select("d.route", R.problem_class(F.col("agreement"), F.col("d.route"), F.col("second")).alias("problem_class"))
    return S.summary(log, _aliases(spark, sf))


# Quality of data, and records of other kinds


@query(
    f"with {SQL_EVENTS} select round(avg((supplier_brand = master_brand)::int), 9) as brand_share, round(avg((supplier_name = master_name)::int), 9) as name_share, round(avg(case when supplier_gtin <> '' then (supplier_gtin = master_gtin)::int end), 9) as gtin_share, (count(*) >= 20 and avg((supplier_brand = master_brand)::int) < 0.99 and avg((supplier_name = master_name)::int) < 0.99) as clean from events0"
)
def q_leak_canary(spark, sf):
    """Whether the supplier's fields are too like the master's to be its own."""
    same = lambda f: F.avg((F.col(f"supplier_{f}") == F.col(f"master_{f}")).cast("int"))
    code = F.avg(F.when(F.col("supplier_gtin") != "", (F.col("supplier_gtin") == F.col("master_gtin")).cast("int")))
    return events(spark, sf).agg(F.round(same("brand"), 9).alias("brand_share"), F.round(same("name"), 9).alias("name_share"), F.round(code, 9).alias("gtin_share"), ((F.count("*") >= 20) & (same("brand") < 0.99) & (same("name") < 0.99)).alias("clean"))


@query(f"with {SQL_CATALOG} select count(*) as n, count(distinct gtin) as codes, count(distinct master_id) as ids, sum(({sql_valid13('gtin')})::int)::bigint as valid, (select count(*) from (select gtin from catalog group by gtin having count(*) > 1)) as duplicated from catalog")
def q_catalog_quality(spark, sf):
    c = catalog(spark, sf)
    more = IO.duplicate_codes(c).agg(F.count("*").alias("duplicated"))
    return c.agg(F.count("*").alias("n"), F.countDistinct("gtin").alias("codes"), F.countDistinct("master_id").alias("ids"), F.sum(B.is_valid_ean13("gtin").cast("long")).alias("valid")).join(more)


@query("select url, min(page_id) as page_id, arg_min(length(html), page_id) as size from pages group by url")
def q_dedup_first_wins(spark, sf):
    rows = table(spark, sf, "pages").select("url", "page_id", F.length("html").cast("long").alias("size"))
    return IO.first_wins(rows, "url", "page_id")


@query("select lang, max(doc_id) as doc_id, arg_max(n_chars, doc_id) as n_chars from documents group by lang")
def q_last_wins(spark, sf):
    rows = table(spark, sf, "documents").select("lang", "doc_id", "n_chars", F.col("doc_id").alias("pos"))
    return IO.last_wins(rows, "lang")


@query("select event_type, count(*) as n, count(distinct props) as kinds, sum(length(props))::bigint as size, sum((json_valid(props))::int)::bigint as valid from events group by event_type")
def q_json_props(spark, sf):
    valid = F.sum(F.try_parse_json("props").isNotNull().cast("long"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("props").alias("kinds"), F.sum(F.length("props")).cast("long").alias("size"), valid.alias("valid"))


@query(f"with {SQL_CATALOG} select master_id, {sql_make_gtin('801', '(master_id + 1)')} as gtin, brand, product_name from catalog")
def q_benchmark_catalog(spark, sf):
    rows = catalog(spark, sf).select(F.col("master_id").alias("rec_id"), F.col("product_name").alias("name"), F.col("brand").alias("manufacturer"))
    made = IO.benchmark_catalog(rows, "rec_id", "801")
    return made.select(F.col("rec_id").alias("master_id"), "gtin", "brand", "product_name")


@query(f"with {SQL_EVENTS} select 'evt-' || (true_master_id + 1000000) as event_id, true_master_id + 1 as true_master_id, regexp_replace(lower(supplier_name), '\\s+', ' ', 'g') as supplier_norm_name, master_name from events0")
def q_benchmark_events(spark, sf):
    e = events(spark, sf)
    k = F.col("true_master_id")
    records = e.select((k + 1000000).alias("rec_id"), F.col("supplier_name").alias("name"), F.col("supplier_brand").alias("manufacturer"))
    rows = catalog(spark, sf).select(F.col("master_id").alias("rec_id"), F.col("product_name").alias("name"), F.col("brand").alias("manufacturer"))
    pairs = e.select((k + 1000000).alias("supplier_id"), k.alias("catalog_id"))
    nowhere = e.select((k + 1000000).alias("supplier_id"), (-1 - k).alias("catalog_id")).unionByName(e.select((-1 - k).alias("supplier_id"), k.alias("catalog_id")))
    mapping = pairs.unionByName(nowhere)  # pairs of which one end is missing are dropped
    made = IO.benchmark_events(mapping, records, IO.benchmark_catalog(rows, "rec_id", "801"))
    return made.select("event_id", "true_master_id", "supplier_norm_name", "master_name")


