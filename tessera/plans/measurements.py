"""Queries on parsing and normalizing measured values (scalar functions, unpivots, reject chains)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, rank
from ..sources import readers
from .catalog import query, table

# Raw measurement text made from event ids: relations, commas, exponents and garbage.
_RAW = """CASE event_id % 7 WHEN 0 THEN '>' WHEN 1 THEN '>= ' WHEN 2 THEN '~' WHEN 3 THEN '<' WHEN 4 THEN '-' WHEN 5 THEN '= ' ELSE '' END
|| CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN '1,2' || CAST(event_id % 90 + 10 AS {text}) ELSE CAST(event_id % 997 AS {text}) || '.' || CAST(event_id % 10 AS {text}) END
|| CASE WHEN event_id % 5 = 0 THEN 'e2' ELSE '' END"""
_NUMBER = r"([<>]=?|=)?\s*([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


@query("SELECT event_id, round(9.0 - log10(value), 6) AS p FROM events WHERE value > 0")
def p_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value > 0")
    return e.select("event_id", F.round(S.p_from_nm(F.col("value")), 6).alias("p"))


@query(
    f"""
WITH r AS (SELECT event_id, replace({_RAW.format(text='VARCHAR')}, ',', '') AS raw FROM events),
x AS (SELECT event_id, regexp_extract(raw, '{_NUMBER}', 1) AS rel, TRY_CAST(regexp_extract(raw, '{_NUMBER}', 2) AS DOUBLE) AS v FROM r)
SELECT event_id, CASE WHEN rel = '' THEN '=' ELSE rel END AS relation, v AS value, round(9.0 - log10(v), 6) AS p FROM x WHERE v > 0"""
)
def relation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_RAW.format(text="STRING")).alias("raw"))
    parsed = raw.select("event_id", S.parse_relation(F.col("raw")).alias("m")).filter("m is not null")
    return parsed.select("event_id", "m.relation", "m.value", F.round("m.p", 6).alias("p"))


_KIND = "CASE event_id % 6 WHEN 0 THEN 'IC50' WHEN 1 THEN 'ic-50' WHEN 2 THEN 'K_i' WHEN 3 THEN 'Potency' WHEN 4 THEN 'EC 50' ELSE 'Inhibition' END"
_UNIT = "CASE event_id % 5 WHEN 0 THEN 'nM' WHEN 1 THEN ' uM ' WHEN 2 THEN 'millimolar' WHEN 3 THEN 'µM' ELSE '' END"


@query(
    f"""
WITH r AS (SELECT event_id, value, {_KIND} AS kind, {_UNIT} AS unit FROM events WHERE value > 0),
x AS (SELECT event_id, value, trim(unit) AS unit, upper(regexp_replace(kind, '[-_]', '', 'g')) AS t, upper(regexp_replace(kind, '[-_ ]', '', 'g')) AS ts,
  CASE lower(trim(unit)) WHEN 'nm' THEN 9 WHEN 'um' THEN 6 WHEN 'millimolar' THEN 3 END AS shift FROM r),
y AS (SELECT *, CASE WHEN t IN ('AC50','CC50','EC50','GI50','IC50','IC90','KD','KI','LC50','POTENCY') THEN round(shift - log10(value), 6) END AS wide,
  CASE WHEN ts IN ('AC50','CC50','EC50','GI50','IC50','KD','KI','LC50') THEN round(shift - log10(value), 6) END AS strict FROM x)
SELECT event_id, coalesce(wide, round(value, 6)) AS wide_value, CASE WHEN wide IS NOT NULL THEN 'p' || t WHEN unit = '' THEN 'unitless' ELSE unit END AS wide_unit,
  strict AS strict_value, CASE WHEN strict IS NOT NULL THEN 'p' || ts END AS strict_unit FROM y"""
)
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value > 0").select("event_id", "value", F.expr(_KIND).alias("kind"), F.expr(_UNIT).alias("unit"))
    args = (F.col("kind"), F.col("value"), F.col("unit"))
    e = e.select("event_id", S.p_by_unit(*args).alias("w"), S.strict_p(*args).alias("s"))
    return e.select("event_id", F.col("w.value").alias("wide_value"), F.col("w.unit").alias("wide_unit"), F.col("s.value").alias("strict_value"), F.col("s.unit").alias("strict_unit"))


_ROW = "l_orderkey, l_linenumber"
_V = "(l_quantity - 3)"


@query(
    f"""
SELECT {_ROW},
 CASE WHEN {_V} > 0 THEN CASE l_linenumber % 5 WHEN 0 THEN {_V} WHEN 1 THEN round(log10({_V} * 1e-9), 6) WHEN 2 THEN round(log10({_V} * 1e-6), 6) WHEN 3 THEN round(log10({_V} * 1e-3), 6) END END AS solubility,
 CASE WHEN {_V} > 0 THEN CASE l_linenumber % 5 WHEN 1 THEN round(log10({_V} * 1e-6), 6) WHEN 2 THEN round(log10({_V} * 1e-7), 6) WHEN 3 THEN round(log10({_V} * 1e-5), 6) WHEN 4 THEN round(log10({_V} * 1e-7), 6) ELSE round(log10({_V} * 1.0), 6) END END AS permeability,
 CASE WHEN {_V} > 0 THEN CASE l_linenumber % 5 WHEN 1 THEN round(-log10({_V} * 1e-9), 6) WHEN 2 THEN round(-log10({_V} * 1e-6), 6) WHEN 3 THEN round(-log10({_V} * 1e-3), 6) END END AS pic50,
 CASE WHEN {_V} >= 0 AND l_linenumber % 2 = 0 THEN {_V} END AS clearance,
 CASE WHEN {_V} >= 0 THEN CASE l_linenumber % 3 WHEN 0 THEN {_V} * 60.0 WHEN 1 THEN {_V} END END AS half_life
FROM lineitem"""
)
def assay_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    v, n = F.col("l_quantity") - 3, F.col("l_linenumber")
    pick = lambda c, *options: F.element_at(F.array(*(F.lit(o) for o in options)), (c % len(options) + 1).cast("int"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.round(S.solubility_log(F.when(n % 5 == 0, "LogS").otherwise("Solubility"), v, pick(n, "nM", "nM", "µM", "mM", "g/L")), 6).alias("solubility"),
        F.round(S.permeability_log(F.lit("Papp"), v, pick(n, "cm/s", "10^-6 cm/s", "10'-7 cm/s", "10'-5 cm/s", "nm/s")), 6).alias("permeability"),
        F.round(S.pic50(v, pick(n, "%", "nM", "uM", "mM", "x")), 6).alias("pic50"),
        S.clearance(v, pick(n, "mL.min-1.kg-1", "mL/min")).alias("clearance"),
        S.half_life_minutes(v, pick(n, "hr", "min", "day")).alias("half_life"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, round(greatest(0.3, 0.9 - (CASE WHEN l_linestatus = 'F' THEN 0.2 ELSE 0.0 END + CASE WHEN l_tax > 0.04 THEN 0.15 ELSE 0.0 END + CASE WHEN l_returnflag <> 'N' THEN 0.1 ELSE 0.0 END)), 3) AS confidence,
CASE WHEN l_returnflag = 'N' THEN 0.9 ELSE 0.75 END::DOUBLE AS by_relation FROM lineitem"""
)
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    comment = F.when(F.col("l_linestatus") == "F", "Outside range")
    relation = F.when(F.col("l_returnflag") == "N", "=").otherwise(">")
    return li.select("l_orderkey", "l_linenumber", S.confidence(comment, F.col("l_tax") > 0.04, relation != "=").alias("confidence"), S.relation_confidence(relation).alias("by_relation"))


_ENDPOINT = "CASE p_size % 6 WHEN 0 THEN 'logS_mol_L' WHEN 1 THEN 'Caco2_logPapp_cm_s' WHEN 2 THEN 'hERG_pIC50' WHEN 3 THEN 'microsomal_clearance_mL_min_kg' WHEN 4 THEN 'half_life_min' ELSE 'other' END"
_NOTE = "CASE p_partkey % 5 WHEN 0 THEN 'Solubility at pH 7.4' WHEN 1 THEN 'Flux A to B' WHEN 2 THEN 'flux b-a side' WHEN 3 THEN 'Liver Microsomes' ELSE '' END"


@query(
    f"""
WITH r AS (SELECT p_partkey, {_ENDPOINT} AS e, lower({_NOTE}) AS d, lower(trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS org FROM part)
SELECT p_partkey, e || '|' || CASE e
 WHEN 'logS_mol_L' THEN 'ph_' || CASE WHEN regexp_extract(d, 'ph\\s*([0-9]+(?:\\.[0-9]+)?)', 1) = '' THEN 'unknown' ELSE regexp_extract(d, 'ph\\s*([0-9]+(?:\\.[0-9]+)?)', 1) END
 WHEN 'Caco2_logPapp_cm_s' THEN CASE WHEN contains(d, 'a to b') OR contains(d, 'a-b') THEN 'a_to_b' WHEN contains(d, 'b to a') OR contains(d, 'b-a') THEN 'b_to_a' ELSE 'bidirectional' END
 WHEN 'hERG_pIC50' THEN org || '|unknown'
 WHEN 'microsomal_clearance_mL_min_kg' THEN org || '|' || CASE WHEN contains(d, 'microsom') THEN 'microsome' ELSE 'clearance' END
 WHEN 'half_life_min' THEN org || '|' || CASE WHEN contains(d, 'microsom') THEN 'microsome' ELSE 'plasma_or_systemic' END
 ELSE 'generic' END AS bucket, e || '|' || CASE WHEN d = '' THEN 'unknown' ELSE d END AS joined FROM r"""
)
def condition_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ENDPOINT).alias("e"), F.expr(_NOTE).alias("d"), "p_brand")
    return p.select("p_partkey", S.assay_bucket(F.col("e"), F.col("d"), F.col("p_brand"), F.lit(None)).alias("bucket"), S.joined_bucket(F.col("e"), F.lower("d")).alias("joined"))


@query(
    """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'SMILES_' || substr(sha1(p_name), 1, 14) ELSE 'KEY' || p_partkey END AS connectivity_key,
 ('0x' || substr(sha1(p_name), 1, 12))::BIGINT AS hash48, round(('0x' || substr(sha1(p_name), 1, 8))::BIGINT / 4294967295.0, 9) AS fraction,
 substr(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 12) AS slug,
 lower(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS low_slug,
 CASE WHEN p_partkey % 2 = 0 THEN 'BDBM' || p_partkey ELSE 'BDBR' || p_size END AS ligand, CAST(p_partkey AS VARCHAR) AS cid,
 p_size % 2 = 0 AS p_like FROM part"""
)
def keys_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("KEY"), F.col("p_partkey").cast("string"), F.lit("-UHFFFAOYSA-N")))
    return p.select(
        "p_partkey", S.connectivity_key(key, F.col("p_name")).alias("connectivity_key"), S.hash48(F.col("p_name")).alias("hash48"), F.round(S.hash_fraction(F.col("p_name")), 9).alias("fraction"),
        S.slug(F.col("p_type"), 12).alias("slug"), S.lower_slug(F.col("p_type")).alias("low_slug"),
        S.ligand_id(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")), F.col("p_size")).alias("ligand"),
        S.id_after(F.concat(F.lit("pubchem_aid7_cid"), F.col("p_partkey").cast("string"), F.lit("_sid9"))).alias("cid"),
        S.has_p_suffix(F.when(F.col("p_size") % 2 == 0, "PubChem_AID7_pIC50").otherwise("PubChem_AID7_nM")).alias("p_like"),
    )


@query(
    """
WITH c AS (SELECT s_suppkey, s_name, s_suppkey % 4 AS n FROM supplier),
x AS (SELECT s_suppkey, CASE n WHEN 0 THEN 'TARGET_' || trim(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g'), '_') WHEN 1 THEN 'P' || s_suppkey
 WHEN 2 THEN 'P' || s_suppkey || '+SEQ_' || substr(sha1('MKV' || s_suppkey), 1, 12) ELSE 'P' || s_suppkey || '+SEQ_' || substr(sha1('MKV' || s_suppkey), 1, 12) || '+Q' || s_suppkey END AS target_id,
 CASE WHEN n >= 2 THEN 'MKV' || s_suppkey ELSE '' END AS sequence FROM c)
SELECT s_suppkey, target_id, sequence, CASE WHEN sequence = '' THEN '' ELSE substr(sha1(sequence), 1, 16) END AS sequence_hash FROM x"""
)
def chain_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key, none = F.col("s_suppkey").cast("string"), F.lit(None).cast("string")
    chain = lambda seq, sp, tr: F.struct(seq.alias("sequence"), sp.alias("swissprot"), tr.alias("trembl"), none.alias("name"), none.alias("other_name"))
    n = F.col("s_suppkey") % 4
    chains = F.array(chain(none, F.when(n > 0, F.concat(F.lit("P"), key)), none), chain(F.concat(F.lit("MKV"), key), none, none), chain(none, none, F.concat(F.lit("Q"), key)))
    t = S.chain_target(F.col("s_name"), n, F.when(n == 0, F.slice(chains, 1, 1)).otherwise(chains))
    return s.select("s_suppkey", t.alias("t")).select("s_suppkey", "t.target_id", "t.sequence", "t.sequence_hash")


@query(
    r"""
SELECT doc_id, md5(trim(translate(text, chr(13) || chr(10), '  '), ' ')) AS clean, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS squeezed,
 md5(CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...[truncated]' ELSE text END) AS cut, CASE WHEN doc_id % 2 = 0 THEN 2000 + doc_id % 25 ELSE 0 END::INTEGER AS year,
 CASE doc_id % 4 WHEN 0 THEN doc_id / 4.0 END AS number, CASE doc_id % 4 WHEN 0 THEN doc_id / 4.0 ELSE '-inf'::DOUBLE END AS sort_number FROM documents"""
)
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    odd = F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") / 4).cast("string")).when(F.col("doc_id") % 4 == 1, "n/a").when(F.col("doc_id") % 4 == 2, "NaN").otherwise("inf")
    date = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("3/1/"), (2000 + F.col("doc_id") % 25).cast("string"))).otherwise("unknown")
    return d.select("doc_id", F.md5(S.clean_text(F.col("text"))).alias("clean"), F.md5(S.squeeze_text(F.col("text"))).alias("squeezed"), F.md5(S.truncate(F.col("text"), 80)).alias("cut"), F.coalesce(S.year(date), F.lit(0)).alias("year"), S.number(odd).alias("number"), S.number_or_last(odd).alias("sort_number"))


@query(
    """
SELECT measure, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS hundredths FROM (
 SELECT 'quantity' AS measure, l_quantity AS value FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem)
WHERE value > 0 GROUP BY measure"""
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per filled measurement column."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = li.unpivot(["l_orderkey"], ["quantity", "price", "discount", "tax"], "measure", "value").filter("value > 0")
    return long.groupBy("measure").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 3 = 0 AS flagged, event_type AS endpoint FROM events")
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text to a struct, nested measurement to flat columns."""
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.struct(F.col("event_type").alias("endpoint")).alias("assay"), S.safe_json(F.col("props"), "k bigint").alias("p"), (F.col("user_id") % 3 == 0).alias("flagged")).alias("m"))
    return e.select("event_id", F.col("m.p.k").alias("k"), "m.flagged", "m.assay.endpoint")


@query(
    """
WITH r AS (SELECT event_id, value, CASE event_id % 6 WHEN 0 THEN 'T1_pChEMBL' WHEN 1 THEN 'logS_mol_L' WHEN 2 THEN 'half_life_min' WHEN 3 THEN 'clearance_x' WHEN 4 THEN 'A_pIC50' ELSE 'other' END AS e,
 CASE WHEN event_id % 2 = 0 THEN ' Decrease x' ELSE 'Increase x' END AS i FROM events)
SELECT event_id, CASE WHEN e IN ('T1_pChEMBL', 'A_pIC50') THEN 0.3 ELSE greatest(0.3, abs(value) * 0.25) END AS simple,
 CASE e WHEN 'T1_pChEMBL' THEN 0.3 WHEN 'A_pIC50' THEN 0.3 WHEN 'logS_mol_L' THEN 0.3 WHEN 'half_life_min' THEN greatest(30.0, abs(value) * 0.25) WHEN 'clearance_x' THEN greatest(5.0, abs(value) * 0.25) ELSE greatest(0.3, abs(value) * 0.25) END AS family,
 trim(split_part(trim(i), ' ', 1)) AS direction, CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS gain, round(least(0.55, 0.25 + 0.25 * value), 9) AS answer_confidence FROM r"""
)
def tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = F.when(i % 6 == 0, "T1_pChEMBL").when(i % 6 == 1, "logS_mol_L").when(i % 6 == 2, "half_life_min").when(i % 6 == 3, "clearance_x").when(i % 6 == 4, "A_pIC50").otherwise("other")
    told = F.when(i % 2 == 0, " Decrease x").otherwise("Increase x")
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", S.tolerance(e, v).alias("simple"), S.family_tolerance(e, v).alias("family"), S.direction(told).alias("direction"), S.improvement(told, v).alias("gain"), F.round(S.answer_confidence(v), 9).alias("answer_confidence"))


@query(
    r"""
SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_+\-.]+')[1:8], ' ') AS tokens, len(regexp_extract_all(lower(text), '[a-z0-9_+\-.]+')[1:96])::INTEGER AS n_tokens FROM conversations"""
)
def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.slice(S.tokenize(F.col("text")), 1, 8), " ").alias("tokens"), F.size(S.tokenize(F.col("text"))).alias("n_tokens"))


@query(
    r"""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'C' || p_size END AS smiles, CASE p_partkey % 4 WHEN 0 THEN 'a' || p_size || '|b' WHEN 1 THEN 'x' || p_size WHEN 2 THEN 'CC' || p_size || '|CN' ELSE '' END AS answers FROM part"""
)
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers of well-formed, single, listed and broken outputs."""
    p = table(spark, sf_dir, "part")
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    broken = F.when(k % 3 == 0, F.concat(F.lit('{"smiles": "C'), n, F.lit('", "why": "x"}'))).when(k % 3 == 1, F.concat(F.lit('{"smiles": "C'), n, F.lit('", "list": ["a",'))).otherwise("nothing")
    said = F.when(k % 4 == 0, F.concat(F.lit('so {"smiles": ["a'), n, F.lit('", "b", "c"]} ok'))).when(k % 4 == 1, F.concat(F.lit('{"edited_smiles": "x'), n, F.lit('"}'))).when(k % 4 == 2, F.concat(F.lit("- CC"), n, F.lit("\n* CN\nCO"))).otherwise("?")
    return p.select("p_partkey", S.repair_fields(broken, "smiles").alias("smiles"), F.array_join(S.parse_answers(said), "|").alias("answers"))


@query(
    """
SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN value IS NULL THEN 'no_value' WHEN value < 5 THEN 'too_small' WHEN user_id % 10 = 3 THEN 'blocked' WHEN event_type = 'error' THEN 'bad_type' ELSE 'kept' END AS reason FROM events) GROUP BY reason"""
)
def reject_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("no_value", F.col("value").isNull()), ("too_small", F.col("value") < 5), ("blocked", F.col("user_id") % 10 == 3), ("bad_type", F.col("event_type") == "error")]
    e = table(spark, sf_dir, "events").withColumn("reason", F.coalesce(audit.reject_reason(rules), F.lit("kept")))
    return e.groupBy("reason").agg(F.count("*").alias("n"))


def _unescaped(c: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return c


@query(
    rf"""
WITH t AS (SELECT page_id, ' ' || unnest(string_split_regex(html, '(?i)<a\s')[2:]) AS t FROM pages), o AS (SELECT page_id, t, regexp_extract(t, '(?s)^((?:"[^"]*"|''[^'']*''|[^>"''])*)>', 1) AS o FROM t WHERE regexp_matches(t, '(?i)</a\s*>')),
p AS (SELECT page_id, coalesce(nullif(regexp_extract(o, '(?is)\shref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(o, '(?is)\shref\s*=\s*''([^'']*)''', 1), ''), nullif(regexp_extract(o, '(?is)\shref\s*=\s*([^\s"''>]+)', 1), '')) AS href,
  string_split_regex(substr(t, length(o) + 2), '(?i)</a\s*>')[1] AS label FROM o)
SELECT page_id, {_unescaped("href")} AS href, trim(regexp_replace({_unescaped("regexp_replace(label, '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g'), ' ') AS label, count(*)::BIGINT AS n FROM p WHERE href IS NOT NULL GROUP BY ALL"""
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11."""
    return counted_links(readers.page_links(table(spark, sf_dir, "pages"), "html", "page_id"))


def counted_links(links: DataFrame) -> DataFrame:
    return links.groupBy("page_id", "href", "label").agg(F.count("*").alias("n"))


@query(
    """
WITH f AS (SELECT p_partkey, p_size * 100.0 / 1024 AS mb FROM part WHERE p_size * 100.0 / 1024 <= 4),
r AS (SELECT p_partkey, round(sum(mb) OVER (ORDER BY p_partkey), 6) AS running FROM f) SELECT p_partkey, running FROM r WHERE running <= 100"""
)
def budgeted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", S.size_in_mb(F.concat((F.col("p_size") * 100).cast("string"), F.lit("K"))).alias("mb"))
    return rank.budgeted(p, ["p_partkey"], "mb", 4.0, 100.0).select("p_partkey", F.round("running", 6).alias("running"))


@query(
    """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ',X' || user_id % 7 WHEN 1 THEN 'X' || user_id % 7 || ',' || event_type WHEN 2 THEN event_type WHEN 3 THEN 'X' || user_id % 7 ELSE event_type END AS answers,
 CASE WHEN value IS NOT NULL AND user_id IS NOT NULL THEN round(least(round(value) / 100, user_id % 100 / 100), 3) END AS confidence, floor(value * 10)::BIGINT AS tenths, CASE WHEN event_id % 3 = 0 THEN -1 ELSE round(value) END AS sorted_by FROM events"""
)
def answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F35 with items that are objects; F26 and F50 in their other forms."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    x, name = F.concat(F.lit("X"), (F.col("user_id") % 7).cast("string")), F.col("event_type")
    text = (
        F.when(k == 0, F.concat(F.lit('ok: {"answers": [{"smiles": "'), name, F.lit('"}, {"smiles": "", "SMILES": "'), x, F.lit('"}]}')))
        .when(k == 1, F.concat(F.lit('{"smiles": ["'), x, F.lit('", {"target_smiles": "'), name, F.lit('"}, {"none": 1}]}')))
        .when(k == 2, F.concat(F.lit('{"edited_smiles": "'), name, F.lit('"}')))
        .when(k == 3, F.concat(F.lit('["'), x, F.lit('", {"SMILES": "'), x, F.lit('"}]')))
        .otherwise(name)
    )
    scored = F.round(S.number_or_lowest(F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("value").cast("string"))))
    return e.select(
        "event_id", F.array_join(S.parse_answers(text), ",").alias("answers"), S.pair_confidence(F.round("value") / 100, (F.col("user_id") % 100) / 100).alias("confidence"),
        S.integer((F.col("value") * 10).cast("string")).alias("tenths"), F.when(scored < 0, -1.0).otherwise(scored).alias("sorted_by"),
    )
