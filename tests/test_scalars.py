import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.structures import BitsProvider, syntax_valid, top_fragments


def one(spark, expression, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for n, v in values.items())) if names else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "relation", "value"),
    [(">10", ">", 10.0), (">= 1e3", ">=", 1000.0), ("~5", "=", 5.0), ("-5", "=", 5.0), (".5", "=", 5.0), ("1,000", "=", 1000.0), ("<2.5", "<", 2.5)],
)
def test_relation(spark, raw, relation, value):
    got = one(spark, S.parse_relation(F.col("v")), v=raw)
    assert (got["relation"], got["value"]) == (relation, value) and math.isclose(got["p"], 9 - math.log10(value))


@pytest.mark.parametrize("raw", ["", None, "n/a", "0", "1e999"])
def test_relation_rejects(spark, raw):
    assert one(spark, S.parse_relation(F.col("v")), v=raw) is None


def test_numbers(spark):
    assert [one(spark, S.number(F.col("v")), v=x) for x in ("1.5", " 2 ", "x", "NaN", "inf", "")] == [1.5, 2.0, None, None, None, None]
    assert one(spark, S.number_or_last(F.col("v")), v="x") == -math.inf
    assert one(spark, S.number_text(F.col("v")), v="") == "" and one(spark, S.number_text(F.col("v"), 2), v="1.239") == "1.24"


def test_units(spark):
    assert one(spark, S.p_by_unit(F.lit("ic-50"), F.col("v"), F.lit("nM")), v=100.0).asDict() == {"value": 7.0, "unit": "pIC50"}
    assert one(spark, S.p_by_unit(F.lit("IC50"), F.col("v"), F.lit("µM")), v=100.0).asDict() == {"value": 100.0, "unit": "µM"}  # the sign isn't known there
    assert one(spark, S.p_by_unit(F.lit("IC50"), F.col("v"), F.lit("µM"), micro=True), v=100.0)["value"] == 4.0
    assert one(spark, S.strict_p(F.lit("Potency"), F.col("v"), F.lit("nM")), v=1.0) is None
    assert one(spark, S.solubility_log(F.lit("LogS"), F.col("v"), F.lit("")), v=-3.0) is None
    assert one(spark, S.solubility_log(F.lit("LogS"), F.col("v"), F.lit(""), compat=False), v=-3.0) == -3.0
    assert math.isclose(one(spark, S.solubility_log(F.lit("x"), F.col("v"), F.lit("µM")), v=1.0), -6)
    assert math.isclose(one(spark, S.permeability_log(F.lit("Papp"), F.col("v"), F.lit("10'-5 cm/s")), v=1.0), -5)
    assert one(spark, S.half_life_minutes(F.col("v"), F.lit("hr")), v=2.0) == 120.0
    assert one(spark, S.clearance(F.col("v"), F.lit("L/h")), v=2.0) is None


def test_text(spark):
    assert one(spark, S.clean_text(F.col("v")), v=" a\r\nb ") == "a  b"
    assert one(spark, S.squeeze_text(F.col("v")), v=" a \n\t b ") == "a b"
    assert one(spark, S.slug(F.col("v"), 5), v="__Ab c-d") == "Ab_c_"
    assert one(spark, S.slug(F.col("v")), v="--") == "unknown"
    assert one(spark, S.truncate(F.col("v"), 3), v="abcd") == "abc...[truncated]"
    assert one(spark, S.year(F.col("v")), v="1/2/2019") == 2019 and one(spark, S.year(F.col("v")), v="19a9") is None
    assert one(spark, S.tokenize(F.col("v"), 2), v="A-b, C d") == ["a-b", "c"]
    assert one(spark, S.direction(F.col("v")), v="  decrease it") == "Decrease"


def test_condition_bucket(spark):
    b = lambda e, d: one(spark, S.assay_bucket(F.lit(e), F.col("d"), F.lit("Homo sapiens"), F.lit(None)), d=d)
    assert b("logS_mol_L", "at pH 7.4 x") == "logS_mol_L|ph_7.4"
    assert b("Caco2_logPapp_cm_s", "B to A") == "Caco2_logPapp_cm_s|b_to_a"
    assert b("hERG_pIC50", "") == "hERG_pIC50|homo_sapiens|unknown"
    assert b("half_life_min", "Microsomes") == "half_life_min|homo_sapiens|microsome"


def test_hashes(spark):
    import hashlib

    h = hashlib.sha1(b"abc").hexdigest()
    assert one(spark, S.hash48(F.col("v")), v="abc") == int(h[:12], 16)
    assert one(spark, S.hash_fraction(F.col("v")), v="abc") == int(h[:8], 16) / 0xFFFFFFFF
    assert one(spark, S.connectivity_key(F.lit(""), F.col("v")), v="abc") == "SMILES_" + h[:14]


@pytest.mark.parametrize(
    ("said", "want"),
    [('x {"smiles": ["C", "CC", "C"]} y', ["C", "CC"]), ('{"edited_smiles": "CN"}', ["CN"]), ('["CO","CS"]', ["CO", "CS"]), ("- CCO\n* CCN", ["CCO", "CCN"]), ("", []), (None, [])],
)
def test_answers(spark, said, want):
    assert one(spark, S.parse_answers(F.col("v")), v=said) == want


def test_repair(spark):
    broken = '{"smiles": "CC", "list": ["a", "b'
    assert one(spark, S.repair_fields(F.col("v"), "smiles"), v=broken) == "CC"
    assert one(spark, S.repair_list(F.col("v"), "list"), v=broken) == ["a"]
    assert one(spark, S.repair_fields(F.col("v"), "smiles"), v="no") is None


def test_sets(spark):
    assert one(spark, S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == 1 / 3
    assert one(spark, S.jaccard(F.array().cast("array<int>"), F.lit(None).cast("array<int>"))) == 0.0
    assert one(spark, top_fragments(F.array(*map(F.lit, ("a", "bbb", "cc", "bb"))), 3)) == ["bbb", "cc", "bb"]
    assert one(spark, BitsProvider.fingerprint(F.array(F.lit(1.0), F.lit(-1.0), F.lit(2.0)))) == [0, 2]
    assert [one(spark, syntax_valid(F.col("v")), v=x) for x in ("C(C)", "C(C", "", None)] == [True, False, False, False]


def test_sizes(spark):
    assert [one(spark, S.size_in_mb(F.col("v")), v=x) for x in ("512K", "3M", "2 G", "1048576", "?")] == [0.5, 3.0, 2048.0, 1.0, 0.0]
