"""Scalar expressions over raw assay text: cleaning, numbers, units, keys, hashes, templates.

Everything is a ``Column`` built from JVM-side functions. Missing text is NULL inside the engine; functions
that reproduce a text rule treat NULL as the empty string and say so.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Measurement types on a concentration scale. POTENCY and IC90 belong to the wide set only.
STRICT_TYPES = ("AC50", "CC50", "EC50", "GI50", "IC50", "KD", "KI", "LC50")
WIDE_TYPES = ("AC50", "CC50", "EC50", "GI50", "IC50", "IC90", "KD", "KI", "LC50", "POTENCY")
# Unit spellings.
NANOMOLAR, MICROMOLAR, MILLIMOLAR, MOLAR = ("nm", "nanomolar"), ("um", "micromolar"), ("mm", "millimolar"), ("m", "molar")
MICRO_SIGNS = ("µm", "μm")
LOG_SOLUBILITY_TYPES = ("logs", "logs0", "logsolubility", "log(kinetic_solubility)")
LOG_PERMEABILITY_TYPES = ("logpapp", "logpe")
PERMEABILITY_UNITS = {
    1e-6: ("10^-6 cm/s", "10'-6 cm/s", "1e-6 cm/s", "10e-6 cm/s", "ucm/s", "cm/s * 10e6", "10'6cm/s"),
    1e-7: ("10'-7 cm/s", "10^-7 cm/s", "nm/s", "nm s-1"),
    1e-5: ("10'-5 cm/s", "10^-5cm/s", "10'-5cm/s"),
    1.0: ("cm/s", "cm s-1"),
}
CLEARANCE_UNITS = ("ml.min-1.kg-1", "ml/min/kg", "ml min-1 kg-1")
HOUR_UNITS, MINUTE_UNITS = ("hr", "h", "hour", "hours"), ("min", "minute", "minutes")
# Fixed value: relation and number, found anywhere in the text.
RELATION_NUMBER = r"([<>]=?|=)?\s*([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
TOKEN = r"[A-Za-z0-9_+\-.]+"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """line ends become spaces, outer spaces go, NULL is empty."""
    return F.trim(F.translate(text(c), "\r\n", "  "))


def squeeze_text(c: Column) -> Column:
    """runs of white space become one space."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def slug(c: Column, most: int = 80, default: str = "unknown") -> Column:
    """runs of other characters than ASCII letters and digits become ``_``; case is kept."""
    body = F.regexp_replace(F.regexp_replace(clean_text(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(body, 1, most), F.lit("")), F.lit(default))


def lower_slug(c: Column, most: int = 48, default: str = "unknown") -> Column:
    """F4."""
    return slug(F.lower(text(c)), most, default)


def number(c: Column) -> Column:
    """tolerant double; text that is no number, NaN and infinities are NULL."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def whole_number(c: Column) -> Column:
    return number(c).cast("long")


def number_or_last(c: Column) -> Column:
    """Sort key that puts missing numbers last in descending order."""
    return F.coalesce(number(c), F.lit(float("-inf")))


def parse_relation(c: Column) -> Column:
    """struct of relation, value and p-scale of a nM text; NULL without a positive finite number."""
    raw = F.replace(clean_text(c), F.lit(","), F.lit(""))
    value = F.regexp_extract(raw, RELATION_NUMBER, 2).try_cast("double")
    relation = F.coalesce(F.nullif(F.regexp_extract(raw, RELATION_NUMBER, 1), F.lit("")), F.lit("="))
    ok = (value > 0) & (value < F.lit(float("inf")))
    return F.when(ok, F.struct(relation.alias("relation"), value.alias("value"), p_from_nm(value).alias("p")))


def p_from_nm(c: Column) -> Column:
    return F.lit(9.0) - F.log10(c)


def canonical_type(c: Column, spaces: bool = False) -> Column:
    """upper case without ``-`` and ``_`` (and spaces)."""
    return F.upper(F.regexp_replace(text(c), "[-_ ]" if spaces else "[-_]", ""))


def _p_scale(value: Column, unit: Column, micro: bool) -> Column:
    u = F.lower(clean_text(unit))
    micros = MICROMOLAR + (MICRO_SIGNS if micro else ())
    shift = F.when(u.isin(*NANOMOLAR), 9.0).when(u.isin(*micros), 6.0).when(u.isin(*MILLIMOLAR), 3.0)
    return F.round(shift - F.log10(value), 6)


def p_by_unit(kind: Column, value: Column, unit: Column, micro: bool = False) -> Column:
    """(value, unit) on the p-scale for concentration types with a known unit, else as it came. ``micro`` also
    reads the micro signs; without it they fall through, as the reference rule does."""
    t = canonical_type(kind)
    scaled = F.when(t.isin(*WIDE_TYPES), _p_scale(value, unit, micro))
    name = F.when(scaled.isNotNull(), F.concat(F.lit("p"), t)).otherwise(F.coalesce(F.nullif(clean_text(unit), F.lit("")), F.lit("unitless")))
    return F.when(value > 0, F.struct(F.coalesce(scaled, F.round(value, 6)).alias("value"), name.alias("unit")))


def strict_p(kind: Column, value: Column, unit: Column, micro: bool = False) -> Column:
    """F8: like F7, but NULL for other types and units."""
    t = canonical_type(kind, spaces=True)
    scaled = F.when(t.isin(*STRICT_TYPES) & (value > 0), _p_scale(value, unit, micro))
    return F.when(scaled.isNotNull(), F.struct(scaled.alias("value"), F.concat(F.lit("p"), t).alias("unit")))


def solubility_log(kind: Column, value: Column, unit: Column, compat: bool = True) -> Column:
    """log10 mol/L. Under ``compat`` values up to 0 go before the log types are looked at."""
    t, u = F.lower(text(kind)), F.lower(text(unit))
    is_log = F.replace(t, F.lit(" "), F.lit("")).isin(*LOG_SOLUBILITY_TYPES) | t.contains("log s")
    factor = F.when(u.isin(*NANOMOLAR), 1e-9).when(u.isin(*MICROMOLAR, *MICRO_SIGNS), 1e-6).when(u.isin(*MILLIMOLAR), 1e-3).when(u.isin(*MOLAR), 1.0)
    out = F.when(is_log, value).when(value > 0, F.log10(value * factor))
    return F.when(value > 0, out) if compat else out


def permeability_log(kind: Column, value: Column, unit: Column, compat: bool = True) -> Column:
    """log10 cm/s."""
    is_log = F.replace(F.lower(text(kind)), F.lit(" "), F.lit("")).isin(*LOG_PERMEABILITY_TYPES)
    u = F.lower(text(unit))
    factor = reduce(lambda c, kv: c.when(u.isin(*kv[1]), kv[0]), PERMEABILITY_UNITS.items(), F.when(F.lit(False), 1.0))
    out = F.when(is_log, value).when(value > 0, F.log10(value * factor))
    return F.when(value > 0, out) if compat else out


def pic50(value: Column, unit: Column) -> Column:
    """F12."""
    u = F.lower(text(unit))
    factor = F.when(u == "nm", 1e-9).when(u.isin("um", *MICRO_SIGNS), 1e-6).when(u == "mm", 1e-3)
    return F.when(value > 0, -F.log10(value * factor))


def clearance(value: Column, unit: Column) -> Column:
    """the value, if its unit is mL/min/kg."""
    return F.when((value >= 0) & F.lower(text(unit)).isin(*CLEARANCE_UNITS), value)


def half_life_minutes(value: Column, unit: Column) -> Column:
    """F14."""
    u = F.lower(text(unit))
    return F.when(value >= 0, F.when(u.isin(*HOUR_UNITS), value * 60.0).when(u.isin(*MINUTE_UNITS), value))


def confidence(validity_comment: Column, duplicate: Column, doubtful: Column) -> Column:
    """0.9 less 0.2, 0.15 and 0.1, not under 0.3. ``doubtful``: inexact relation, or a low assay confidence."""
    less = F.when(text(validity_comment) != "", 0.2).otherwise(0.0) + F.when(F.coalesce(duplicate, F.lit(False)), 0.15).otherwise(0.0) + F.when(F.coalesce(doubtful, F.lit(True)), 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.3), F.lit(0.9) - less), 3)


def relation_confidence(relation: Column, exact: float = 0.9, other: float = 0.75) -> Column:
    """F16."""
    return F.when(relation == "=", exact).otherwise(other)


def assay_bucket(endpoint: Column, description: Column, organism: Column, cell: Column) -> Column:
    """condition bucket of an endpoint from its assay's description. The names of endpoints and buckets, and the words they
    are told by."""
    d, org, cel = F.lower(text(description)), lower_slug(organism), lower_slug(cell)
    ph = F.regexp_extract(d, r"ph\s*([0-9]+(?:\.[0-9]+)?)", 1)
    matrix = lambda other: F.when(d.contains("microsom"), "microsome").otherwise(other)
    rest = (
        F.when(endpoint == "logS_mol_L", F.concat(F.lit("ph_"), F.coalesce(F.nullif(ph, F.lit("")), F.lit("unknown"))))
        .when(endpoint == "Caco2_logPapp_cm_s", F.when(d.contains("a to b") | d.contains("a-b"), "a_to_b").when(d.contains("b to a") | d.contains("b-a"), "b_to_a").otherwise("bidirectional"))
        .when(endpoint == "hERG_pIC50", F.concat_ws("|", org, cel))
        .when(endpoint == "microsomal_clearance_mL_min_kg", F.concat_ws("|", org, matrix("clearance")))
        .when(endpoint == "half_life_min", F.concat_ws("|", org, matrix("plasma_or_systemic")))
        .otherwise("generic")
    )
    return F.concat_ws("|", endpoint, rest)


def joined_bucket(*parts: Column) -> Column:
    """parts joined by ``|``; missing ones are ``unknown``."""
    return F.concat_ws("|", *(F.coalesce(F.nullif(text(p), F.lit("")), F.lit("unknown")) for p in parts))


def short_hash(c: Column, n: int) -> Column:
    return F.substring(F.sha1(text(c).cast("binary")), 1, n)


def hash48(c: Column) -> Column:
    """the first 12 hex digits of SHA-1 as a number."""
    return F.conv(short_hash(c, 12), 16, 10).cast("long")


def hash_fraction(c: Column) -> Column:
    """the first 8 hex digits over 0xFFFFFFFF."""
    return F.conv(short_hash(c, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def connectivity_key(inchikey: Column, smiles: Column) -> Column:
    """the first block of the key, else a hash of the structure."""
    return F.coalesce(F.nullif(F.substring_index(clean_text(inchikey), "-", 1), F.lit("")), F.concat(F.lit("SMILES_"), short_hash(smiles, 14)))


def chain_target(name: Column, chain_count: Column, chains: Column) -> Column:
    """struct (target_id, target_name, sequence, sequence_hash, sequence_length) from an array of chains with the
    fields sequence, swissprot, trembl, name and other_name; 1 to 12 chains count."""
    n = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(12), whole_number(chain_count))), F.lit(1)).cast("int")
    some = lambda c: F.nullif(clean_text(c), F.lit(""))
    used = F.slice(chains, F.lit(1), n)
    ids = F.filter(F.transform(used, lambda c: F.coalesce(some(c["swissprot"]), some(c["trembl"]), F.when(some(c["sequence"]).isNotNull(), F.concat(F.lit("SEQ_"), short_hash(clean_text(c["sequence"]), 12))))), lambda x: x.isNotNull())
    names = F.filter(F.transform(used, lambda c: F.coalesce(some(c["name"]), some(c["other_name"]))), lambda x: x.isNotNull())
    sequences = F.filter(F.transform(used, lambda c: some(c["sequence"])), lambda x: x.isNotNull())
    label = F.coalesce(some(name), F.array_join(names, "; "))
    whole = F.array_join(sequences, "|")
    return F.struct(
        F.when(F.size(ids) > 0, F.array_join(ids, "+")).otherwise(F.concat(F.lit("TARGET_"), slug(label, 60))).alias("target_id"),
        label.alias("target_name"),
        whole.alias("sequence"),
        F.when(whole != "", short_hash(whole, 16)).otherwise("").alias("sequence_hash"),
        F.when(F.size(sequences) > 0, F.aggregate(sequences, F.lit(0), lambda a, s: a + F.length(s))).alias("sequence_length"),
    )


def ligand_id(monomer: Column, reactant_set: Column) -> Column:
    """F21."""
    some = lambda c: F.nullif(clean_text(c), F.lit(""))
    return F.coalesce(F.concat(F.lit("BDBM"), some(monomer)), F.concat(F.lit("BDBR"), some(reactant_set)), F.lit(""))


def graded_confidence(relation: Column) -> Column:
    """F16: three levels: exact, censored, anything else."""
    return F.when(relation == "=", 0.8).when(relation.isin("<", ">", "<=", ">="), 0.65).otherwise(0.55)


def id_after(c: Column, mark: str = "_cid") -> Column:
    """what follows a mark, up to the next underscore."""
    return F.regexp_extract(text(c), mark + "([^_]+)", 1)


def has_p_suffix(endpoint: Column) -> Column:
    """endpoint names that end in a p-type."""
    return text(endpoint).rlike("_p(" + "|".join(STRICT_TYPES) + ")$")


def has_dynamic_suffix(endpoint: Column, suffixes: Sequence[str] = ("_pChEMBL", "_pKi", "_pIC50", "_pKd", "_pEC50")) -> Column:
    """endpoint names that end in one of the given suffixes, case included."""
    return reduce(lambda a, b: a | b, (text(endpoint).endswith(s) for s in suffixes))


def year(c: Column) -> Column:
    """the last four characters, if they are digits."""
    return F.when(text(c).rlike("[0-9]{4}$"), F.right(text(c), F.lit(4)).cast("int"))


def safe_json(c: Column, schema: str) -> Column:
    """NULL for text that is no JSON of this schema."""
    return F.from_json(text(c), schema, {"mode": "PERMISSIVE"})


def tolerance(endpoint: Column, value: Column) -> Column:
    """0.3 for p-like endpoints, else a quarter of the value and 0.3 at least."""
    return F.when(has_p_suffix(endpoint) | endpoint.contains("pChEMBL"), 0.3).otherwise(F.greatest(F.lit(0.3), F.abs(value) * 0.25))


def family_tolerance(endpoint: Column, value: Column, p: float = 0.3, log: float = 0.3, relative: float = 0.25) -> Column:
    """tolerance by endpoint family."""
    low = F.lower(endpoint)
    is_p = reduce(lambda a, b: a | b, (endpoint.contains(x) for x in ("pChEMBL", "pIC50", "pKi", "pKd", "pEC50")))
    part = F.abs(value) * relative
    return F.when(is_p, p).when(low.contains("logs") | low.contains("logpapp"), log).when(low.contains("half_life"), F.greatest(F.lit(30.0), part)).when(low.contains("clearance"), F.greatest(F.lit(5.0), part)).otherwise(F.greatest(F.lit(0.3), part))


def direction(instruction: Column) -> Column:
    """F32."""
    return F.when(F.lower(F.trim(text(instruction))).startswith("decrease"), "Decrease").otherwise("Increase")


def improvement(instruction: Column, delta: Column) -> Column:
    return F.when(direction(instruction) == "Decrease", -delta).otherwise(delta)


def tokenize(c: Column, most: int = 96) -> Column:
    """lower-cased tokens, the first ``most``."""
    return F.slice(F.regexp_extract_all(F.lower(text(c)), F.lit(f"({TOKEN})"), 1), 1, most)


def number_or_lowest(c: Column) -> Column:
    """F26, for sorting: text that is no number counts as less than all; NaN and infinities stay."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(float("-inf")))


def integer(c: Column) -> Column:
    """a tolerant whole number, cut towards zero; NULL beyond the range of a long."""
    x = number(c)
    return F.when(F.abs(x) < 9.2e18, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"))


def pair_confidence(a: Column, b: Column) -> Column:
    """F50 of a measured pair: the lesser of both, three digits; NULL if one is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.round(F.least(a, b), 3))


#: The keys under which a model's answers are looked for, in this order, and those of an answer that is an object.
ANSWER_KEYS = ("edited_smiles", "smiles", "molecules", "answers", "predictions")
OBJECT_KEYS = ("smiles", "SMILES", "target_smiles")


def truncate(c: Column, most: int = 800, mark: str = "...[truncated]") -> Column:
    """F34."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def parse_answers(c: Column, most: int = 2) -> Column:
    """structure strings from a model's output: a JSON object's first known key, a JSON array, lines, then tokens; an item that is
    an object gives the first of OBJECT_KEYS that it has."""
    t = clean_text_lines(c)
    body = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    listed = [safe_json(body, f"{key} array<string>")[key] for key in ANSWER_KEYS]
    single = [F.when(~F.startswith(F.get_json_object(body, f"$.{key}"), F.lit("[")), F.array(F.get_json_object(body, f"$.{key}"))) for key in ANSWER_KEYS]
    inner = lambda x: F.when(x.startswith("{"), F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{key}"), F.lit("")) for key in OBJECT_KEYS))).otherwise(x)
    array = F.from_json(F.regexp_extract(t, r"(?s)(\[.*\])", 1), "array<string>")
    tidy = lambda a: F.nullif(F.array_distinct(F.filter(F.transform(a, lambda x: clean_text(inner(x))), lambda x: x != "")), F.array().cast("array<string>"))
    lines = F.transform(F.split(F.replace(t, F.lit(","), F.lit("\n")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[-*`'\" ]+|[-*`'\" ]+$", "")))
    lines = F.filter(lines, lambda x: (F.length(x) >= 2) & x.rlike(r"^[A-Za-z0-9@+\-\[\]()=#$\\/%.:]+$"))
    tokens = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9@+\-\[\]()=#$\\/%.:]{3,})"), 1)
    return F.slice(F.coalesce(*(tidy(x) for pair in zip(listed, single, strict=True) for x in pair), tidy(array), tidy(lines), tidy(tokens), F.array().cast("array<string>")), 1, most)


def clean_text_lines(c: Column) -> Column:
    return F.trim(F.replace(text(c), F.lit("\r"), F.lit("\n")))


def repair_fields(c: Column, field: str) -> Column:
    """a string field of a JSON object that may be broken."""
    t = text(c)
    return F.coalesce(F.get_json_object(F.regexp_extract(t, r"(?s)(\{.*\})", 1), f"$.{field}"), F.nullif(F.trim(F.regexp_extract(t, rf'"{field}"\s*:\s*"([^"]*)"', 1)), F.lit("")))


def repair_list(c: Column, field: str) -> Column:
    """a list field of a JSON object that may be broken: its quoted items."""
    t = text(c)
    good = safe_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1), f"{field} array<string>")[field]
    inner = F.regexp_extract(t, rf'(?s)"{field}"\s*:\s*\[([^\]]*)', 1)
    return F.coalesce(good, F.regexp_extract_all(inner, F.lit(r'"([^"]+)"'), 1))


# The sentences of F38 and the classes of F39.


def coverage_band(samples: Column, molecules: Column, buckets: Column, tier: Column) -> Column:
    """recommendation of a broad endpoint by its counts."""
    return (
        F.when(tier == "proxy", "Use as secondary constraint or silver training signal")
        .when((samples >= 5000) & (molecules >= 2500) & (buckets >= 50), "Strong broad candidate; inspect assay families")
        .when((samples >= 1000) & (molecules >= 700), "Usable broad candidate; condition filtering recommended")
        .otherwise("Lower coverage; use selectively")
    )


def sample_band(samples: Column, tier: Column) -> Column:
    """recommendation by samples alone."""
    return (
        F.when(tier == "proxy", "Use as secondary constraint or silver training signal")
        .when(samples >= 10000, "Strong candidate for benchmark property")
        .when(samples >= 3000, "Usable candidate; inspect assay buckets")
        .otherwise("Lower coverage; use selectively or after expansion")
    )


def grouped_number(c: Column) -> Column:
    """thousands separated."""
    return F.format_number(c, 0)


def badge(recommendation: Column) -> Column:
    """class of a recommendation by its words."""
    low = F.lower(text(recommendation))
    return F.when(low.contains("strong"), "strong").when(low.contains("usable"), "usable").when(low.contains("lower"), "low").otherwise("proxy")


def number_text(c: Column, digits: int = 6) -> Column:
    """rounded to text; empty for missing numbers."""
    return F.coalesce(F.round(number(c), digits).cast("string"), F.lit(""))


def answer_confidence(similarity: Column) -> Column:
    """F50."""
    return F.least(F.lit(0.55), F.lit(0.25) + F.lit(0.25) * similarity)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero by arithmetic, as SQL rounds a double, without a decimal number for every row. Values too large for digits
    behind the point stay as they are."""
    scaled = F.abs(x) * F.lit(10.0**digits)
    whole = F.floor(scaled)
    up = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / F.lit(10.0**digits)
    return F.when(scaled < float(1 << 52), F.when(x < 0, -up).otherwise(up)).otherwise(x)


def jaccard(a: Column, b: Column) -> Column:
    """shared over all elements of two sets; 0 for missing or empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def bit_words(positions: Column, n: int) -> list[Column]:
    """A set of positions below 64 n as n numbers of 64 bits; NULL for NULL."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int"))
    word = lambda k: F.aggregate(F.filter(positions, lambda x: F.floor(x / 64) == k), F.lit(0).cast("long"), lambda w, x: w.bitwiseOR(bit(x)))
    return [word(k) for k in range(n)]


def words_jaccard(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """``jaccard`` of two sets as words of bits, in compiled code."""
    both, either = (reduce(add, (F.bit_count(f(x, y)) for x, y in zip(a, b, strict=True))) for f in (Column.bitwiseAND, Column.bitwiseOR))
    return F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(0.0))


def size_in_mb(c: Column) -> Column:
    """K, M, G or plain bytes."""
    t = F.upper(F.trim(text(c)))
    n = F.regexp_extract(t, r"^([0-9.]+)\s*[KMG]?$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"([KMG])$", 1)
    return F.coalesce(F.when(unit == "K", n / 1024).when(unit == "M", n).when(unit == "G", n * 1024).otherwise(n / 1024 / 1024), F.lit(0.0))
