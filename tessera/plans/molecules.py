"""Queries on structure graphs. Every part is a structure, written from one end or from the other: a ring, a chain of carbons with a
branch, a second ring, and a last atom on it. The SQL builds the same graphs as atoms and bonds and never reads a notation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import objectives, structures
from ..operators.split import kept
from .catalog import query, table

#: r1, r2: ring sizes; arom: the second one aromatic; c: chain; b: its atom with a branch (0: none); e: last atom. id: the smallest part of the structure.
_M = """
m AS (SELECT *, min(p_partkey) OVER (PARTITION BY r1, r2, arom, c, b, e) AS id FROM (
  SELECT *, r2 = 6 AND p_partkey // 9 % 2 = 0 AS arom, p_partkey // 2 % (c + 1) AS b, ['N', 'O', 'F', 'Cl'][p_partkey // 5 % 4 + 1] AS e
  FROM (SELECT p_partkey, 5 + p_partkey % 3 AS r1, 5 + p_partkey // 3 % 3 AS r2, 1 + p_size % 8 AS c FROM part))),
s AS (SELECT DISTINCT id, r1, r2, arom, c, b, e, r1 + c + (b > 0)::INT AS q FROM m)"""
#: Atoms and bonds of each structure.
_G = (
    _M
    + """,
atoms AS (SELECT id, unnest(range(r1 + c + (b > 0)::INT)) AS i, 'C' AS s FROM s UNION ALL SELECT id, unnest(range(q, q + r2)), CASE WHEN arom THEN 'c' ELSE 'C' END FROM s UNION ALL SELECT id, q + r2, e FROM s),
one_way AS (SELECT id, unnest(range(r1 + c - 1)) AS a, unnest(range(1, r1 + c)) AS b, '-' AS o FROM s UNION ALL SELECT id, 0, r1 - 1, '-' FROM s UNION ALL SELECT id, r1 + b - 1, r1 + c, '-' FROM s WHERE b > 0
  UNION ALL SELECT id, r1 + c - 1, q, '-' FROM s UNION ALL SELECT id, unnest(range(q, q + r2 - 1)), unnest(range(q + 1, q + r2)), CASE WHEN arom THEN ':' ELSE '-' END FROM s
  UNION ALL SELECT id, q, q + r2 - 1, CASE WHEN arom THEN ':' ELSE '-' END FROM s UNION ALL SELECT id, q + r2 - 1, q + r2, '-' FROM s),
bonds AS (SELECT id, a, b, o FROM one_way UNION ALL SELECT id, b, a, o FROM one_way),
path(id, p, last_, t, u) AS (
  SELECT id, [i], i, s, s FROM atoms
  UNION ALL
  SELECT path.id, list_append(p, k.b), k.b, t || o || x.s, x.s || o || u FROM path JOIN bonds k ON k.id = path.id AND k.a = last_ JOIN atoms x ON x.id = k.id AND x.i = k.b WHERE len(p) <= {bonds} AND NOT list_contains(p, k.b)),
paths AS (SELECT id, least(t, u) AS t FROM path WHERE len(p) > 1 AND p[1] < last_)"""
)
#: Every single cut as the two sides' own parameters and sizes.
_CUTS = (
    _M
    + """,
k AS (SELECT s.*, unnest(range(0, c + 1)) AS k FROM s),
cut AS (SELECT id, 'L' || r1 || '|' || k || '|' || CASE WHEN b <= k THEN b ELSE 0 END AS x, r1 + k + (b BETWEEN 1 AND k)::INT AS nx, 'R' || r2 || arom || e || '|' || (c - k) || '|' || CASE WHEN b > k THEN b - k ELSE 0 END AS y, c - k + r2 + 1 + (b > k)::INT AS ny FROM k
  UNION ALL SELECT id, 'methyl', 1, 'M' || r1 || r2 || arom || e || '|' || c || '|' || b, r1 + c + r2 + 1 FROM s WHERE b > 0
  UNION ALL SELECT id, e, 1, 'E' || r1 || r2 || arom || '|' || c || '|' || b, r1 + c + r2 + (b > 0)::INT FROM s)"""
)


def notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, notation)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("5 + p_partkey % 3").alias("r1"), F.expr("5 + p_partkey div 3 % 3").alias("r2"), F.expr("1 + p_size % 8").alias("c"))
    p = p.withColumns({"arom": F.expr("r2 = 6 and p_partkey div 9 % 2 = 0"), "b": F.expr("int(p_partkey div 2 % (c + 1))"), "e": F.expr("element_at(array('N', 'O', 'F', 'Cl'), int(p_partkey div 5 % 4 + 1))")})
    p = p.withColumn("ring", F.expr("if(arom, 'c%11ccccc%11', concat('C%11', repeat('C', int(r2 - 2)), 'C%11'))"))
    first = F.expr("concat('C1', repeat('C', int(r1 - 2)), 'C1', if(b > 0, concat(repeat('C', b - 1), 'C(C)', repeat('C', c - b)), repeat('C', c)), ring, e)")
    last = F.expr("concat(e, ring, if(b > 0, concat(repeat('C', c - b), 'C(C)', repeat('C', b - 1)), repeat('C', c)), 'C5', repeat('C', int(r1 - 2)), 'C5')")
    return p.select("p_partkey", F.when(F.expr("p_partkey div 7 % 2 = 0"), first).otherwise(last).alias("notation"))


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts with their canonical text; and one graph for each structure with ``id``, its smallest part."""
    parts = notations(spark, sf_dir)
    canonical = structures.canonical_table(structures.graph_table(parts, "notation"))
    named = parts.join(canonical.select("notation", "canonical"), "notation").select("p_partkey", "canonical")
    # graphs stay with the few distinct structures: a part carries none
    return named, named.groupBy("canonical").agg(F.min("p_partkey").alias("id")).join(structures.one_each(canonical), "canonical")


@query(f"WITH {_M} SELECT p_partkey, id AS class, r1 + r2 + c + 1 + (b > 0)::INT AS atoms FROM m")
def canonical_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are one structure, whichever way it is written."""
    parts, known = _known(spark, sf_dir)
    return parts.join(known, "canonical").select("p_partkey", F.col("id").alias("class"), F.size("graph.atoms").cast("long").alias("atoms"))


@query(
    f"""
WITH {_M} SELECT p_partkey, min(p_partkey) OVER (PARTITION BY arom, CASE WHEN arom THEN r1 ELSE least(r1, r2) END, CASE WHEN arom THEN r2 ELSE greatest(r1, r2) END, c) AS scaffold_class, r1 + r2 + c AS scaffold_atoms FROM m"""
)
def scaffold_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts by the rings and links of their structure."""
    parts = notations(spark, sf_dir)
    named = parts.join(structures.scaffold_table(structures.graph_table(parts, "notation")).drop("graph"), "notation")
    least = named.groupBy("scaffold").agg(F.min("p_partkey").alias("scaffold_class"))
    return named.join(least, "scaffold").select("p_partkey", "scaffold_class", F.col("scaffold_atoms").cast("long").alias("scaffold_atoms"))


@query(
    f"""
WITH {_CUTS}, f AS (SELECT id, x AS f FROM cut UNION ALL SELECT id, y FROM cut), first_ AS (SELECT f, min(id) AS c FROM f GROUP BY f)
SELECT id, greatest(nx, ny)::BIGINT AS core_size, least(nx, ny)::BIGINT AS variable_size, least(a.c, b.c) AS lesser_class, greatest(a.c, b.c) AS greater_class FROM cut JOIN first_ a ON a.f = x JOIN first_ b ON b.f = y"""
)
def structure_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every single cut of every structure; a side's class is the first structure that has the same side."""
    cuts = structures.cut_table(_known(spark, sf_dir)[1], "id")
    sides = cuts.select("id", F.explode(F.array("core", "variable")).alias("f")).groupBy("f").agg(F.min("id").alias("c"))
    named = lambda x, name: x.join(sides.select(F.col("f").alias(name), F.col("c").alias(f"{name}_class")), name)
    x = named(named(cuts, "core"), "variable")
    return x.select("id", F.col("core_size").cast("long").alias("core_size"), F.col("variable_size").cast("long").alias("variable_size"), F.least("core_class", "variable_class").alias("lesser_class"), F.greatest("core_class", "variable_class").alias("greater_class"))


@query(
    f"""
WITH {_CUTS}, o AS (SELECT id, x AS core, y AS variable, nx AS n, ny AS v FROM cut WHERE nx > ny UNION ALL SELECT id, y, x, ny, nx FROM cut WHERE ny > nx), u AS (SELECT * FROM o WHERE n >= 5 AND v <= 8 AND n >= 0.6 * (n + v))
SELECT a.id AS a, b.id AS b, a.n AS core_size, a.v AS a_size, b.v AS b_size FROM u a JOIN u b ON a.core = b.core AND a.variable <> b.variable AND a.id <> b.id AND abs(a.v - b.v) <= 2"""
)
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures that differ in one part on the same core."""
    x = structures.core_pairs(structures.cut_table(_known(spark, sf_dir)[1], "id"), "id", least_ratio=0.6)
    return x.select("a", "b", *(F.col(c).cast("long").alias(c) for c in ("core_size", "a_size", "b_size")))


@query(
    f"""
WITH RECURSIVE {_G.format(bonds=5)}, bits AS (SELECT DISTINCT id, ('0x' || substr(sha1(t), 1, 8))::BIGINT % 2048 AS bit FROM paths),
f AS (SELECT id, count(*) AS n_bits, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM bits GROUP BY id), n AS (SELECT id, count(*) AS n_paths FROM paths GROUP BY id)
SELECT p_partkey, n_paths, n_bits, sha1(bits) AS bits FROM m JOIN f USING (id) JOIN n USING (id)"""
)
def path_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bits of the simple paths of up to five bonds."""
    parts = notations(spark, sf_dir)
    x = parts.join(structures.path_table(structures.graph_table(parts, "notation"), 5).drop("graph"), "notation")
    return x.select("p_partkey", F.col("n_paths").cast("long").alias("n_paths"), F.size("fingerprint").cast("long").alias("n_bits"), F.sha1(F.array_join("fingerprint", ",").cast("binary")).alias("bits"))


@query(
    f"""
WITH RECURSIVE {_G.format(bonds=3)}, n AS (SELECT t, count(*) AS n FROM paths GROUP BY t), l AS (SELECT n, count(*) AS k FROM n GROUP BY n),
w AS (SELECT sum(n * k) OVER (ORDER BY n DESC) AS upto, sum(k) OVER (ORDER BY n DESC) AS paths, sum(n * k) OVER () AS total FROM l), share AS (SELECT min(paths) AS share FROM w WHERE upto >= 0.8 * total),
fr AS (SELECT id, avg(log10(n / share)) AS f FROM paths JOIN n USING (t) CROSS JOIN share GROUP BY id),
d AS (SELECT id, e, r1 + r2 + c + 1 + (b > 0)::INT AS atoms, c + 1 AS turning, 2 * r1 - 1 + 2 * c + CASE WHEN b > 0 THEN 2 ELSE 0 END + CASE WHEN arom THEN 4 ELSE 2 * r2 - 2 END + CASE e WHEN 'N' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS h FROM s),
raw AS (SELECT *, 11 - (f - (pow(atoms, 1.005) - atoms) - log10(3) + 5) / 6.5 * 9 AS score FROM d JOIN fr USING (id)),
sa AS (SELECT *, greatest(1, least(10, CASE WHEN score > 8 THEN 8 + ln(score - 7) ELSE score END)) AS sa FROM raw)
SELECT p_partkey, round((atoms - 1) * 12.011 + h * 1.008 + CASE sa.e WHEN 'N' THEN 14.007 WHEN 'O' THEN 15.999 WHEN 'F' THEN 18.998 ELSE 35.453 END, 4) AS mw, (sa.e IN ('N', 'O'))::BIGINT AS hba, (sa.e IN ('N', 'O'))::BIGINT AS hbd,
  turning AS rotatable_bonds, 2::BIGINT AS rings, atoms AS heavy_atoms, round(sa, 6) AS sa_score FROM m JOIN sa USING (id)"""
)
def accessibility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """descriptors, and how common a structure's paths are in the table itself."""
    parts, known = _known(spark, sf_dir)
    scored = structures.accessibility(known, "id").join(known.select("id", "canonical"), "id")
    x = parts.join(scored, "canonical")
    return x.select("p_partkey", F.round("mw", 4).alias("mw"), *(F.col(c).cast("long").alias(c) for c in ("hba", "hbd", "rotatable_bonds", "rings", "heavy_atoms")), F.round("sa_score", 6).alias("sa_score"))


@query(
    f"""
WITH RECURSIVE {_G.format(bonds=5)}, bits AS (SELECT id, list(DISTINCT ('0x' || substr(sha1(t), 1, 8))::BIGINT % 2048) AS f FROM paths GROUP BY id),
r AS (SELECT a.p_partkey AS k, a.id AS i, b.id AS p, c.id AS n FROM m a JOIN m b ON b.p_partkey = a.p_partkey + 1 JOIN m c ON c.p_partkey = a.p_partkey + 2),
pred AS (SELECT p_partkey AS k, CASE p_partkey % 10 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS way, p_partkey % 10 = 1 AS faulty, p_partkey % 10 = 6 AS empty FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey + 1000000, 3, false, false FROM part WHERE p_partkey % 50 = 0),
x AS (SELECT pred.*, r.k IS NOT NULL AS here, r.i, r.p, r.n, CASE WHEN NOT faulty AND NOT empty THEN m.id END AS c FROM pred LEFT JOIN r ON r.k = pred.k LEFT JOIN m ON m.p_partkey = pred.k + way),
z AS (SELECT x.*, len(list_intersect(cf.f, pf.f)) / (len(cf.f) + len(pf.f) - len(list_intersect(cf.f, pf.f))) AS sp, len(list_intersect(cf.f, nf.f)) / (len(cf.f) + len(nf.f) - len(list_intersect(cf.f, nf.f))) AS si FROM x LEFT JOIN bits cf ON cf.id = x.c LEFT JOIN bits pf ON pf.id = x.p LEFT JOIN bits nf ON nf.id = x.i)
SELECT count(*)::BIGINT AS n_predictions, count_if(here)::BIGINT AS n_evaluated, round(avg(CASE WHEN here THEN (c IS NOT NULL)::INT END), 9) AS valid_rate, round(avg(CASE WHEN here THEN coalesce((c = p)::INT, 0) END), 9) AS positive_rate,
 round(avg(CASE WHEN here THEN coalesce((c = n)::INT, 0) END), 9) AS negative_rate, round(avg(CASE WHEN here THEN coalesce((c = i)::INT, 0) END), 9) AS unchanged_rate, round(avg(sp), 9) AS similarity_to_positive, round(avg(si), 9) AS similarity_to_input,
 count_if(NOT here)::BIGINT AS without_record, count_if(here AND faulty)::BIGINT AS errors, count_if(here AND empty)::BIGINT AS empty, (SELECT count(*) FROM r)::BIGINT AS n_samples, round(count_if(here) / (SELECT count(*) FROM r), 9) AS coverage FROM z"""
)
def replacement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12 on structures: records are neighbouring parts, predictions notations of parts further on, some faulty, empty or missing. (The
    remainders of 10 and 50 make the missing, faulty and orphaned predictions that the summary counts.)"""
    parts = notations(spark, sf_dir)
    table_ = structures.path_table(structures.canonical_table(structures.graph_table(parts, "notation")), 5)
    known = kept(parts.join(table_.select("notation", "canonical", "fingerprint"), "notation"))
    at = lambda n, *names: known.select((F.col("p_partkey") - n).alias("sample_id"), *(F.col(c).alias(a) for c, a in names))
    records = at(0, ("canonical", "input"), ("fingerprint", "input_fp")).join(at(1, ("canonical", "positive"), ("fingerprint", "positive_fp")), "sample_id").join(at(2, ("canonical", "negative")), "sample_id")
    k = F.col("p_partkey")
    asked = known.select(k.alias("sample_id"), (k % 10).alias("d")).filter("d <> 0").withColumn("way", F.when(F.col("d") == 2, 0).when(F.col("d").isin(3, 4), 1).when(F.col("d") == 5, 2).otherwise(3))
    orphans = known.filter(k % 50 == 0).select((k + 1_000_000).alias("sample_id"), F.lit(7).alias("d"), F.lit(3).alias("way"))
    answers = known.select(k.alias("_k"), "notation", "canonical", "fingerprint")
    said = asked.unionByName(orphans).join(answers, F.col("_k") == F.col("sample_id") + F.col("way"), "left")
    good = ~F.col("d").isin(1, 6)
    predictions = said.select("sample_id", F.when(F.col("d") == 1, "C1CC(").when(good, F.coalesce("notation", F.lit("C("))).otherwise("").alias("parsed"), F.when(good, F.col("canonical")).alias("canonical"), F.when(good, F.col("fingerprint")).alias("fp"), F.when(F.col("d") == 1, "timeout").alias("error"))
    x = objectives.replacement_summary(records, predictions)
    return x.select([F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in x.dtypes])
