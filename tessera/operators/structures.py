"""Tables of structures: everything about a notation is computed once for each different one and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs
from .split import kept


def graph_table(df: DataFrame, notation: str) -> DataFrame:
    """(notation, graph): the distinct notations that aren't null; graph is null where the notation is faulty."""
    return graphs.settled(df.select(notation).filter(F.col(notation).isNotNull()).distinct(), "graph", graphs.parse(F.col(notation)))


def canonical_table(table: DataFrame) -> DataFrame:
    """a graph table with ``canonical``, the same text for every notation of a structure, null for faulty ones. Kept, so that what reads it
    twice doesn't compute it twice."""
    return kept(graphs.with_canonical(table, "graph", "canonical"))


def one_each(table: DataFrame) -> DataFrame:
    """(canonical, graph): one graph for each structure of a canonical table."""
    return table.filter("canonical is not null").groupBy("canonical").agg(F.first("graph").alias("graph"))


def scaffold_table(table: DataFrame) -> DataFrame:
    """a graph table with ``scaffold`` (empty without a ring, null for faulty notations) and ``scaffold_atoms``."""
    core = graphs.settled(table, "_core", graphs.scaffold(F.col("graph"))).withColumn("scaffold_atoms", F.coalesce(F.size("_core.atoms"), F.lit(0)))
    out = graphs.with_canonical(core, "_core", "_text")
    return out.withColumn("scaffold", F.when(F.col("graph").isNotNull(), F.coalesce("_text", F.lit("")))).drop("_core", "_text")


def cut_table(table: DataFrame, key: str) -> DataFrame:
    """(key, core, variable, core_size, variable_size) for every single cut, each pair of texts once; the core has more heavy
    atoms, then the longer text, then the greater one; equal halves are no cut. ``*`` doesn't count as an atom."""
    cuts = table.select(key, F.explode(graphs.cuts(F.col("graph"))).alias("cut"))
    mark = lambda n: F.sha1(F.to_json(F.struct(f"cut.{n}.sym", f"cut.{n}.adj")).cast("binary"))
    both = kept(cuts.select(key, *(x for n in ("one", "other") for x in (F.col(f"cut.{n}").alias(n), mark(n).alias(f"{n}_mark")))))
    # small sides are the same in many structures: each numbered graph gets its text once
    sides = both.select(F.col("one_mark").alias("mark"), F.col("one").alias("graph")).unionByName(both.select(F.col("other_mark").alias("mark"), F.col("other").alias("graph")))
    texts = graphs.with_canonical(sides.groupBy("mark").agg(F.first("graph").alias("graph")), "graph", "text")
    side = kept(texts.select("mark", F.struct((F.size("graph.atoms") - 1).alias("size"), F.length("text").alias("length"), "text").alias("side")))
    named = both.select(key, "one_mark", "other_mark")
    for n in ("one", "other"):
        named = named.join(side.select(F.col("mark").alias(f"{n}_mark"), F.col("side").alias(n)), f"{n}_mark")
    ordered = named.select(key, F.greatest("one", "other").alias("c"), F.least("one", "other").alias("v")).filter("c.text <> v.text")
    return ordered.select(key, F.col("c.text").alias("core"), F.col("v.text").alias("variable"), F.col("c.size").alias("core_size"), F.col("v.size").alias("variable_size")).distinct()


def cut_fragments(table: DataFrame, key: str, least: int = 4) -> DataFrame:
    """(key, fragment, size): both sides of every single cut with ``least`` heavy atoms or more, and the whole structure where none is
    that large."""
    cuts = cut_table(table, key)
    sides = cuts.select(key, F.explode(F.array(F.struct(F.col("core").alias("fragment"), F.col("core_size").alias("size")), F.struct(F.col("variable").alias("fragment"), F.col("variable_size").alias("size")))).alias("f"))
    found = sides.select(key, "f.fragment", "f.size").filter(F.col("size") >= least).distinct()
    whole = graphs.with_canonical(table.filter("graph is not null").join(found.select(key).distinct(), key, "left_anti"), "graph", "_text")
    return found.unionByName(whole.select(key, F.concat(F.lit("fallback:"), F.col("_text")).alias("fragment"), F.size("graph.atoms").alias("size")))


def core_pairs(cuts: DataFrame, key: str, least_core: int = 5, most_variable: int = 8, least_ratio: float = 0.5, delta: int = 2) -> DataFrame:
    """Ordered pairs of structures with one core and different variable parts, whose sizes differ by ``delta`` atoms at most. The
    size is part of the join key (a row meets its own size and its neighbours), so a frequent core isn't paired with itself as a whole."""
    usable = cuts.filter((F.col("core_size") >= least_core) & (F.col("variable_size") <= most_variable) & (F.col("core_size") >= least_ratio * (F.col("core_size") + F.col("variable_size"))))
    a = usable.select(F.col(key).alias("a"), "core", "core_size", F.col("variable").alias("a_variable"), F.col("variable_size").alias("a_size"))
    b = usable.select(F.col(key).alias("b"), "core", F.col("variable").alias("b_variable"), F.col("variable_size").alias("b_size"))
    near = a.withColumn("b_size", F.explode(F.sequence(F.col("a_size") - delta, F.col("a_size") + delta)))
    return near.join(b, ["core", "b_size"]).filter("a_variable <> b_variable and a <> b").select("a", "b", "core", "core_size", "a_variable", "b_variable", "a_size", "b_size")


def path_table(table: DataFrame, most: int = 7, bits: int = 2048) -> DataFrame:
    """a graph table with ``n_paths`` and ``fingerprint``, the bits of all its simple paths."""
    texts = graphs.settled(table, "_paths", graphs.paths(F.col("graph"), most))
    return graphs.settled(texts.withColumn("n_paths", F.size("_paths")), "fingerprint", graphs.path_bits(F.col("_paths"), bits)).drop("_paths")


def fragment_contributions(paths: DataFrame, most: int = 65_536) -> DataFrame:
    """(path, contribution): the logarithm of a path's count over the number of the most frequent paths that make up 80 % of
    all. Only the ``most`` frequent paths (ties by text) are in the model; the others share its last row, ``path`` null, as if seen once.
    The share is taken on a histogram of counts, a few rows however many paths there are."""
    counts = paths.groupBy("path").agg(F.count("*").alias("n"))
    levels = counts.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("n"))
    running = levels.select("n", F.sum(F.col("n") * F.col("k")).over(w).alias("upto"), F.sum("k").over(w).alias("paths"), F.sum(F.col("n") * F.col("k")).over(Window.partitionBy()).alias("total"))
    share = running.filter(F.col("upto") >= 0.8 * F.col("total")).agg(F.min("paths").alias("share"))
    model = counts.orderBy(F.desc("n"), "path").limit(most).unionByName(counts.limit(1).select(F.lit(None).cast("string").alias("path"), F.lit(1).cast("long").alias("n")))
    return model.crossJoin(F.broadcast(share)).select("path", F.log10(F.col("n") / F.col("share")).alias("contribution"))


def scaled_accessibility(fragments: Column, atoms: Column, rings: Column) -> Column:
    """1 (easy) to 10 (hard) of the mean contribution, less penalties for size and rings."""
    raw = fragments - (F.pow(atoms.cast("double"), F.lit(1.005)) - atoms) - F.log10(rings + 1)
    score = 11 - (raw + 4 + 1) / F.lit(2.5 + 4) * 9
    smooth = F.when(score > 8, 8 + F.log(F.greatest(score - 7, F.lit(1.0)))).otherwise(score)
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), smooth))


def accessibility(table: DataFrame, key: str, most_bonds: int = 3) -> DataFrame:
    """(key, descriptors, sa_score); contributions are learned from the paths of the table's own structures. The model is of a
    fixed size, and joined by path."""
    known = table.filter("graph is not null").select(key, "graph")
    described = graphs.settled(known, "d", graphs.descriptors(F.col("graph")))
    paths = known.select(key, F.explode(graphs.paths(F.col("graph"), most_bonds)).alias("path"))
    model = fragment_contributions(paths)
    rest = model.filter("path is null").select(F.col("contribution").alias("_rest"))
    scored = paths.join(model.filter("path is not null"), "path", "left").crossJoin(F.broadcast(rest)).groupBy(key).agg(F.avg(F.coalesce("contribution", "_rest")).alias("fragments"))
    out = described.drop("graph").join(scored, key, "left")
    return out.select(key, "d.*", scaled_accessibility(F.coalesce("fragments", F.lit(0.0)), F.col("d.heavy_atoms"), F.col("d.rings")).alias("sa_score"))
