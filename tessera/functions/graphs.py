"""Structure graphs of line notations, as arrays in a column and without a toolkit.

``parse`` folds the tokens of a notation into a graph: atoms as structs and, for each atom, its bonds. Everything else is an expression
over such a graph: canonical order by partition refinement, a notation written in that order, scaffolds by peeling, single
cuts by reachability, simple paths for fingerprints. One structure is one row, so nothing is shuffled and no Python
runs; callers compute distinct structures once and join them back (J11).

Covered: the organic subset and bracket atoms, bonds - = # :, branches, ring closures up to %99, components. Stereo marks and atom maps are dropped
(the non-isomeric form); aromatic atoms are those written in lower case, Kekule forms stay as they are. Null, empty and
faulty notations (unknown tokens, open brackets or rings, too many bonds) have a null graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structures import ORGANIC

_ATOM = "struct<el:string,iso:int,charge:int,h:int>"
_STATE = f"struct<last:int,stack:array<int>,bond:int,open:array<struct<label:string,atom:int,bond:int>>,atoms:array<{_ATOM}>,bonds:array<struct<a:int,b:int,o:int>>,ok:boolean>"
_TOKEN = r"\[[^\[\]]+\]|Br|Cl|[BCNOPSFI*]|[bcnops]|%[0-9]{2}|[0-9]|[-=#:/\\.()]"
_BRACKET = r"^\[([0-9]*)([A-Z][a-z]?|se|as|te|[bcnops]|\*)@{0,2}(H[0-9]*)?(\++|-+|[+-][0-9]+)?(?::[0-9]+)?\]$"
#: Bonds that an uncharged atom can have at most, the steps in which hydrogen fills them, and masses.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1, 3, 5)}
MASSES = {"H": 1.008, "B": 10.812, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.99, "Si": 28.086, "P": 30.974, "S": 32.067, "Cl": 35.453, "K": 39.098, "Se": 78.96, "Br": 79.904, "I": 126.904}
AROMATIC = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def until(steps: Column, start: Column, done: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """At most so many steps from a state; a state that is done stays."""
    return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, lambda s, _: F.when(done(s), s).otherwise(step(s)))


def _up(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _struct(**parts: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def _aromatic(el: Column) -> Column:
    return el.isin("b", "c", "n", "o", "p", "s", "se", "as", "te")


def _put(s: Column, **new: Column) -> Column:
    """The parser's state with other values."""
    names = ("last", "stack", "bond", "open", "atoms", "bonds", "ok")
    return _struct(**{n: new.get(n, s[n]) for n in names})


def _number(text: Column, missing: int) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).cast("int"), F.lit(missing))


def _atom(t: Column) -> Column:
    """An atom of its token; h is -1 where hydrogen is implied."""
    part = lambda k: F.regexp_extract(t, _BRACKET, k)
    marks = part(4)
    sign = F.when(marks.startswith("-"), -1).otherwise(1)
    charge = F.when(marks == "", 0).when(marks.rlike("[0-9]"), sign * _number(F.regexp_extract(marks, "([0-9]+)", 1), 0)).otherwise(sign * F.length(marks))
    h = F.when(part(3) == "", 0).when(part(3) == "H", 1).otherwise(_number(F.substring(part(3), 2, 9), 0))
    inside = _struct(el=part(2), iso=_number(part(1), 0), charge=charge.cast("int"), h=h.cast("int"))
    return F.when(t.startswith("["), inside).otherwise(_struct(el=t, iso=F.lit(0), charge=F.lit(0), h=F.when(t == "*", 0).otherwise(-1)))


def _bond(s: Column, a: Column, b: Column, order: Column, atoms: Column) -> Column:
    usual = F.when(_aromatic(F.get(atoms, a)["el"]) & _aromatic(F.get(atoms, b)["el"]), AROMATIC).otherwise(1)
    return F.concat(s["bonds"], F.array(_struct(a=F.least(a, b), b=F.greatest(a, b), o=F.when(order > 0, order).otherwise(usual))))


def _read(s: Column, t: Column) -> Column:
    none, here = F.lit(0), s["last"]
    at = F.size(s["atoms"])
    more = F.concat(s["atoms"], F.array(_atom(t)))
    atom = _put(s, last=at, bond=none, atoms=more, bonds=F.when(here >= 0, _bond(s, here, at, s["bond"], more)).otherwise(s["bonds"]), ok=s["ok"] & (F.element_at(more, -1)["el"] != ""))
    order = F.when(t == "=", 2).when(t == "#", 3).when(t == ":", AROMATIC).otherwise(1)
    bond = _put(s, bond=order, ok=s["ok"] & (s["bond"] == 0) & (here >= 0))
    fork = _put(s, stack=F.concat(s["stack"], F.array(here)), ok=s["ok"] & (here >= 0) & (s["bond"] == 0))
    n = F.size(s["stack"])
    back = _put(s, last=F.when(n > 0, s["stack"][n - 1]).otherwise(-1), stack=F.when(n > 0, F.slice(s["stack"], 1, n - 1)).otherwise(s["stack"]), ok=s["ok"] & (n > 0) & (s["bond"] == 0))
    apart = _put(s, last=F.lit(-1), ok=s["ok"] & (n == 0) & (s["bond"] == 0) & (here >= 0))
    label = F.ltrim(t, F.lit("%")).cast("int").cast("string")
    found = F.filter(s["open"], lambda x: x["label"] == label)
    opened = _put(s, open=F.concat(s["open"], F.array(_struct(label=label, atom=here, bond=s["bond"]))), bond=none, ok=s["ok"] & (here >= 0))
    start = found[0]
    again = F.exists(s["bonds"], lambda x: (x["a"] == F.least(start["atom"], here)) & (x["b"] == F.greatest(start["atom"], here)))
    closed = _put(s, open=F.filter(s["open"], lambda x: x["label"] != label), bond=none, bonds=_bond(s, start["atom"], here, F.greatest(s["bond"], start["bond"]), s["atoms"]), ok=s["ok"] & (here >= 0) & (start["atom"] != here) & ~again)
    ring = F.when(F.size(found) > 0, closed).otherwise(opened)
    kind = t.substr(1, 1)
    return F.when(~s["ok"], s).when(kind.isin("-", "=", "#", ":", "/", "\\"), bond).when(kind == "(", fork).when(kind == ")", back).when(kind == ".", apart).when(kind.rlike("[0-9%]"), ring).otherwise(atom)


def _orders(bonds: Column) -> Column:
    """The sum of the bonds of an atom, each aromatic one counting once."""
    return F.aggregate(bonds, F.lit(0), lambda n, e: n + F.when(e["o"] == AROMATIC, 1).otherwise(e["o"]))


def _implied(el: Column, bonds: Column) -> Column:
    """Hydrogen of an atom without brackets; null where there is no room for its bonds, or it needs brackets."""
    used = _orders(bonds)
    out = F.when(el == "c", F.greatest(F.lit(0), 3 - used)).when(el.isin("n", "o", "p", "s", "b"), 0)
    for symbol, steps in VALENCES.items():
        for most in steps:
            out = out.when((el == symbol) & (used <= most), most - used)
    return out.cast("int")


def _symbol(a: Column, bonds: Column) -> Column:
    """The text of an atom: brackets only where they say something."""
    h = F.when(a["h"] == 1, "H").when(a["h"] > 1, F.concat(F.lit("H"), a["h"].cast("string"))).otherwise("")
    sign = F.when(a["charge"] > 0, "+").otherwise("-")
    charge = F.when(a["charge"] == 0, "").when(F.abs(a["charge"]) == 1, sign).otherwise(F.concat(sign, F.abs(a["charge"]).cast("string")))
    iso = F.when(a["iso"] > 0, a["iso"].cast("string")).otherwise("")
    plain = (a["iso"] == 0) & (a["charge"] == 0) & ((a["h"] == _implied(a["el"], bonds)) | ((a["el"] == "*") & (a["h"] == 0)))
    return F.when(F.coalesce(plain, F.lit(False)), a["el"]).otherwise(F.concat(F.lit("["), iso, a["el"], h, charge, F.lit("]")))


def _graph(atoms: Column, adj: Column) -> Column:
    """atoms, their bonds (n the neighbour, o the order) and their texts."""
    return let(_struct(atoms=atoms, adj=adj), lambda g: _struct(atoms=g["atoms"], adj=g["adj"], sym=F.transform(g["atoms"], lambda a, i: _symbol(a, g["adj"][i]))))


def parse(notation: Column) -> Column:
    """the graph of a notation, null if it is faulty."""
    tokens = F.regexp_extract_all(notation, F.lit(_TOKEN), 0)
    empty = _struct(last=F.lit(-1), stack=F.array(), bond=F.lit(0), open=F.array(), atoms=F.array(), bonds=F.array(), ok=F.lit(True)).cast(_STATE)
    read = F.aggregate(tokens, empty, _read)
    edges = lambda s, i: F.transform(F.filter(s["bonds"], lambda e: (e["a"] == i) | (e["b"] == i)), lambda e: _struct(n=F.when(e["a"] == i, e["b"]).otherwise(e["a"]), o=e["o"]))
    adj = lambda s: F.transform(_up(F.size(s["atoms"])), lambda i: edges(s, i))

    def built(s: Column, adj: Column) -> Column:
        room = lambda a, i: a.withField("h", F.when(a["h"] >= 0, a["h"]).otherwise(_implied(a["el"], adj[i])))
        return let(F.transform(s["atoms"], room), lambda atoms: F.when(~F.exists(atoms, lambda a: a["h"].isNull()), _graph(atoms, adj)))

    whole = lambda s: s["ok"] & (F.size(s["atoms"]) > 0) & (s["bond"] == 0) & (F.size(s["stack"]) == 0) & (F.size(s["open"]) == 0) & (s["last"] >= 0)
    good = F.coalesce(F.array_join(tokens, "") == notation, F.lit(False))
    return F.when(good, let(read, lambda s: F.when(whole(s), let(adj(s), lambda x: built(s, x)))))


# canonical order


def _dense(keys: Column) -> Column:
    """Ranks of keys, equal for equal ones, and the number of different ones."""
    return let(keys, lambda x: let(F.array_sort(F.array_distinct(x)), lambda u: _struct(r=F.transform(x, lambda k: F.array_position(u, k).cast("int") - 1), k=F.size(u))))


def _around(g: Column, r: Column, i: Column) -> Column:
    return F.xxhash64(F.array_sort(F.transform(g["adj"][i], lambda e: r[e["n"]] * 8 + e["o"])))


def _refined(g: Column, start: Column, n: Column) -> Column:
    """Ranks split by the ranks around an atom until no class splits any more; classes only split, so their order stays."""
    finer = lambda s: _dense(F.transform(s["r"], lambda x, i: F.shiftleft(x.cast("long"), 40) + F.pmod(_around(g, s["r"], i), F.lit(1 << 40))))
    step = lambda s: let(finer(s), lambda t: _struct(r=t["r"], k=t["k"], still=t["k"] == s["k"]))
    return until(n, let(start, lambda s: _struct(r=s["r"], k=s["k"], still=F.lit(False))), lambda s: s["still"] | (s["k"] == n), step)


def ranks(g: Column) -> Column:
    """The canonical rank of each atom. While atoms tie, each of the lowest tied class is set apart in turn and the refinement
    with the smallest certificate stays; atoms whose certificates are equal are taken as interchangeable."""

    def certificate(s: Column) -> Column:
        return F.xxhash64(F.array_sort(F.transform(s["r"], lambda x, i: F.xxhash64(x, g["sym"][i], _around(g, s["r"], i)))))

    def split(s: Column, n: Column) -> Column:
        tied = F.array_min(F.filter(s["r"], lambda x: F.size(F.filter(s["r"], lambda y: y == x)) > 1))
        apart = lambda i: _dense(F.transform(s["r"], lambda x, j: 2 * x + F.when(i == j, 0).otherwise(1)))
        one = lambda i: let(_refined(g, apart(i), n), lambda t: _struct(c=certificate(t), r=t["r"], k=t["k"]))
        members = let(tied, lambda t: F.filter(_up(n), lambda i: s["r"][i] == t))
        return let(F.array_min(F.transform(members, one)), lambda b: _struct(r=b["r"], k=b["k"], still=F.lit(False)))

    first = _dense(F.transform(g["sym"], lambda x, i: F.xxhash64(x, F.size(g["adj"][i]))))
    return let(F.size(g["atoms"]), lambda n: until(n, _refined(g, first, n), lambda s: s["k"] == n, lambda s: split(s, n))["r"])


def _depth_first(g: Column, r: Column, n: Column) -> Column:
    """Atoms in depth-first order by rank, and the parent of each."""
    pop = lambda s: F.slice(s["stack"], 1, F.size(s["stack"]) - 1)
    nexts = lambda s, x: F.transform(F.array_sort(F.transform(F.filter(g["adj"][x["at"]], lambda e: ~F.array_contains(s["order"], e["n"])), lambda e: _struct(r=-r[e["n"]], n=e["n"]))), lambda y: _struct(at=y["n"], up=x["at"]))
    visit = lambda s, x: _struct(order=F.concat(s["order"], F.array(x["at"])), up=F.concat(s["up"], F.array(x["up"])), stack=F.concat(pop(s), nexts(s, x)))
    skip = lambda s: _struct(order=s["order"], up=s["up"], stack=pop(s))
    step = lambda s: let(F.element_at(s["stack"], -1), lambda x: F.when(F.array_contains(s["order"], x["at"]), skip(s)).otherwise(visit(s, x)))
    roots = F.transform(F.array_sort(F.transform(r, lambda x, i: _struct(r=-x, n=i))), lambda y: _struct(at=y["n"], up=F.lit(-1)))
    start = _struct(order=F.array().cast("array<int>"), up=F.array().cast("array<int>"), stack=roots)
    bonds = F.aggregate(g["adj"], F.lit(0), lambda k, x: k + F.size(x))
    return until(n + bonds, start, lambda s: F.size(s["stack"]) == 0, step)


def _mark(g: Column, a: Column, b: Column) -> Column:
    """The text of a bond."""
    order = F.filter(g["adj"][a], lambda e: e["n"] == b)[0]["o"]
    both = _aromatic(g["atoms"][a]["el"]) & _aromatic(g["atoms"][b]["el"])
    return F.when(order == 2, "=").when(order == 3, "#").when((order == AROMATIC) & ~both, ":").when((order == 1) & both, "-").otherwise("")


def _closing(g: Column, d: Column) -> Column:
    """The ring closures as pairs of places in the order, sorted."""
    place = F.transform(d["order"], lambda _, i: F.array_position(d["order"], i).cast("int") - 1)
    pairs = lambda place: F.flatten(F.transform(d["order"], lambda a, p: F.transform(F.filter(g["adj"][a], lambda e: (place[e["n"]] > p) & (d["up"][place[e["n"]]] != a)), lambda e: _struct(p=p, q=place[e["n"]]))))
    return let(place, lambda place: F.array_sort(pairs(place)))


def _written(g: Column, d: Column, closing: Column) -> Column:
    """Texts of subtrees, from the last place to the first; a branch but the last stands in parentheses."""
    n = F.size(d["order"])
    digit = lambda k: F.when(k < 10, k.cast("string")).otherwise(F.concat(F.lit("%"), k.cast("string")))

    def one(t: Column, p: Column) -> Column:
        a = d["order"][p]
        rings = F.transform(closing, lambda c, k: F.when(c["p"] == p, F.concat(_mark(g, a, d["order"][c["q"]]), digit(k + 1))).when(c["q"] == p, digit(k + 1)).otherwise(""))
        below = F.filter(_up(n), lambda q: d["up"][q] == a)
        tail = lambda q: F.concat(_mark(g, a, d["order"][q]), t[q])
        branches = let(below, lambda b: F.array_join(F.transform(b, lambda q, k: F.when(k < F.size(b) - 1, F.concat(F.lit("("), tail(q), F.lit(")"))).otherwise(tail(q))), ""))
        return let(F.concat(g["sym"][a], F.array_join(rings, ""), branches), lambda new: F.transform(t, lambda x, j: F.when(j == p, new).otherwise(x)))

    texts = F.aggregate(F.reverse(_up(n)), F.transform(d["order"], lambda _: F.lit("")), one)
    return let(texts, lambda t: F.array_join(F.transform(F.filter(_up(n), lambda p: d["up"][p] < 0), lambda p: t[p]), "."))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a further column that is computed once, behind a generator: filters and joins on it don't carry its expression, which
    would multiply in the optimizer, to other places of the plan."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_canonical(df: DataFrame, graph: str, name: str) -> DataFrame:
    """one text for all notations of a graph, as a further column; null for a null graph. Step by step, since the analyzer takes
    an iteration for each level of nested lambdas."""
    g = F.col(graph)
    out = settled(df, "_ranks", F.when(g.isNotNull(), ranks(g)))
    out = settled(out, "_walk", F.when(g.isNotNull(), _depth_first(g, F.col("_ranks"), F.size(g["atoms"]))))
    out = settled(out, "_closing", F.when(g.isNotNull(), _closing(g, F.col("_walk"))))
    return settled(out, name, F.when(g.isNotNull(), _written(g, F.col("_walk"), F.col("_closing")))).drop("_ranks", "_walk", "_closing")


# parts of graphs


def induced(g: Column, keep: Column, cut: Column | None = None) -> Column:
    """The graph of the atoms that stay; a bond that goes leaves hydrogen. ``cut``: an atom that gets a ``*`` in place of one single bond."""

    def built(keep: Column, at: Column, k: Column) -> Column:
        lost = lambda i: _orders(F.filter(g["adj"][i], lambda e: ~keep[e["n"]])) - (F.when(i == cut, 1).otherwise(0) if cut is not None else 0)
        kept = F.filter(_up(F.size(keep)), lambda i: keep[i])
        atoms = F.transform(kept, lambda i: g["atoms"][i].withField("h", (g["atoms"][i]["h"] + lost(i)).cast("int")))
        bonds = lambda i: F.transform(F.filter(g["adj"][i], lambda e: keep[e["n"]]), lambda e: _struct(n=at[e["n"]], o=e["o"]))
        if cut is None:
            return _graph(atoms, F.transform(kept, bonds))
        star = lambda i: F.when(i == cut, F.array(_struct(n=k, o=F.lit(1)))).otherwise(F.array().cast("array<struct<n:int,o:int>>"))
        adj = F.concat(F.transform(kept, lambda i: F.concat(bonds(i), star(i))), F.array(F.array(_struct(n=at[cut], o=F.lit(1)))))
        return _graph(F.concat(atoms, F.array(_struct(el=F.lit("*"), iso=F.lit(0), charge=F.lit(0), h=F.lit(0)))), adj)

    number = lambda keep: F.transform(keep, lambda _, i: F.size(F.filter(F.slice(keep, 1, i), lambda x: x)))
    return let(keep, lambda keep: let(number(keep), lambda at: built(keep, at, F.size(F.filter(keep, lambda x: x)))))


def ring_core(g: Column) -> Column:
    """For each atom whether it is in a ring or on a way between rings: leaves are peeled off until none is left."""
    peel = lambda s: F.transform(s["on"], lambda x, i: x & (F.size(F.filter(g["adj"][i], lambda e: s["on"][e["n"]])) > 1))
    step = lambda s: let(peel(s), lambda t: _struct(on=t, still=t == s["on"]))
    return until(F.size(g["atoms"]), _struct(on=F.transform(g["atoms"], lambda _: F.lit(True)), still=F.lit(False)), lambda s: s["still"], step)["on"]


def scaffold(g: Column) -> Column:
    """the graph of rings and the links between them, with atoms that a double bond holds to it; null without a ring."""
    wider = lambda on: F.transform(on, lambda x, i: x | F.exists(g["adj"][i], lambda e: (e["o"] == 2) & on[e["n"]]))
    return F.when(g.isNotNull(), let(ring_core(g), lambda on: F.when(F.exists(on, lambda x: x), induced(g, wider(on)))))


def side_of(g: Column, a: Column, b: Column) -> Column:
    """For each atom whether it is reached from a without the bond between a and b."""
    grow = lambda s: F.transform(s["on"], lambda x, i: x | F.exists(g["adj"][i], lambda e: s["on"][e["n"]] & ~(((i == b) & (e["n"] == a)) | ((i == a) & (e["n"] == b)))))
    step = lambda s: let(grow(s), lambda t: _struct(on=t, still=t == s["on"]))
    return until(F.size(g["atoms"]), _struct(on=F.transform(g["atoms"], lambda _, i: i == a), still=F.lit(False)), lambda s: s["still"], step)["on"]


def bridges(g: Column) -> Column:
    """Bonds in no ring (a, b, o), with the atoms on the side of a."""
    ends = F.flatten(F.transform(g["adj"], lambda x, i: F.transform(F.filter(x, lambda e: e["n"] > i), lambda e: _struct(a=i, b=e["n"], o=e["o"]))))
    sides = F.transform(ends, lambda e: e.withField("side", side_of(g, e["a"], e["b"])))
    return F.filter(sides, lambda e: ~e["side"][e["b"]])


def cuts(g: Column) -> Column:
    """the two graphs of each cut of a single bond in no ring, ``*`` where the bond was. Nothing for a null graph."""
    part = lambda e, keep, at: induced(g, keep, at)
    within = lambda e: F.transform(e["side"], lambda x, i: x)

    def both(e: Column) -> Column:
        # the other side is what a component of its own has beyond the first; further components go with neither
        return _struct(one=part(e, within(e), e["a"]), other=part(e, side_of(g, e["b"], e["a"]), e["b"]))

    return F.when(g.isNotNull(), F.transform(F.filter(bridges(g), lambda e: e["o"] == 1), both))


def paths(g: Column, most: int) -> Column:
    """the text of every simple path of 1 to ``most`` bonds, read from the end that gives the smaller text; once for each path."""
    longer = lambda p: F.transform(F.filter(g["adj"][F.element_at(p, -1)], lambda e: ~F.array_contains(p, e["n"])), lambda e: F.concat(p, F.array(e["n"])))
    step = lambda s, _: let(F.flatten(F.transform(s["last"], longer)), lambda new: _struct(last=new, all=F.concat(s["all"], new)))
    start = _struct(last=F.transform(_up(F.size(g["atoms"])), lambda i: F.array(i)), all=F.array().cast("array<array<int>>"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["all"]
    order = lambda a, b: F.filter(g["adj"][a], lambda e: e["n"] == b)[0]["o"]
    text = lambda p: F.array_join(F.transform(p, lambda a, k: F.when(k == 0, g["sym"][a]).otherwise(F.concat(F.element_at(F.array(F.lit("-"), F.lit("="), F.lit("#"), F.lit(":")), order(p[k - 1], a)), g["sym"][a]))), "")
    once = F.filter(found, lambda p: p[0] < F.element_at(p, -1))
    return F.when(g.isNotNull(), F.transform(once, lambda p: F.least(text(p), text(F.reverse(p)))))


def path_bits(texts: Column, bits: int = 2048) -> Column:
    """the bits that path texts set, ascending."""
    return F.array_sort(F.array_distinct(F.transform(texts, lambda t: (F.conv(F.substring(F.sha1(t.cast("binary")), 1, 8), 16, 10).cast("long") % bits).cast("int"))))


def descriptors(g: Column) -> Column:
    """F42, the part that needs no fitted table: mass, acceptors (N, O), donors (N, O with hydrogen), rotatable bonds (single, in no
    ring, between atoms with further bonds), rings, charge, heavy atoms. The mass is null where an element isn't in MASSES."""
    el = lambda a: F.initcap(a["el"])
    mass = F.create_map(*(F.lit(x) for kv in MASSES.items() for x in kv))
    mw = F.aggregate(g["atoms"], F.lit(0.0), lambda s, a: s + mass[el(a)] + a["h"] * F.lit(MASSES["H"]))
    count = lambda f: F.size(F.filter(g["atoms"], f))
    polar = lambda a: el(a).isin("N", "O")
    turning = F.size(F.filter(bridges(g), lambda e: (e["o"] == 1) & (F.size(g["adj"][e["a"]]) > 1) & (F.size(g["adj"][e["b"]]) > 1)))
    bonds = F.aggregate(g["adj"], F.lit(0), lambda k, x: k + F.size(x)) / 2
    parts = F.aggregate(_up(F.size(g["atoms"])), F.transform(g["atoms"], lambda _, i: i), lambda c, _: F.transform(c, lambda x, i: F.array_min(F.concat(F.array(x), F.transform(g["adj"][i], lambda e: c[e["n"]])))))
    rings = (bonds - F.size(g["atoms"]) + F.size(F.array_distinct(parts))).cast("int")
    charge = F.aggregate(g["atoms"], F.lit(0), lambda s, a: s + a["charge"])
    out = _struct(mw=F.round(mw, 4), hba=count(polar), hbd=count(lambda a: polar(a) & (a["h"] > 0)), rotatable_bonds=turning, rings=rings, charge=charge, heavy_atoms=count(lambda a: ~el(a).isin("H", "*")))
    return F.when(g.isNotNull(), out)


def passes_structure(g: Column, least: int, most: int, charge: int = 1) -> Column:
    """F49 on a graph: heavy atoms within bounds, only the elements of ORGANIC, a charge of at most ``charge``; False for a null graph."""
    heavy = F.filter(g["atoms"], lambda a: a["el"] != "H")
    total = F.aggregate(g["atoms"], F.lit(0), lambda s, a: s + a["charge"])
    return F.coalesce(F.size(heavy).between(least, most) & F.forall(heavy, lambda a: F.initcap(a["el"]).isin(*ORGANIC)) & (F.abs(total) <= charge), F.lit(False))
