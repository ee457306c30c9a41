"""Appends that break and repeat, database files, faulty lines."""

import gzip
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, dedupe
from tessera.sources import appends, databases, lines, readers

SCHEMA = "id long, name string, value double"


def batch(spark, ids):
    return spark.createDataFrame([(i, f'n "{i}", x', i / 2) for i in ids], SCHEMA).repartition(3)


@pytest.mark.parametrize("form", ["json", "csv"])
def test_a_broken_write_counts_once(spark, tmp_path, form):
    t = appends.AppendTable(spark, str(tmp_path / "t"), SCHEMA, "id", form)
    assert t.read().count() == 0
    assert t.append(batch(spark, range(10)), "b1") == 10

    def breaks(rows):
        for k, r in enumerate(rows):
            if k == 5:
                raise RuntimeError("killed")
            yield r

    broken = batch(spark, range(5, 400)).rdd.mapPartitions(breaks).toDF(SCHEMA)
    with pytest.raises(Exception):
        t.append(broken, "b2")
    # what a killed driver leaves: files, but no manifest
    batch(spark, range(5, 9)).write.mode("overwrite").json(str(tmp_path / "t/data/b2"))
    assert t.read().count() == 10
    again = appends.AppendTable(spark, str(tmp_path / "t"), SCHEMA, "id", form)
    assert again.append(batch(spark, [*range(5, 400), 7, 399]), "b2") == 390
    assert again.append(batch(spark, range(5, 400)), "b2") == 0
    assert again.append(batch(spark, range(1000, 1003)), "b3") == 3
    assert again.append(batch(spark, []), "b4") == 0
    assert again.append(batch(spark, range(0, 1003)), "b5") == 600
    got = again.read().collect()
    assert sorted(tuple(r) for r in got) == [(i, f'n "{i}", x', i / 2) for i in range(1003)]
    assert {m["batch"]: m["rows"] for m in again.manifests()} == {"b1": 10, "b2": 390, "b3": 3, "b4": 0, "b5": 600}
    if form == "csv":
        whole = "".join(open(f).read() for f in again.text_files())
        assert whole.startswith("id,name,value\n") and whole.count("id,name,value") == 1 and len(whole.splitlines()) == 1004
    with pytest.raises(ValueError):
        again.append(batch(spark, [1]), "../x")


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "d.sqlite")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE act (id INTEGER, kind TEXT, value REAL, note TEXT)")
    db.executemany("INSERT INTO act VALUES (?, ?, ?, ?)", [(k if k % 50 else None, ("IC50", "Ki", None)[k % 3], k / 4, f"it's {k}") for k in range(1000)])
    db.commit()
    db.close()
    return path


def test_database_file(spark, database):
    df = databases.database_file(spark, database, "SELECT * FROM act WHERE value >= 10", "id long, kind string, value double", "id", 5)
    assert df.rdd.getNumPartitions() == 5
    assert df.count() == 960
    # frames of one source, filtered otherwise, and read in any order
    ki, rest = df.filter("kind = 'Ki' and value < 100"), df.filter("kind is null")
    assert (ki.unionByName(rest).count(), df.count()) == (sum(1 for k in range(40, 1000) if k % 3 == 2 or (k % 3 == 1 and k < 400)), 960)
    where = [("kind", "=", "Ki"), ("value", "<", 100), ("id", "is not null", None), [("note", "like", "%1"), ("id", "in", [49, 52, 1000])]]
    some = databases.database_file(spark, database, "SELECT * FROM act", "id long", "id", 3, where)
    assert sorted(r["id"] for r in some.collect()) == [k for k in range(400) if k % 3 == 1 and k % 50 and (k % 10 == 1 or k in (49, 52))]
    assert databases.database_file(spark, database, "SELECT * FROM act WHERE 0", "id long", "id").count() == 0
    assert databases.database_file(spark, database, "SELECT id, note FROM act", "note string", where=[[]]).count() == 0
    assert databases.database_file(spark, database, "SELECT id, note FROM act", "note string").count() == 1000


def test_conditions_are_bound(database):
    where = '[["kind", "=", "it\'s"], [["id", "in", [1, 2]], ["id", "is null", null]], ["a\\"b", "like", "%x"]]'
    reader = databases.SqliteReader(None, {"path": database, "query": "SELECT * FROM act", "where": where})
    assert reader.where.text == ['"kind" = ?', '("id" IN (?, ?) OR "id" IS NULL)', '"a""b" LIKE ?'] and reader.where.values == ["it's", 1, 2, "%x"]
    with pytest.raises(ValueError):
        databases.sql_condition(("id", "; drop", 1))


def test_rules_as_predicates(spark):
    rows = [(1, "IC50", 1, "In Vitro x"), (2, "ic50", 0, "in vitro"), (3, "Ki", 1, "in vivo"), (4, None, 1, None)]
    df = spark.createDataFrame(rows, "id int, kind string, flag int, note string")
    ids = lambda c: [r["id"] for r in df.filter(c).orderBy("id").collect()]
    assert ids(databases.rule_predicate({"kind": ["IC50"], "flag": [0, 1]}, {"note": ["%vitro%"]})) == [1, 2]
    assert ids(databases.rule_predicate({"kind": []})) == [] and ids(databases.rule_predicate()) == [1, 2, 3, 4]
    assert ids(databases.rule_predicate({"flag": [1]}, either=[F.col("kind") == "Ki", F.col("id") == 4])) == [3, 4]


def test_faulty_json_lines_are_named(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    good = "".join(f'{{"q": {k}}}\n' + ("\n" if k % 7 == 0 else "") for k in range(3000))
    (folder / "a.jsonl").write_text(good)
    (folder / "b.jsonl").write_text('{"q": 1}\n\n{bad\n[1]\n{"q": "x"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # many splits a file
    try:
        rows, faulty = lines.json_objects(spark, str(folder), "q int")
        assert rows.count() == 3001
        assert [(r["path"].rsplit("/", 1)[1], r["line"]) for r in faulty.orderBy("path", "line").collect()] == [("b.jsonl", 3), ("b.jsonl", 4), ("b.jsonl", 5)]
        with pytest.raises(ValueError, match=r"b\.jsonl:3: "):
            lines.strict_json_objects(spark, str(folder), "q int")
        numbers = lines.numbered_lines(spark, str(folder / "a.jsonl")).collect()
        assert [r["value"] for r in sorted(numbers, key=lambda r: r["line"])] == good.split("\n")[:-1] and min(r["line"] for r in numbers) == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert lines.strict_json_objects(spark, str(folder / "a.jsonl"), "q int").count() == 3000


def test_short_lines_are_set_aside(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt", newline="") as f:
        f.write("id\tsmiles\tkey\r\n1\tC\tK\r\n2\tCC\r\n\r\n3\tCCC\tL\tmore\r\n4\t\tM\r\n")
    rows, faulty = lines.plain_table(spark, str(tmp_path / "a.tsv.gz"), columns=["id", "smiles"])
    assert sorted(map(tuple, rows.collect())) == [("1", "C"), ("3", "CCC"), ("4", None)]
    assert [(r["line"], r["value"], r["reason"]) for r in faulty.collect()] == [(3, "2\tCC", "2 fields of 3")]
    with pytest.raises(ValueError):
        lines.plain_table(spark, str(tmp_path / "a.tsv.gz"), columns=["none"])
    (tmp_path / "b.tsv").write_text("other\tsmiles\tkey\n")
    with pytest.raises(ValueError):
        lines.plain_table(spark, str(tmp_path / "*.tsv*"))


def test_missing_files_and_documents(spark, tmp_path):
    assert readers.delimited(spark, str(tmp_path / "none.csv"), columns=["a", "b"], missing_ok=True).columns == ["a", "b"]
    with pytest.raises(Exception):
        readers.delimited(spark, str(tmp_path / "none.csv"), columns=["a"])
    (tmp_path / "s.json").write_text('{"n": 1,\n "m": {"k": [2]}}')
    (tmp_path / "l.json").write_text("[1]")
    assert readers.json_document(spark, str(tmp_path / "s.json")) == {"n": 1, "m": {"k": [2]}}
    assert readers.json_document(spark, str(tmp_path / "l.json")) == readers.json_document(spark, str(tmp_path / "none.json")) == {}


def test_checked_merges_and_lookups(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, s string"), spark.createDataFrame([("y", 2)], "s string, id int")
    dedupe.require_same_schema([a, a])
    with pytest.raises(ValueError, match="part 2"):
        dedupe.require_same_schema([a, b])
    every, exact = audit.branches(spark.createDataFrame([(1, "="), (2, "<"), (3, None)], "id int, r string"), "r")
    assert (every.count(), [x["id"] for x in exact.collect()]) == (3, [1])
    rows = spark.createDataFrame([(1, "p"), (7, "q")], "id int, t string")
    assert audit.looked_up(rows.filter("id = 1"), a, "id").collect() == [(1, "p", "x")]
    with pytest.raises(Exception, match="no id: 7"):
        audit.looked_up(rows, a, "id").collect()
