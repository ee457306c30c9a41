"""Queries hold rows of all of their table, and links are unescaped."""

import duckdb
from pyspark.sql import functions as F
from tests.conftest import SMALL

from tessera.plans.catalog import ORACLES, QUERIES


def test_every_supplier_has_an_average_precision(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").filter("l_returnflag = 'N'")
    assert QUERIES["average_precision"](spark, SMALL).count() == lines.select("l_suppkey").distinct().count()


def test_components_hold_every_order_and_part(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    ends = lines.select(F.countDistinct("l_orderkey") + F.countDistinct("l_partkey")).first()[0]
    assert QUERIES["component_split"](spark, SMALL).count() == ends


def test_bins_hold_every_order(spark):
    assert QUERIES["component_bins"](spark, SMALL).select("o_orderkey").distinct().count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_few_shots_come_from_all_orders(spark):
    assert QUERIES["few_shot_pick"](spark, SMALL).filter("x % 9 <> 4").count() > 0


def test_links_are_unescaped(spark, tmp_path):
    html = '<a href="/x?a=1&amp;b=2"><b>R&amp;D</b> &lt;1&gt; it&#39;s</a><a class="c" href=\'/y\'>pl&nbsp;ain</a><a href="/x?a=1&amp;b=2">R&amp;D &lt;1&gt; it&#39;s</a>'
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = {(1, "/x?a=1&b=2", "R&D <1> it's", 2), (1, "/y", "pl\u00a0ain", 1)}
    assert {tuple(r) for r in QUERIES["html_links"](spark, str(tmp_path)).collect()} == want
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert set(c.execute(ORACLES["html_links"]).fetchall()) == want
