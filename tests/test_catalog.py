"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].astype(object).where(lambda x: x.notna(), None)
    d = d.map(lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v))
    return d.sort_values(list(d.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = plain(QUERIES[name](spark, SMALL).toPandas()), plain(duck.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_without_sql(spark):
    assert set(QUERIES) - set(ORACLES) == {"logistic_ranker"}
    assert QUERIES["logistic_ranker"](spark, SMALL).count() >= 1
