import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as driver
from threadloom.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def norm(df):
    return sorted(tuple("NULL" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert norm(catalogue.QUERIES[name](spark, D).toPandas()) == norm(duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_components_of_users_beyond_their_hubs(spark, tmp_path):
    users = [None, None, -(2**63), -8, 0, 7, 7, 14, 993, 999, *range(1000, 1008), 1499, 1500, 1500, 40_000, 2**63 - 1]
    duckdb.from_arrow(pa.table({"user_id": pa.array(users, pa.int64())})).write_parquet(str(tmp_path / "events.parquet"))
    sql = catalogue.ORACLE_SQL["graph_components"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")
    made = norm(catalogue.QUERIES["graph_components"](spark, str(tmp_path)).toPandas())
    assert made == norm(duckdb.sql(sql).df())
    assert len(made) > len(set(made))


def test_entry(spark):
    assert driver.entry(spark).count() == 100
    assert set(driver.oracle_sql()) <= set(driver.queries())
