"""Every query against its SQL on the smallest tables; those without SQL for their rows."""

import duckdb
import pytest

from lattisca import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted((tuple(x) for x in plain.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(db.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_queries_run_on_empty_tables(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("simple_graph", "sequences", "radius_count", "tanimoto", "rings", "graph_tensors", "connected_components"):
        assert catalog.queries()[name](spark, str(tmp_path)).count() == 0, name
