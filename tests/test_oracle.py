"""Every query that SQL can tell, beside DuckDB on the smallest tables."""

import duckdb
import pytest

from quillgraph import queries
from quillgraph import queries_records  # noqa: F401  registers its queries with the others

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def folded(df):
    df = df[sorted(df.columns)]
    def plain(x):
        if x is None or x != x:
            return "null"
        return f"{x:.6f}" if isinstance(x, float) else str(x)
    rows = [tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False)]
    return sorted(df.columns), sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert folded(got) == folded(duck.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
