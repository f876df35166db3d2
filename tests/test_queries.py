"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from vframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        return "nan" if math.isnan(value) else repr(round(float(value), 5) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", ["comb_ratio", "comb_ratio_zero", "mono_reciprocal"])
def test_signed_zeros(spark, tmp_path, name):
    values = "(VALUES (0.0::DOUBLE), ('-0.0'::DOUBLE), (2.0), (-3.0), ('inf'::DOUBLE), ('nan'::DOUBLE), (NULL))"
    columns = "1::BIGINT AS l_partkey, 1 AS l_linenumber, a.x AS l_quantity, b.x AS l_extendedprice, c.x AS l_discount, b.x AS l_tax, 'A' AS l_returnflag"
    connection = duckdb.connect()
    connection.execute(f"CREATE TABLE lineitem AS SELECT row_number() OVER () AS l_orderkey, {columns} FROM {values} a(x), {values} b(x), {values} c(x)")
    connection.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    rows = connection.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in rows)
