"""Every SQL-expressible query against its DuckDB oracle (the driver's gate,
here at sf0.001 to stay quick)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return repr(v)


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


SQL = E.oracle_sql()


def test_every_sql_query_has_a_spark_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    rows, cols = df.collect(), df.columns
    res = duck.sql(SQL[name])
    assert sorted(cols) == sorted(res.columns)
    assert _canon(rows, cols) == _canon(res.fetchall(), res.columns)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["rank", "APT_ICAO", "total", "cumulative_pct"]


def test_cli_lists_every_query(capsys):
    from tarmac.__main__ import main
    main(["--list"])
    names = capsys.readouterr().out.split()
    assert names == list(E.queries())


def test_cli_range_queries(spark):
    from tarmac.__main__ import _range_queries
    from tarmac.plans.prepare import PreparedTraffic
    ranged = _range_queries()
    assert set(ranged) <= set(E.queries())
    f = PreparedTraffic.cached(spark, SF001).features
    fr = {r["day_type"] for r in ranged["daytype_share"](f, "2019-03-01", "2019-03-31", "fr").collect()}
    assert fr == {"Weekend", "Jour de semaine"}
    change = ranged["kpi_change"](f, "2021-12-20", "2022-01-10", "en").first()
    assert change["change_pct"] is None and change["total_ops"] > 0
