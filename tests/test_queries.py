"""The registered queries against their SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from granary.plans import curation, evaluation

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(curation.SQL.keys() | evaluation.SQL.keys()))
def test_matches_sql(spark, duck, name):
    rows = __spark_entry__.queries()[name](spark, SF)
    names = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in rows.collect()), key=repr)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    assert got == sorted((tuple(plain(r[have.index(c)]) for c in names) for r in found.fetchall()), key=repr)


def test_flagship_scans_each_table_twice_at_most(spark):
    plan = __spark_entry__.queries()["flagship_class_distribution"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") <= 4 and plan.count("text#") and plan.count("Window") >= 1  # documents and labels, each twice


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
