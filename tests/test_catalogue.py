"""Every query against its SQL at the smallest size; those without SQL must run."""

import glob
import math
import re

import duckdb
import pytest

from vellumine.functions import text
from vellumine.plans import catalogue

DATA = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) and not math.isnan(v) else repr(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    found = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_keywords_of_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert any(r.lang != "en" for r in docs)
    kept = lambda t: [w for w in dict.fromkeys(re.findall(r"[a-z][a-z'-]+", t.lower())) if len(w) >= 3 and w not in text.STOPWORDS][:40]
    got = catalogue.queries()["keywords_all"](spark, DATA).collect()
    assert sorted((r.doc_id, r.keywords) for r in got) == sorted((r.doc_id, ",".join(kept(r.text))) for r in docs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
