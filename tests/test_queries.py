"""Every registered query of the core against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from maskwright.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_whole_pages_are_escaped(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["escaped"] for r in QUERIES["html_escape"](spark, SF).collect()}
    assert any(len(v) > 300 for v in pages.values())
    assert got == {k: html.escape(v).replace("&#x27;", "&#39;") for k, v in pages.items()}


def test_roundtrip_replaces_names_too(spark, monkeypatch):
    from pyspark.sql import functions as F

    from maskwright.operators import pii

    made, real = [], pii.anonymize
    monkeypatch.setattr(pii, "anonymize", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    assert all(r["is_same"] for r in QUERIES["pii_roundtrip"](spark, SF).collect())
    assert "PERSON" in {r[0] for r in made[0][0].select(F.explode("spans.type")).distinct().collect()}


@pytest.mark.parametrize("name", ["request_dashboard", "request_events", "request_stats"])
def test_requests_carry_their_own_names(spark, monkeypatch, name):
    """What a query moves for a request doesn't grow with the requests before it."""
    from pyspark.sql import functions as F

    from maskwright.operators import requests

    made, real = [], requests.transform_bodies
    monkeypatch.setattr(requests, "transform_bodies", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    assert QUERIES[name](spark, SF).count()
    assert 6 <= made[0].agg(F.max(F.size("mapping"))).first()[0] < 10
