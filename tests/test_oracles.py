"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillmesh import more_queries, oracles, queries

SQL, QUERIES = oracles.oracle_sql() | more_queries.oracle_sql(), queries.queries() | more_queries.queries()

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want))


def test_odd_headings(spark, tmp_path):
    """White space is what the SQL takes for it; depth is no matter."""
    signs = [chr(i) for i in (*range(1, 0x26), *range(0x7F, 0xA2), 0x1680, 0x180E, *range(0x1FFF, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF)]
    pages = [f"<body><h1>{s}a{s} {s}b&nbsp;{s}</h1></body>" for s in signs] + [f"<h1>{s}</h1>" for s in signs] + ["<body>" + "<b>" * 3000 + "<h1>a&am</h1></body>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(map(tuple, QUERIES["page_heading"](spark, str(tmp_path)).collect())) == dict(c.execute(SQL["page_heading"]).fetchall())
