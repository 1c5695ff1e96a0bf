"""Every pipeline operator's query with SQL gives the same rows as DuckDB."""

import math
import os

import pytest

from graphweft.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = db.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want and want


#: What SQL can tell of operators whose other columns it can't: base patterns, and hosts, paths and rules.
PARTS = {
    "op6_secret_scans": r"""
      WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents)
      SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 8)) AS n_assign,
        len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 32)) AS n_hex FROM d""",
    "op10_url_filters": r"""
      WITH u AS (SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
      p AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
      rules AS (SELECT * FROM (VALUES ('net', '/'), ('example.net', '/en/'), ('example.com', '/de/'), ('org', '/fr/')) AS r(h, s)),
      fits AS (SELECT page_id, arg_max(h || s, len(h) + len(s)) AS rule FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
      SELECT page_id, host, path, rule FROM p LEFT JOIN fits USING (page_id)""",
}


@pytest.mark.parametrize("name", sorted(PARTS))
def test_parts_in_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.sql(PARTS[name])
    got = queries.QUERIES[name](spark, SF).select(*found.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(found.fetchall(), key=repr)
