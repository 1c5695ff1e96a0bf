"""The operators' inputs made from the bundled tables, as SQL that both Spark and the oracle run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

SQL = {
    # provider, consumer, kind, ref: keys of the star schema as wires
    "edges": """
      SELECT concat('region:', r_regionkey) AS provider, concat('nation:', n_nationkey) AS consumer, 'Depends' AS kind FROM region JOIN nation ON r_regionkey = n_regionkey
      UNION ALL SELECT concat('nation:', c_nationkey), concat('customer:', c_custkey), 'Import' FROM customer
      UNION ALL SELECT concat('nation:', s_nationkey), concat('supplier:', s_suppkey), 'Import' FROM supplier
      UNION ALL SELECT concat('customer:', o_custkey), concat('order:', o_orderkey), 'Call' FROM orders
      UNION ALL SELECT concat('order:', l_orderkey), concat('part:', l_partkey), 'Documentation' FROM lineitem
      UNION ALL SELECT concat('supplier:', l_suppkey), concat('part:', l_partkey), CASE WHEN l_returnflag = 'R' THEN 'Call' ELSE 'TypeUse' END FROM lineitem""",
    "nodes": """
      SELECT concat('region:', r_regionkey) AS node FROM region UNION ALL SELECT concat('nation:', n_nationkey) FROM nation
      UNION ALL SELECT concat('customer:', c_custkey) FROM customer UNION ALL SELECT concat('supplier:', s_suppkey) FROM supplier
      UNION ALL SELECT concat('order:', o_orderkey) FROM orders UNION ALL SELECT concat('part:', p_partkey) FROM part""",
    # src, dst: customers that lead to each other, wrapping round the whole key space: has cycles, and grows with the table
    "ring": """
      SELECT CAST(c_custkey AS BIGINT) AS src, CAST((c_custkey * 7 + c_nationkey) % (SELECT max(c_custkey) + 1 FROM customer) AS BIGINT) AS dst FROM customer
      UNION SELECT CAST(c_custkey AS BIGINT), CAST((c_custkey + 1 + c_nationkey) % (SELECT max(c_custkey) + 1 FROM customer) AS BIGINT) FROM customer WHERE c_acctbal < 1000""",
    # path, size, tests: addresses as paths
    "paths": r"""
      SELECT path, CAST(max(size) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS tests FROM (
        SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path, length(html) AS size FROM pages) u
      GROUP BY path""",
    # k, path: a file of each part
    "part_paths": """
      SELECT p_partkey AS k, concat('pkg', CAST(floor(p_partkey / 100) AS BIGINT), CASE p_partkey % 7 WHEN 0 THEN '/tests/' WHEN 1 THEN '/src/' WHEN 2 THEN '/docs/' WHEN 3 THEN '/src/deep/' WHEN 4 THEN '/benches/' WHEN 5 THEN '/' ELSE '/examples/' END,
        CASE p_partkey % 13 WHEN 0 THEN 'README.md' WHEN 1 THEN concat('m', p_partkey, '.rs') WHEN 2 THEN concat('test_', p_partkey, '.py') WHEN 3 THEN concat('i', p_partkey, '.PNG') WHEN 4 THEN concat('c', p_partkey, '.toml')
          WHEN 5 THEN 'build.rs' WHEN 6 THEN concat('x', p_partkey, '.spec.ts') WHEN 7 THEN concat('a', p_partkey, '.proto') WHEN 8 THEN concat('o', p_partkey, '.o') WHEN 9 THEN 'Makefile' WHEN 10 THEN concat('n', p_partkey) WHEN 11 THEN concat('s', p_partkey, '.sh') ELSE 'Cargo.lock' END) AS path FROM part""",
    # path: a file tree with manifests, tests and many kinds of names
    "sources": """
      SELECT path FROM part_paths
      UNION SELECT concat('pkg', CAST(floor(s_suppkey / 5) AS BIGINT), CASE WHEN s_suppkey % 3 = 0 THEN '/package.json' ELSE '/Cargo.toml' END) FROM supplier
      UNION SELECT '.github/workflows/ci.yml' UNION SELECT 'pkg3/.github/workflows/ci.yml' UNION SELECT '.ai/tickets/T-1.toml'""",
    # provider, consumer: paths of parts whose keys stand in a tree
    "file_pairs": """
      SELECT DISTINCT a.path AS provider, b.path AS consumer FROM part_paths a JOIN part_paths b ON a.k = floor(b.k / 3) WHERE a.path <> b.path""",
    # kind, name, detail, path, line, key
    "entries": r"""
      SELECT 'Symbol' AS kind, p_name AS name, p_brand AS detail, concat('parts/', replace(p_type, ' ', '/')) AS path, CAST(p_size AS INT) AS line, CAST(p_partkey AS BIGINT) AS key FROM part
      UNION ALL SELECT 'Command', c_name, c_mktsegment, NULL, NULL, c_custkey FROM customer
      UNION ALL SELECT 'Tool', s_name, 'supplier', NULL, NULL, s_suppkey FROM supplier
      UNION ALL SELECT 'Folder', n_name, n_name, concat('nations/', n_name), NULL, CAST(n_nationkey AS BIGINT) FROM nation
      UNION ALL SELECT 'File', regexp_extract(url, '([^/]+)/?$', 1), url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', ''), NULL, page_id FROM pages""",
    # commit, time, pos, path: events as commits, newest first
    "touched": """
      SELECT concat('c', event_id) AS commit, event_id AS time, CAST((SELECT max(event_id) FROM events) - event_id AS BIGINT) AS pos,
        concat('d', user_id, '/', event_type, '/f', event_id % 31) AS path FROM events""",
    # touch, session, time / session, task, time, seq, state
    "touches": "SELECT event_id AS touch, user_id AS session, event_id AS time FROM events WHERE event_type = 'view'",
    "states": """
      SELECT user_id AS session, event_id % 5 AS task, event_id AS time, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS state
      FROM events WHERE event_type = 'click'""",
    # session, log, pos, time, branch, slug, subagent, uuid, started
    "lines": """
      SELECT CAST(floor(conv_id / 3) AS BIGINT) AS session, concat('log', conv_id) AS log, turn AS pos, conv_id * 100 + turn AS time, CASE WHEN turn % 3 = 0 THEN concat('b', (conv_id + turn) % 4) END AS branch,
        CASE WHEN turn % 2 = 1 THEN concat('s', conv_id, '-', turn) END AS slug, conv_id % 3 = 0 AS subagent, CASE WHEN turn < 2 THEN concat('u', CAST(floor(conv_id / 2) AS BIGINT), '-', turn) END AS uuid, conv_id AS started FROM conversations""",
    # id, template: routes from addresses
    "templates": r"""
      SELECT page_id AS id, concat('/', regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1), '/', CAST(floor(page_id / 4) AS BIGINT), '/', CASE page_id % 6 WHEN 0 THEN ':id' WHEN 1 THEN '{page}' WHEN 2 THEN '{*rest}' WHEN 3 THEN 'all' WHEN 4 THEN '{a}-{b}' ELSE 'list?x=1' END,
        CASE WHEN page_id % 10 > 6 THEN '/' ELSE '' END) AS template FROM pages""",
    "rects": """
      SELECT p_partkey AS id, CAST(p_size * 20 AS DOUBLE) AS x0, CAST(p_retailprice AS DOUBLE) AS y0, CAST(p_size * 20 + p_partkey % 90 AS DOUBLE) AS x1, CAST(p_retailprice + p_partkey % 70 AS DOUBLE) AS y1 FROM part""",
    "tickets": """
      SELECT concat('T-', l_orderkey, '.', l_linenumber) AS id, CASE l_linenumber WHEN 1 THEN 'ready' WHEN 2 THEN 'queued' WHEN 3 THEN 'done' ELSE 'draft' END AS status,
        CASE WHEN l_orderkey % 4 > 0 THEN CAST(l_orderkey % 5 AS INT) END AS priority, CASE WHEN l_orderkey % 3 > 0 THEN CAST(l_orderkey % 7 AS INT) END AS "order" FROM lineitem
      GROUP BY l_orderkey, l_linenumber""",
    # source, target, kind, tier, candidates, label, condition, seq
    "links": """
      SELECT concat('s', user_id) AS source, concat('t', event_id % (SELECT max(user_id) + 1 FROM events)) AS target, CASE event_id % 4 WHEN 0 THEN 'Request' ELSE 'Call' END AS kind,
        CASE event_id % 5 WHEN 0 THEN 'Proven' WHEN 1 THEN 'PossibleSet' WHEN 2 THEN 'Observed' ELSE 'Unresolved' END AS tier, CAST(event_id % 3 AS INT) AS candidates,
        event_type AS label, CASE WHEN event_id % 7 > 0 THEN concat('c', event_id % 3) END AS "condition", event_id AS seq, concat('e', event_id % 4) AS evidence FROM events""",
}


#: Inputs that are made from another one.
NEEDS = {"sources": ("part_paths",), "file_pairs": ("part_paths",)}


def _whole(name: str) -> str:
    """The input's SQL with the inputs it needs in its place."""
    sql = SQL[name]
    for other in NEEDS.get(name, ()):
        sql = re.sub(rf"\b(FROM|JOIN) {other}\b", lambda m, o=other: f"{m[1]} ({SQL[o]})", sql)
    return sql


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input of that name over the tables in sf_dir."""
    sql = _whole(name).replace('"', "`").replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_inputs(sql: str, *names: str) -> str:
    """sql behind the inputs of these names as common table expressions."""
    sql, head = sql.strip(), [f"{n} AS ({_whole(n)})" for n in names]
    if sql.startswith("WITH "):
        sql = sql[5:]
        return "WITH RECURSIVE " + ",\n".join([*head, sql])
    return ("WITH RECURSIVE " + ",\n".join(head) + "\n" if head else "") + sql
