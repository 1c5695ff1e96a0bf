"""Queries over session logs."""

from pyspark.sql import functions as F

from graphweft.operators import sessions as S
from graphweft.plans.adapters import adapted
from graphweft.plans.registry import query


@query(
    """WITH s AS (SELECT *, lead(time) OVER (PARTITION BY session, task ORDER BY time, seq) AS until FROM states)
    SELECT touch, arg_max(task, s.time * 10 + task) AS task FROM touches t JOIN s ON t.session = s.session AND s.time <= t.time AND (until IS NULL OR t.time < until) AND state = 'in_progress' GROUP BY touch""",
    "touches", "states",
)
def asof_task(spark, sf):
    return S.task_at(adapted(spark, sf, "touches"), adapted(spark, sf, "states"))


@query("SELECT t.touch, s.state FROM touches t ASOF LEFT JOIN states s ON t.session = s.session AND t.time >= s.time", "touches", "states")
def asof_state(spark, sf):
    return S.as_of(adapted(spark, sf, "touches"), adapted(spark, sf, "states"), ["session"], "time", "state").select("touch", "state")


@query(
    """SELECT u.seq AS "update", k.time AS task FROM (SELECT * FROM states WHERE state <> 'pending') u ASOF JOIN (SELECT * FROM states WHERE state = 'pending') k ON u.session = k.session AND u.task = k.task AND u.time >= k.time""",
    "states",
)
def update_target(spark, sf):
    s = adapted(spark, sf, "states")
    updates = s.where("state <> 'pending'").selectExpr("seq as `update`", "session", "task id", "time")
    return S.updated_tasks(updates, s.where("state = 'pending'").selectExpr("time task", "session", "task id", "time created"))


@query(
    """WITH k AS (SELECT event_id // 250 AS log, concat('c', user_id) AS call_id, event_id AS "at", CASE event_id % 4 WHEN 0 THEN 'plan' ELSE 'edit' END AS kind FROM events WHERE event_type = 'view'),
    r AS (SELECT event_id // 250 AS log, concat('c', user_id) AS call_id, event_id AS "at", event_id % 3 = 0 AS is_error FROM events WHERE event_type IN ('click', 'view')),
    g AS (SELECT log, call_id, arg_min(is_error, "at") AS e, max("at") AS m FROM r GROUP BY ALL)
    SELECT k.log, k.call_id, k."at", kind FROM k JOIN g USING (log, call_id) WHERE m >= k."at" AND (kind = 'plan' OR NOT coalesce(e, false))"""
)
def call_result_join(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    calls = e.where("event_type = 'view'").selectExpr("event_id div 250 log", "concat('c', user_id) call_id", "event_id at", "if(event_id % 4 = 0, 'plan', 'edit') kind")
    results = e.where("event_type in ('click', 'view')").selectExpr("event_id div 250 log", "concat('c', user_id) call_id", "event_id at", "event_id % 3 = 0 is_error")
    return S.answered(calls, results).select("log", "call_id", "at", "kind")


ROOTS = "SELECT unnest(['home/a', 'home/a/b', 'work', 'home/abc']) AS root"
LOGS = "SELECT event_id AS log, CASE user_id % 6 WHEN 0 THEN 'home/a' WHEN 1 THEN 'home/a/b/c' WHEN 2 THEN 'home/ab' WHEN 3 THEN 'work/x' WHEN 4 THEN 'home/abc/d' ELSE 'tmp' END AS cwd FROM events"


def _logs(spark, sf):
    cwd = "case user_id % 6 when 0 then 'home/a' when 1 then 'home/a/b/c' when 2 then 'home/ab' when 3 then 'work/x' when 4 then 'home/abc/d' else 'tmp' end cwd"
    roots = spark.createDataFrame([("home/a",), ("home/a/b",), ("work",), ("home/abc",)], "root string")
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id log", cwd, "user_id"), roots


@query(f"WITH roots AS ({ROOTS}), logs AS ({LOGS}) SELECT log, arg_max(root, len(root)) AS root FROM logs JOIN roots ON cwd = root OR starts_with(cwd, root || '/') GROUP BY log")
def longest_root(spark, sf):
    logs, roots = _logs(spark, sf)
    return S.longest_root(logs, roots)


@query(
    f"""WITH roots AS ({ROOTS}), logs AS ({LOGS}), own AS (SELECT log, arg_max(root, len(root)) AS root FROM logs JOIN roots ON cwd = root OR starts_with(cwd, root || '/') GROUP BY log),
    l AS (SELECT log, CASE WHEN log % 3 > 0 THEN log - log % 3 + CASE WHEN log % 5 = 0 THEN 1000000 ELSE 0 END END AS main FROM logs)
    SELECT l.log, CASE WHEN m.log IS NOT NULL THEN mo.root ELSE o.root END AS root FROM l LEFT JOIN own o ON o.log = l.log LEFT JOIN l m ON m.log = l.main LEFT JOIN own mo ON mo.log = l.main
    WHERE CASE WHEN m.log IS NOT NULL THEN mo.root ELSE o.root END IS NOT NULL"""
)
def subagent_follows_main(spark, sf):
    logs, roots = _logs(spark, sf)
    mains = logs.selectExpr("log", "if(log % 3 > 0, log - log % 3 + if(log % 5 = 0, 1000000, 0), null) main")
    return S.follow_main(mains, S.longest_root(logs, roots))


@query(
    f"""WITH roots AS ({ROOTS}), logs AS (SELECT log, concat(cwd, '/f', log % 3, '/g') AS path FROM ({LOGS}) l)
    SELECT array_to_string(string_split(path, '/')[:2], '/') AS folder, CAST(count(*) AS BIGINT) AS n FROM logs WHERE NOT EXISTS (SELECT 1 FROM roots WHERE starts_with(path, root || '/')) GROUP BY 1 ORDER BY n DESC, folder LIMIT 5"""
)
def out_of_scope_top5(spark, sf):
    logs, roots = _logs(spark, sf)
    return S.out_of_scope(logs.selectExpr("concat(cwd, '/f', log % 3, '/g') path"), roots)


@query(
    f"""WITH roots AS ({ROOTS}), l AS (SELECT log // 200 AS log, log AS pos, cwd FROM ({LOGS}) x), inside AS (SELECT * FROM l WHERE EXISTS (SELECT 1 FROM roots WHERE cwd = root OR starts_with(cwd, root || '/')))
    SELECT log, arg_min(cwd, pos) AS cwd, min(pos) AS pos FROM inside GROUP BY log"""
)
def late_membership(spark, sf):
    logs, roots = _logs(spark, sf)
    return S.late_membership(logs.selectExpr("log div 200 log", "log pos", "cwd"), roots)


@query("SELECT session, log, pos, uuid FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY started, log, pos) AS n FROM lines) l WHERE uuid IS NULL OR n = 1", "lines")
def first_seen_dedup(spark, sf):
    return S.first_owner(adapted(spark, sf, "lines"), "uuid").select("session", "log", "pos", "uuid")


@query("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(uuid) - count(DISTINCT uuid) AS BIGINT) AS duplicates FROM lines", "lines")
def duplicate_lines(spark, sf):
    return S.duplicate_lines(adapted(spark, sf, "lines"), "uuid")


@query(
    """WITH b AS (SELECT session, branch, min(time) AS t FROM lines WHERE branch IS NOT NULL GROUP BY ALL), o AS (SELECT session, string_agg(branch, ',' ORDER BY t) AS branches FROM b GROUP BY session)
    SELECT session, min(time) AS first_time, max(time) AS last_time, CAST(count(*) AS BIGINT) AS n_lines, any_value(o.branches) AS branches,
      arg_max(slug, CASE WHEN slug IS NOT NULL THEN time + CASE WHEN subagent THEN 0 ELSE 1000000000 END END) AS slug FROM lines LEFT JOIN o USING (session) GROUP BY session""",
    "lines",
)
def session_summary(spark, sf):
    return S.session_summary(adapted(spark, sf, "lines")).withColumn("branches", F.array_join("branches", ","))


@query("SELECT session, arg_max(slug, time // 3 * 10000000 + pos) AS plan FROM lines WHERE slug IS NOT NULL GROUP BY session", "lines")
def latest_plan(spark, sf):
    plans = adapted(spark, sf, "lines").where("slug is not null").selectExpr("session", "slug plan", "time div 3 time", "'' log", "pos")
    return S.latest_plan(plans)


@query("SELECT event_type AS kind, CAST(count(*) FILTER (user_id % 3 > 0) AS BIGINT) AS main, CAST(count(*) FILTER (user_id % 3 = 0) AS BIGINT) AS subagent FROM events GROUP BY 1")
def touches_by_kind(spark, sf):
    return S.touches_by_kind(spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type kind", "user_id % 3 = 0 subagent"))


@query(
    """WITH t AS (SELECT p_partkey AS touch, p_name AS text, [substr(p_name, 1, 3), CASE WHEN p_partkey % 4 = 0 THEN 'zq' ELSE substr(p_name, 2, 1) END] AS parts FROM part),
    c AS (SELECT touch, list_transform(parts, lambda p: len(list_filter(range(1, len(text) + 1), lambda i: substr(text, i, len(p)) = p))) AS n FROM t)
    SELECT touch, CASE WHEN list_contains(n, 0) THEN 'stale' WHEN list_max(n) > 1 THEN 'candidates' ELSE 'lit' END AS state, CAST(list_sum(n) AS INT) AS count FROM c"""
)
def touch_text_match(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    touches = p.selectExpr("p_partkey touch", "cast(p_partkey as string) path", "array(substr(p_name, 1, 3), if(p_partkey % 4 = 0, 'zq', substr(p_name, 2, 1))) parts")
    return S.match_touch(touches, p.selectExpr("cast(p_partkey as string) path", "p_name text"))


@query(
    """SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 'new' WHEN o_custkey % 3 = 0 THEN 'same' WHEN o_custkey % 3 = 1 THEN 'grown' ELSE 'replaced' END AS change,
    CAST(CASE WHEN o_orderstatus <> 'P' AND o_custkey % 3 < 2 THEN 90 ELSE 0 END AS BIGINT) AS resume FROM orders"""
)
def log_change_state(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    found = o.selectExpr("o_orderkey path", "cast(if(o_custkey % 3 = 0, 100, 150) as long) length", "cast(7 as long) mtime", "if(o_custkey % 3 = 2, 'x', 'h') head")
    known = o.where("o_orderstatus <> 'P'").selectExpr("o_orderkey path", "cast(100 as long) length", "cast(7 as long) mtime", "'h' head", "cast(90 as long) consumed")
    return S.log_changes(found, known)


@query("SELECT DISTINCT c_name AS needle FROM (SELECT substr(c_name, 1, CASE c_custkey % 3 WHEN 0 THEN 14 ELSE 18 END) AS c_name FROM customer) n WHERE NOT EXISTS (SELECT 1 FROM (SELECT substr(c_name, 1, CASE c_custkey % 3 WHEN 0 THEN 14 ELSE 18 END) AS s FROM customer) m WHERE len(s) < len(c_name) AND starts_with(c_name, s))")
def minimal_prefixes(spark, sf):
    return S.minimal_prefixes(spark.read.parquet(f"{sf}/customer.parquet").selectExpr("substr(c_name, 1, if(c_custkey % 3 = 0, 14, 18)) needle"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS INT) AS section, last_value(CASE WHEN l_returnflag = 'R' THEN l_shipdate END IGNORE NULLS) OVER w AS heading
    FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)"""
)
def heading_groups(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    first = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    marked = S.group_by_heading(first, ["l_orderkey"], "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return marked.select("l_orderkey", "l_linenumber", "section", "heading")


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
    m AS (SELECT *, starts_with(line, 'T') AS f FROM l)
    SELECT doc_id, CAST(count(*) FILTER (f OR b % 2 = 1) AS BIGINT) AS fenced FROM (SELECT *, coalesce(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m) x GROUP BY doc_id"""
)
def fence_state(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    marked = d.withColumn("line", F.when(F.col("line").startswith("T"), F.lit("```")).otherwise(F.concat(F.lit("x"), "line")))
    return S.fenced(marked, ["doc_id"], "i").groupBy("doc_id").agg(F.count_if("fenced").alias("fenced"))
