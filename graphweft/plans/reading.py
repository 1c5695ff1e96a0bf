"""Queries over what sources read: their inputs are columns made from the bundled tables, so that no file system is needed."""

from pyspark.sql import functions as F

from graphweft.operators import tickets as K
from graphweft.plans.registry import query
from graphweft.sources import git, manifests, records, settings, tools, tree
from graphweft.storage import new_path
from graphweft.streaming import logs


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'Unreadable' WHEN p_partkey % 5 = 0 THEN 'Image' WHEN p_size * 40000 > 1500000 THEN 'TooLarge' WHEN p_partkey % 3 = 0 THEN 'Binary' ELSE 'Text' END AS kind FROM part"""
)
def file_kinds(spark, sf):
    p = _t(spark, sf, "part").selectExpr("p_partkey", "concat('a/b', p_partkey, if(p_partkey % 5 = 0, '.PNG', '.txt')) path", "p_size * 40000 size", "if(p_partkey % 3 = 0, unhex('410042'), cast('plain' as binary)) head", "if(p_partkey % 11 = 0, 'denied', null) error")
    return p.select("p_partkey", tree.file_kind(*(F.col(c) for c in ("path", "size", "head", "error"))).alias("kind"))


@query("SELECT concat('d', s_suppkey) AS folder, CASE s_suppkey % 4 WHEN 3 THEN concat('m.org/', s_suppkey) ELSE concat('p', s_suppkey) END AS package FROM supplier WHERE s_suppkey % 8 <> 6")
def other_manifests(spark, sf):
    name = "case s_suppkey % 4 when 0 then 'package.json' when 3 then 'go.mod' else 'pyproject.toml' end"
    text = """case when s_suppkey % 8 = 6 then 'x = [' when s_suppkey % 4 = 0 then concat('{"name": "p', s_suppkey, '"}') when s_suppkey % 4 = 1 then concat('[project]\nname = "p', s_suppkey, '"')
      when s_suppkey % 4 = 2 then concat('[tool.poetry]\nname = "p', s_suppkey, '"') else concat('// x\nmodule m.org/', s_suppkey, '\n') end"""
    files = _t(spark, sf, "supplier").selectExpr(f"concat('d', s_suppkey, '/', {name}) path", f"{text} text")
    return manifests.other_packages(files).select(F.regexp_replace("path", "/.*$", "").alias("folder"), "package")


@query("SELECT concat('s', s_suppkey, '.json') AS path, concat('T', s_suppkey) AS title, 'object' AS kind, CAST(1 + s_suppkey % 3 AS INT) AS properties, CASE WHEN s_suppkey % 2 = 0 THEN 'date' ELSE 'uri' END AS formats FROM supplier WHERE s_suppkey % 5 > 0")
def json_schemas(spark, sf):
    files = _t(spark, sf, "supplier").selectExpr(
        "concat('s', s_suppkey, '.json') path",
        """concat('{', if(s_suppkey % 5 > 0, '"$schema": "x", ', ''), '"title": "T', s_suppkey, '", "type": "object", "properties": {"a": {"format": "', if(s_suppkey % 2 = 0, 'date', 'uri'), '"}', if(s_suppkey % 3 > 0, ', "b": {}', ''), if(s_suppkey % 3 > 1, ', "c": {}', ''), '}}') text""",
    )
    return settings.schema_shapes(files).where("error is null").select("path", "title", "kind", F.col("properties").cast("int").alias("properties"), F.array_join("formats", ",").alias("formats"))


@query("SELECT event_id, event_id % 4 = 3 AS bad, CASE WHEN event_id % 4 = 0 THEN concat('u', event_id) END AS uuid, CASE WHEN event_id % 4 < 3 THEN 'user' END AS type FROM events")
def lenient_decode(spark, sf):
    line = """case event_id % 4 when 0 then concat('{"type": "user", "uuid": "u', event_id, '", "message": {"content": "words"}}') when 1 then '{"type": "user", "uuid": null, "message": 7, "timestamp": {"a": 1}}'
      when 2 then '{"type": "user", "message": {"content": [{"type": 5}, "x"]}, "cwd": null}' else '{"type": "us' end"""
    lines = _t(spark, sf, "events").selectExpr("cast(event_id as string) path", "event_id offset", f"{line} line")
    return records.skim(lines).select(F.col("offset").alias("event_id"), "bad", "uuid", "type")


@query(
    """WITH own AS (SELECT arg_min(p_partkey % 3, concat('f', p_partkey)) AS dev FROM part), once AS (SELECT p_partkey % 3 AS dev, p_partkey // 2 AS ino, max(p_size) AS blocks FROM part GROUP BY 1, 2)
    SELECT CAST(sum(blocks * 512) AS BIGINT) AS bytes FROM once JOIN own USING (dev)"""
)
def disk_usage(spark, sf):
    entries = _t(spark, sf, "part").selectExpr("concat('f', p_partkey) path", "p_partkey % 3 dev", "p_partkey div 2 ino", "cast(p_size as long) blocks")
    return tree.disk_usage(entries)


@query("SELECT p_partkey AS module FROM part WHERE p_partkey % 5 < 2")
def lib_or_bin_modules(spark, sf):
    p = _t(spark, sf, "part")
    targets = spark.createDataFrame([("r0", "lib"), ("r1", "bin"), ("r1", "bin"), ("r2", "test"), ("r3", "example"), ("r4", "bench")], "root string, kind string")
    return manifests.in_lib_or_bin(p.selectExpr("p_partkey module", "concat('r', p_partkey % 5) root"), targets).select("module")


@query("SELECT concat('f', p_partkey) AS path, CASE WHEN p_partkey % 3 > 0 THEN '.gitignore' END AS source, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS INT) END AS line FROM part")
def ignored_rules(spark, sf):
    p = _t(spark, sf, "part")
    rules = p.where("p_partkey % 3 > 0").selectExpr("concat('f', p_partkey) path", "'.gitignore' source", "int(p_size) line", "'*.x' pattern")
    return git.with_rules(p.selectExpr("concat('f', p_partkey) path"), rules).select("path", "source", "line")


@query(
    """WITH w AS (SELECT s_suppkey AS package, concat('E', s_suppkey % 7) AS type FROM supplier), c AS (SELECT s_suppkey AS package, s_suppkey AS k, 0 AS hop FROM supplier UNION ALL SELECT s_suppkey, s_suppkey // 2, 1 FROM supplier UNION ALL SELECT s_suppkey, s_suppkey // 4, 2 FROM supplier),
    e AS (SELECT s_suppkey AS k, concat('E', s_suppkey % 5) AS type FROM supplier)
    SELECT package, type, arg_min(k, hop * 1000000 + k) AS found_in FROM w JOIN c USING (package) JOIN e USING (k, type) GROUP BY package, type"""
)
def enum_lookup(spark, sf):
    s = _t(spark, sf, "supplier")
    closure = s.selectExpr("s_suppkey package", "s_suppkey `on`", "0 hop").unionAll(s.selectExpr("s_suppkey", "s_suppkey div 2", "1")).unionAll(s.selectExpr("s_suppkey", "s_suppkey div 4", "2"))
    return tools.find_enums(s.selectExpr("s_suppkey package", "concat('E', s_suppkey % 7) type"), s.selectExpr("s_suppkey package", "concat('E', s_suppkey % 5) enum"), closure)


@query("SELECT n AS name, CAST(count(*) AS BIGINT) AS commits FROM (SELECT DISTINCT event_id, unnest([concat('n', user_id % 30), event_type, concat('n', user_id % 30)]) AS n FROM events WHERE event_id % 3 > 0) e GROUP BY n")
def co_authors(spark, sf):
    commits = _t(spark, sf, "events").selectExpr("cast(event_id as string) commit", "if(event_id % 3 > 0, array(concat('n', user_id % 30), event_type, concat('n', user_id % 30)), array()) co_authors")
    return git.co_author_counts(commits)


@query(
    """SELECT concat('w', c_custkey) AS path, CASE WHEN c_custkey % 5 = 0 THEN 'detached at ' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7) ELSE concat('T-', c_custkey % 40, '/b') END AS label,
      CASE WHEN c_custkey % 5 > 0 AND c_custkey % 2 = 0 THEN CAST(c_custkey % 40 AS BIGINT) END AS ahead, CASE WHEN c_custkey = 0 THEN (SELECT count(*) FROM orders) ELSE 1 END AS commits, coalesce(n, 0) AS changed, coalesce(m, 0) AS sessions,
      CASE WHEN c_custkey % 5 > 0 AND c_custkey % 40 < 20 THEN concat('T-', c_custkey % 40) ELSE '' END AS tickets
    FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a ON a.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.k = c_custkey"""
)
def worktree_rows(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    trees = c.selectExpr("concat('w', c_custkey) path", "md5(cast(c_custkey as string)) head", "if(c_custkey % 5 = 0, null, concat('T-', c_custkey % 40, '/b')) branch", "false is_main")
    branches = spark.range(40).selectExpr("concat('T-', id, '/b') branch", "if(id % 2 = 0, 'origin', null) upstream", "id ahead", "0L behind")
    commits = o.selectExpr("o_orderkey pos", "md5(cast(o_orderkey as string)) commit")
    changes = o.where("o_orderstatus = 'O'").selectExpr("concat('w', o_custkey) worktree", "o_orderpriority kind", "'x' path")
    sessions = o.where("o_orderstatus = 'F'").selectExpr("o_orderkey session", "concat('w', o_custkey) root")
    rows = K.worktree_rows(trees, branches, commits, changes, sessions, spark.range(20).selectExpr("concat('T-', id) id"))
    changed = F.coalesce(F.aggregate("changes", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    return rows.select("path", "label", "ahead", "commits", changed.alias("changed"), "sessions", F.array_join("tickets", ",").alias("tickets"))


@query(
    """WITH e AS (SELECT concat('l', user_id) AS log, concat('c', event_id // 400) AS call_id, event_id AS "at", event_type = 'view' AS is_call, event_id % 3 = 0 AS is_error FROM events WHERE event_type IN ('view', 'click')),
    c AS (SELECT log, call_id, min("at") AS "at" FROM e WHERE is_call GROUP BY ALL), r AS (SELECT log, call_id, arg_min(is_error, "at") AS is_error FROM e WHERE NOT is_call GROUP BY ALL)
    SELECT log, call_id, "at" FROM c JOIN r USING (log, call_id) WHERE NOT is_error"""
)
def pending_call_stream(spark, sf):
    """The stream's answered calls, run over what is there (one batch) into a written table."""
    events = _t(spark, sf, "events")
    found = spark.readStream.schema(events.schema).parquet(f"{sf}/events[.]parquet")
    rows = found.where("event_type in ('view', 'click')").selectExpr("concat('l', user_id) log", "concat('c', event_id div 400) call_id", "'edit' kind", "event_id at", "event_type = 'view' is_call", "event_id % 3 = 0 is_error")
    path = new_path(spark)
    run = logs.pending_calls(rows).writeStream.format("parquet").option("checkpointLocation", new_path(spark)).trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(logs.ANSWERED).parquet(path).select("log", "call_id", "at")
