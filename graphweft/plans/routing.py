"""Queries over routes, contracts and tickets."""

from pyspark.sql import functions as F

from graphweft.operators import routes as R
from graphweft.operators import tickets as K
from graphweft.plans.adapters import adapted
from graphweft.plans.registry import query

#: canonical form of the adapter's templates, spelled out by their six shapes
CANONICAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(template, '\?.*$', ''), '/$', ''), '/:[a-z]+$', '/{{}}'), '/\{{page\}}$', '/{{}}'), '/\{{\*rest\}}$', '/{{*}}')""".replace("{{", "{").replace("}}", "}")
JOINABLE = "NOT contains(template, '*') AND NOT contains(template, '-')"


@query(f"SELECT id, template, {CANONICAL} AS canonical FROM templates", "templates")
def route_canonical(spark, sf):
    return adapted(spark, sf, "templates").select("id", "template", R.canonical(F.col("template")).alias("canonical"))


@query(f"SELECT id, template FROM templates WHERE {JOINABLE}", "templates")
def route_joinable(spark, sf):
    return adapted(spark, sf, "templates").where(R.joinable(F.col("template")))


@query(f"SELECT id, template, concat('/api', CASE WHEN {CANONICAL} = '/' THEN '' ELSE regexp_replace(regexp_replace(template, '\\?.*$', ''), '/$', '') END) AS nested FROM templates", "templates")
def route_nested(spark, sf):
    return adapted(spark, sf, "templates").select("id", "template", R.nested(F.lit("/api/"), F.col("template")).alias("nested"))


@query(
    f"""WITH c AS (SELECT id, {CANONICAL} AS canonical FROM templates WHERE {JOINABLE})
    SELECT DISTINCT a.id AS a_id, b.id AS b_id, a.canonical FROM c a JOIN c b ON a.canonical = b.canonical """,
    "templates",
)
def route_unify(spark, sf):
    t = adapted(spark, sf, "templates")
    return R.unified(t, t).distinct()


METHOD = "CASE id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END"


@query(
    f"""WITH c AS (SELECT id, template, {CANONICAL} AS canonical, {JOINABLE} AS j, {METHOD} AS method FROM templates),
    met AS (SELECT DISTINCT s.id AS sender, s.method, s.template, r.id AS step, r.id % 4 > 0 AS resolved FROM c s LEFT JOIN c r ON s.j AND r.j AND s.canonical = r.canonical AND (s.method = r.method OR s.method = 'ANY' OR r.method = 'ANY')),
    counted AS (SELECT sender, method, template, count(DISTINCT step) AS n, coalesce(bool_and(resolved), false) AS ok FROM met GROUP BY ALL)
    SELECT sender, method, template, CASE WHEN n > 1 THEN 'PossibleSet' WHEN n = 1 AND ok THEN 'Proven' ELSE 'Unresolved' END AS tier, CAST(n AS INT) AS candidates FROM counted""",
    "templates",
)
def route_sender_links(spark, sf):
    t = adapted(spark, sf, "templates").withColumn("method", F.expr(METHOD))
    routes = t.selectExpr("id step", "method", "template", "id % 4 > 0 resolved")
    return R.sender_links(t.selectExpr("id sender", "method", "template"), routes).drop("steps")


@query(
    """SELECT s_suppkey AS id, m AS method, t AS template FROM supplier, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['GET'] WHEN 1 THEN ['GET', 'POST'] ELSE ['PUT', 'ANY'] END) a(m), unnest(CASE s_suppkey % 2 WHEN 0 THEN ['/a'] ELSE ['/a', '/b/{x}'] END) b(t)"""
)
def tag_alternatives(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return R.alternatives(s.selectExpr("s_suppkey id", "case s_suppkey % 3 when 0 then array('GET') when 1 then array('GET', 'POST') else array('PUT', 'ANY') end methods", "if(s_suppkey % 2 = 0, array('/a'), array('/a', '/b/{x}')) templates"))


@query(
    """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN s_suppkey % 2 = 0 ELSE false END AS agrees FROM supplier"""
)
def handler_tag_agreement(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    tags = s.selectExpr("s_suppkey id", "concat('h', s_suppkey % 3) handler", "array('GET') methods", "if(s_suppkey % 2 = 0, array('/a'), array('/a', '/b/{x}')) templates")
    routes = spark.createDataFrame([("h0", "ANY", "/a/"), ("h0", "GET", "/b/:id"), ("h1", "GET", "/a"), ("h1", "POST", "/b/:id"), ("h2", "POST", "/a")], "handler string, method string, template string")
    return R.handler_agreement(tags, routes)


@query(
    """WITH refs AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'build.rs' WHEN 1 THEN concat('pkg', CAST(floor(p_partkey / 80) AS BIGINT), '/Cargo.toml') ELSE 'src/Makefile' END AS ref FROM part),
    met AS (SELECT ref, path, path = ref AS w FROM refs JOIN sources ON path = ref OR ends_with(path, '/' || ref)),
    g AS (SELECT ref, CASE WHEN bool_or(w) THEN 1 ELSE count(DISTINCT path) END AS n FROM met GROUP BY ref)
    SELECT ref, CASE WHEN n IS NULL THEN 'Unresolved' WHEN n = 1 THEN 'Proven' ELSE 'PossibleSet' END AS tier, CAST(coalesce(n, 0) AS INT) AS candidates FROM refs LEFT JOIN g USING (ref)""",
    "sources",
)
def contract_candidates(spark, sf):
    refs = spark.read.parquet(f"{sf}/part.parquet").selectExpr("case p_partkey % 3 when 0 then 'build.rs' when 1 then concat('pkg', CAST(floor(p_partkey / 80) AS BIGINT), '/Cargo.toml') else 'src/Makefile' end ref")
    return R.contract_candidates(refs, adapted(spark, sf, "sources")).drop("files")


@query("SELECT event_id, json_extract(props, '/k') IS NOT NULL AS has_k, json_extract(props, '/none') IS NOT NULL AS has_none FROM events")
def json_pointer_exists(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", R.pointer_exists(F.col("props"), "/k").alias("has_k"), R.pointer_exists(F.col("props"), "/none").alias("has_none"))


@query(
    r"""SELECT p_partkey, pointer, CAST(CASE pointer WHEN '' THEN 1 WHEN '/a' THEN 1 + p_size % 5 WHEN '/a/x~1y' THEN 1 + p_size % 5 + p_size % 3 WHEN '/c/0' THEN 1 + p_size % 5 + p_size % 3
      WHEN '/c/1' THEN 1 + p_size % 5 + p_size % 3 + p_size % 4 WHEN '/c/1/d' THEN 1 + p_size % 5 + p_size % 3 + p_size % 4 ELSE 0 END AS INT) AS line
    FROM part, (SELECT unnest(['', '/a', '/a/x~1y', '/c/0', '/c/1', '/c/1/d', '/c/2', '/a/b']) AS pointer) p"""
)
def json_pointer_lines(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    breaks = lambda n: F.expr(f"repeat('\n', p_size % {n})")
    text = F.concat(F.lit("{"), breaks(5), F.lit('"a": {'), breaks(3), F.lit('"x/y" : "\\"c\\": ['), F.col("p_name"), F.lit('"}, "c": [1,'), breaks(4), F.lit(' {"d": 2}]}'))
    pointers = F.explode(F.array(*map(F.lit, ("", "/a", "/a/x~1y", "/c/0", "/c/1", "/c/1/d", "/c/2", "/a/b"))))
    return R.pointer_lines(p.select("p_partkey", text.alias("text"), pointers.alias("pointer"))).select("p_partkey", "pointer", "line")


BRANCH = "CASE o_orderkey % 5 WHEN 0 THEN concat('slice/T-', o_orderkey, '.', o_custkey % 7) WHEN 1 THEN concat('T-', o_custkey, '-fix') WHEN 2 THEN concat('XT-', o_orderkey) WHEN 3 THEN concat('T-', o_orderkey, '-', o_custkey) ELSE concat('a-T-', o_custkey, '/T-', o_custkey, '_T-', o_orderkey) END"


@query(
    f"""WITH b AS (SELECT DISTINCT {BRANCH} AS branch, o_orderkey % 5 AS k FROM orders)
    SELECT branch, array_to_string(CASE k WHEN 0 THEN regexp_extract_all(branch, 'T-[0-9]+\\.[0-9]+') WHEN 1 THEN regexp_extract_all(branch, 'T-[0-9]+') WHEN 4 THEN list_filter([regexp_extract(branch, '/(T-[0-9]+)_', 1), CASE WHEN regexp_extract(branch, '_(T-[0-9]+)$', 1) <> regexp_extract(branch, '/(T-[0-9]+)_', 1) THEN regexp_extract(branch, '_(T-[0-9]+)$', 1) END], lambda x: x IS NOT NULL) ELSE [] END, ',') AS ids FROM b"""
)
def branch_ticket_tokens(spark, sf):
    b = spark.read.parquet(f"{sf}/orders.parquet").select(F.expr(BRANCH).alias("branch")).distinct()
    return b.select("branch", F.array_join(K.ids_in(F.col("branch")), ",").alias("ids"))


@query("SELECT DISTINCT concat('T-', o_orderkey, '.1/x') AS branch, concat('T-', o_orderkey, '.1') AS ticket FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)", "tickets")
def branch_ticket_links(spark, sf):
    t = adapted(spark, sf, "tickets")
    branches = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("concat('T-', o_orderkey, '.1/x') branch").distinct()
    return K.branch_tickets(branches, t)


KEY = "CAST(regexp_extract(id, 'T-([0-9]+)', 1) AS BIGINT), CAST(regexp_extract(id, '\\.([0-9]+)$', 1) AS BIGINT)"


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY {KEY}) - 1 AS INT) AS idx FROM tickets", "tickets")
def ticket_id_order(spark, sf):
    return K.position(adapted(spark, sf, "tickets"), K.id_key(F.col("id"))).select("id", "idx")


@query(f"""SELECT id, status, priority, "order" FROM tickets WHERE status IN ('ready', 'queued') ORDER BY status = 'queued', priority NULLS LAST, "order" NULLS LAST, {KEY} LIMIT 25""", "tickets")
def next_tickets(spark, sf):
    return K.next_tickets(adapted(spark, sf, "tickets"), 25)


@query("SELECT status, CAST(count(*) AS BIGINT) AS n FROM tickets GROUP BY status", "tickets")
def ticket_status_counts(spark, sf):
    return K.status_counts(adapted(spark, sf, "tickets"))


SHAS = "SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS commit FROM orders"


@query(
    f"""WITH commits AS ({SHAS}), t AS (SELECT k AS id, CASE k % 3 WHEN 0 THEN substr(commit, 1, 12) WHEN 1 THEN 'abc' ELSE 'zz' || substr(commit, 1, 9) END AS shipped_at FROM commits)
    SELECT id, shipped_at, CASE WHEN (SELECT count(DISTINCT commit) FROM commits c WHERE len(shipped_at) >= 4 AND starts_with(c.commit, shipped_at)) = 1 THEN (SELECT min(commit) FROM commits c WHERE starts_with(c.commit, shipped_at)) END AS commit FROM t"""
)
def confirm_shipped(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    commits = o.selectExpr("o_orderkey k", "concat(md5(cast(o_orderkey as string)), substr(md5(cast(o_custkey as string)), 1, 8)) commit")
    t = commits.selectExpr("k id", "case k % 3 when 0 then substr(commit, 1, 12) when 1 then 'abc' else concat('zz', substr(commit, 1, 9)) end shipped_at")
    return K.confirm_shipped(t, commits)


@query(f"WITH c AS ({SHAS}) SELECT k, len(substr(commit, 1, k % 45)) BETWEEN 4 AND 40 AS is_id, len(substr(commit, 1, k % 45)) = 40 AS is_full FROM c")
def commit_ids(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = o.selectExpr("o_orderkey k", "substr(concat(md5(cast(o_orderkey as string)), substr(md5(cast(o_custkey as string)), 1, 8)), 1, int(o_orderkey % 45)) sha")
    return c.select("k", K.is_commit_id(F.col("sha")).alias("is_id"), K.is_full_id(F.col("sha")).alias("is_full"))
