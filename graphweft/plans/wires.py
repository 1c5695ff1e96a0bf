"""Queries over wires and graphs."""

from pyspark.sql import functions as F

from graphweft.operators import edges as E
from graphweft.operators import graph as G
from graphweft.operators import reachability as R
from graphweft.plans.adapters import adapted
from graphweft.plans.registry import query

FLOW = "kind NOT IN ('Documentation', 'Asset')"
KIND_RANK = "list_position(['Import','Call','TypeUse','Implements','Documentation','Asset','Depends'], kind)"
#: container: the table a key belongs to
CONTAINER = "regexp_extract(node, '^([a-z]+)', 1)"


def _container(nodes):
    return nodes.select("node", F.regexp_extract("node", "^([a-z]+)", 1).alias("container"))


@query(
    f"""WITH flow AS (SELECT DISTINCT provider, consumer FROM edges WHERE {FLOW}),
    up(node) AS (SELECT 'nation:3' UNION SELECT provider FROM flow JOIN up ON consumer = node),
    down(node) AS (SELECT 'nation:3' UNION SELECT consumer FROM flow JOIN down ON provider = node)
    SELECT node, 'up' AS direction FROM up UNION ALL SELECT node, 'down' FROM down WHERE node <> 'nation:3'""",
    "edges",
)
def trace_closure(spark, sf):
    start = spark.createDataFrame([("nation:3",)], "node string")
    return G.trace(start, adapted(spark, sf, "edges")).select("node", "direction")


@query(
    f"""WITH flow AS (SELECT DISTINCT provider, consumer, kind FROM edges WHERE {FLOW}),
    up(node) AS (SELECT 'nation:3' UNION SELECT provider FROM flow JOIN up ON consumer = node),
    down(node) AS (SELECT 'nation:3' UNION SELECT consumer FROM flow JOIN down ON provider = node)
    SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT * FROM flow WHERE provider IN (SELECT node FROM up) AND consumer IN (SELECT node FROM up)
      UNION SELECT * FROM flow WHERE provider IN (SELECT node FROM down) AND consumer IN (SELECT node FROM down)) u GROUP BY kind""",
    "edges",
)
def trace_edges(spark, sf):
    e = adapted(spark, sf, "edges")
    traced = G.settle(G.trace(spark.createDataFrame([("nation:3",)], "node string"), e))
    return G.traced_edges(traced, e).select("provider", "consumer", "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM edges WHERE {FLOW} GROUP BY kind", "edges")
def code_flow_kinds(spark, sf):
    return E.code_flow(adapted(spark, sf, "edges")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT provider, consumer FROM edges WHERE {FLOW} AND provider <> consumer", "edges")
def distinct_pairs(spark, sf):
    return E.distinct_pairs(adapted(spark, sf, "edges"))


@query(
    f"""SELECT provider, consumer, arg_min(kind, {KIND_RANK}) AS kind, CASE WHEN bool_or(kind = 'Call') THEN 'Proven' ELSE 'Unresolved' END AS tier
    FROM edges WHERE provider <> consumer GROUP BY provider, consumer""",
    "edges",
)
def file_wires(spark, sf):
    return E.file_wires(adapted(spark, sf, "edges").withColumn("proven", F.col("kind") == "Call"))


@query(
    """WITH calls AS (SELECT DISTINCT src AS provider, src % 3 AS out_port, dst AS consumer, dst % 3 AS in_port, src % 2 = 0 AS proven FROM ring)
    SELECT provider, out_port, consumer, in_port, CASE WHEN bool_or(proven) THEN 'Proven' ELSE 'Unresolved' END AS tier FROM calls
    WHERE NOT (provider = consumer AND out_port = in_port) GROUP BY ALL""",
    "ring",
)
def member_wires(spark, sf):
    r = adapted(spark, sf, "ring")
    return E.member_wires(r.selectExpr("src provider", "src % 3 out_port", "dst consumer", "dst % 3 in_port", "src % 2 = 0 proven"))


@query(
    r"""WITH bare AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS source, html FROM pages),
    links AS (SELECT source, concat(regexp_extract(source, '^([^/]*)', 1), unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS target FROM bare)
    SELECT DISTINCT target AS provider, source AS consumer, 'Documentation' AS kind, 'Proven' AS tier, 'DocLink' AS basis FROM links
    WHERE target IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM paths) AND source <> target""",
    "paths",
)
def link_wires(spark, sf):
    bare = F.expr("regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(bare.alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    links = pages.select("source", F.concat(F.substring_index("source", "/", 1), "href").alias("target"))
    return E.link_wires(links, adapted(spark, sf, "paths").select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct())


@query(
    """SELECT concat('s', l_suppkey) AS provider, concat('p', l_partkey) AS consumer, CAST(min(l_orderkey) AS BIGINT) AS line, 'Depends' AS edge_kind, 'Manifest' AS basis
    FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_suppkey, l_partkey"""
)
def manifest_wires(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    deps = li.selectExpr("concat('s', l_suppkey) provider", "concat('p', l_partkey) consumer", "if(l_returnflag = 'A', 'dev', 'normal') kind", "l_orderkey line")
    return E.manifest_wires(deps)


@query(
    """WITH names AS (SELECT 'module' AS source, r_name AS key, concat('r', r_regionkey) AS node, r_regionkey AS o FROM region
      UNION ALL SELECT 'symbol', n_name, concat('n', n_nationkey), n_nationkey FROM nation UNION ALL SELECT 'file', s_name, concat('s', s_suppkey), s_suppkey FROM supplier),
    last AS (SELECT source, key, arg_max(node, o) AS node FROM names GROUP BY 1, 2),
    targets AS (SELECT r_name AS target FROM region UNION SELECT concat('./', n_name, '.js') FROM nation UNION SELECT concat('x/', s_name, '.py') FROM supplier UNION SELECT s_name FROM supplier UNION SELECT 'none'),
    cleaned AS (SELECT target, regexp_replace(regexp_replace(regexp_replace(target, '^\\./', ''), '\\.js$', ''), '\\.py$', '') AS c FROM targets),
    probes AS (SELECT target, c, regexp_extract(regexp_extract(c, '([^/]*)$', 1), '^([^.]*)', 1) AS stem FROM cleaned),
    tried AS (
      SELECT target, 0 AS lookup, 'module' AS source, target AS key FROM probes UNION ALL SELECT target, 1, 'symbol', target FROM probes UNION ALL SELECT target, 2, 'file', target FROM probes
      UNION ALL SELECT target, 3, 'file', c FROM probes UNION ALL SELECT target, 4, 'file', stem FROM probes UNION ALL SELECT target, 5, 'symbol', stem FROM probes UNION ALL SELECT target, 6, 'module', stem FROM probes)
    SELECT target, arg_min(node, lookup) AS node, CAST(min(lookup) AS INT) AS lookup FROM tried JOIN last USING (source, key) GROUP BY target""".replace("\\\\", "\\")
)
def name_lookup(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    names = t("region").selectExpr("'module' source", "r_name key", "concat('r', r_regionkey) node", "cast(r_regionkey as long) scan_order")
    names = names.unionAll(t("nation").selectExpr("'symbol'", "n_name", "concat('n', n_nationkey)", "cast(n_nationkey as long)")).unionAll(t("supplier").selectExpr("'file'", "s_name", "concat('s', s_suppkey)", "s_suppkey"))
    targets = t("region").selectExpr("r_name target").union(t("nation").selectExpr("concat('./', n_name, '.js')")).union(t("supplier").selectExpr("concat('x/', s_name, '.py')")).union(t("supplier").selectExpr("s_name")).union(spark.createDataFrame([("none",)], "target string"))
    return E.resolve_files(targets, names)


@query(
    """WITH last AS (SELECT p_brand AS key, arg_max(concat('m', p_partkey), p_partkey) AS member FROM part GROUP BY 1),
    targets AS (SELECT DISTINCT concat('x::', p_brand) AS target FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT n_name FROM nation)
    SELECT target, member, CASE WHEN member IS NULL THEN concat('f:', n_name) END AS file FROM targets LEFT JOIN last ON key = regexp_extract(target, '([^.:]+)$', 1)
    LEFT JOIN nation ON n_name = target WHERE member IS NOT NULL OR n_name IS NOT NULL"""
)
def member_lookup(spark, sf):
    part, nation = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    members = part.selectExpr("p_brand key", "concat('m', p_partkey) node", "p_partkey scan_order")
    targets = part.selectExpr("concat('x::', p_brand) target").union(part.select("p_brand")).union(nation.select("n_name"))
    return E.resolve_members(targets, members, nation.selectExpr("n_name target", "concat('f:', n_name) node"))


@query(
    """WITH p AS (SELECT o_orderkey AS ref, CASE WHEN o_orderkey % 4 = 0 THEN 'external' WHEN o_orderkey % 7 = 0 THEN 'unresolved' ELSE 'item' END AS tag, o_custkey % 10 AS target FROM orders WHERE o_orderstatus <> 'F'),
    g AS (SELECT o_orderkey AS ref, o_custkey % 5 AS target FROM orders WHERE o_orderpriority > '2')
    SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN tag = 'item' AND p.target = g.target THEN 'upgraded' WHEN tag = 'item' AND g.target IS NOT NULL THEN 'retargeted' WHEN tag = 'item' THEN 'added'
      WHEN tag = 'external' AND g.target IS NOT NULL THEN 'dropped' WHEN tag = 'external' THEN 'external' ELSE 'unresolved' END AS outcome FROM p FULL JOIN g USING (ref)) u GROUP BY outcome"""
)
def edge_reconcile(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    proven = o.where("o_orderstatus <> 'F'").selectExpr("o_orderkey ref", "case when o_orderkey % 4 = 0 then 'external' when o_orderkey % 7 = 0 then 'unresolved' else 'item' end tag", "o_custkey % 10 target")
    return E.reconcile(proven, o.where("o_orderpriority > '2'").selectExpr("o_orderkey ref", "o_custkey % 5 target")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT node, CAST(coalesce(i, 0) AS BIGINT) AS n_in, CAST(coalesce(o, 0) AS BIGINT) AS n_out FROM nodes
    LEFT JOIN (SELECT consumer AS node, count(*) AS i FROM edges GROUP BY 1) a USING (node) LEFT JOIN (SELECT provider AS node, count(*) AS o FROM edges GROUP BY 1) b USING (node)""",
    "nodes", "edges",
)
def node_degrees(spark, sf):
    return E.degrees(adapted(spark, sf, "nodes"), adapted(spark, sf, "edges"))


@query("SELECT node FROM nodes WHERE node NOT IN (SELECT provider FROM edges WHERE kind = 'Call') AND node NOT IN (SELECT consumer FROM edges WHERE kind = 'Call')", "nodes", "edges")
def isolated_nodes(spark, sf):
    return E.degrees(adapted(spark, sf, "nodes"), adapted(spark, sf, "edges").where("kind = 'Call'")).where("n_in = 0 and n_out = 0").select("node")


@query(
    "SELECT provider, consumer, " + ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS {k}" for k in ("Import", "Call", "TypeUse", "Implements", "Documentation", "Asset", "Depends")) + " FROM edges GROUP BY 1, 2",
    "edges",
)
def pair_kinds_pivot(spark, sf):
    return E.pair_kinds(adapted(spark, sf, "edges"))


@query(
    f"""WITH met AS (SELECT regexp_extract(provider, '^([a-z]+)', 1) AS from_end, regexp_extract(consumer, '^([a-z]+)', 1) AS to_end, provider, consumer, kind FROM edges),
    by_kind AS (SELECT from_end, to_end, kind, count(*) AS n, {KIND_RANK} AS r FROM met WHERE from_end <> to_end GROUP BY ALL)
    SELECT from_end, to_end, CAST(sum(n) AS BIGINT) AS wires, arg_max(kind, n * 10 - r) AS main_kind,
      (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT provider, consumer FROM met m WHERE m.from_end = b.from_end AND m.to_end = b.to_end) d) AS pairs FROM by_kind b GROUP BY from_end, to_end""",
    "edges",
)
def wire_bundles(spark, sf):
    return E.bundles(adapted(spark, sf, "edges"), adapted(spark, sf, "nodes").select("node", F.regexp_extract("node", "^([a-z]+)", 1).alias("shown")))


HUB_PAIRS = "SELECT DISTINCT concat('i', CASE WHEN src % 5 < 4 THEN 0 ELSE src END) AS provider, concat('i', dst) AS consumer FROM ring"


@query(
    f"""WITH pairs AS ({HUB_PAIRS}), inside AS (SELECT DISTINCT provider, consumer FROM pairs WHERE provider <> consumer),
    connected AS (SELECT count(*) AS c FROM (SELECT provider FROM inside UNION SELECT consumer FROM inside) u)
    SELECT 'all' AS container, provider AS item, CAST(count(*) AS BIGINT) AS consumers FROM inside GROUP BY provider HAVING count(*) >= 8 AND 2 * count(*) >= (SELECT c FROM connected) - 1""",
    "ring",
)
def hub_items(spark, sf):
    pairs, container = _hub_inputs(spark, sf)
    return E.hubs(pairs, container)


def _hub_inputs(spark, sf):
    pairs = adapted(spark, sf, "ring").selectExpr("concat('i', if(src % 5 < 4, 0, src)) provider", "concat('i', dst) consumer").distinct()
    return pairs, pairs.select(F.col("provider").alias("node")).union(pairs.select("consumer")).distinct().withColumn("container", F.lit("all"))


@query(
    f"""WITH pairs AS ({HUB_PAIRS}), used AS (SELECT provider, count(DISTINCT consumer) AS n FROM pairs WHERE provider <> consumer GROUP BY 1)
    SELECT provider, consumer FROM pairs WHERE provider NOT IN (SELECT provider FROM used WHERE n >= 5)""",
    "ring",
)
def pairs_without_hubs(spark, sf):
    pairs, container = _hub_inputs(spark, sf)
    used = pairs.where("provider <> consumer").groupBy(F.col("provider").alias("item")).agg(F.count_distinct("consumer").alias("n")).where("n >= 5")
    return E.without_hubs(pairs, used)


LINK_SQL = """WITH ranked AS (SELECT *, CASE tier WHEN 'Proven' THEN 0 WHEN 'PossibleSet' THEN 1 WHEN 'Observed' THEN 2 ELSE 3 END * 1000 + candidates AS r FROM links),
    best AS (SELECT source, target, kind, min(r) AS r, array_to_string(list_sort(list_distinct(list(evidence))), ',') AS evidence FROM ranked GROUP BY ALL)
    SELECT b.source, b.target, b.kind, CASE b.r // 1000 WHEN 0 THEN 'Proven' WHEN 1 THEN 'PossibleSet' WHEN 2 THEN 'Observed' ELSE 'Unresolved' END AS tier, CAST(b.r % 1000 AS INT) AS candidates,
      arg_min(label, seq) AS label, CASE WHEN bool_or("condition" IS NULL) THEN NULL ELSE array_to_string(list_sort(list_distinct(list("condition"))), ' || ') END AS "condition", any_value(b.evidence) AS evidence
    FROM best b JOIN ranked l ON b.source = l.source AND b.target = l.target AND b.kind = l.kind AND b.r = l.r GROUP BY b.source, b.target, b.kind, b.r"""


@query(LINK_SQL, "links")
def link_merge(spark, sf):
    merged = E.merge_links(adapted(spark, sf, "links").withColumn("evidence", F.array("evidence")))
    return merged.withColumn("evidence", F.array_join("evidence", ","))


@query(
    """SELECT source, CASE min(CASE tier WHEN 'Proven' THEN 0 WHEN 'PossibleSet' THEN 1 WHEN 'Observed' THEN 2 ELSE 3 END) WHEN 0 THEN 'Proven' WHEN 1 THEN 'PossibleSet' WHEN 2 THEN 'Observed' ELSE 'Unresolved' END AS tier
    FROM links GROUP BY source""",
    "links",
)
def strongest_tier(spark, sf):
    return adapted(spark, sf, "links").groupBy("source").agg(E.strongest(F.col("tier")).alias("tier"))


@query(
    """SELECT CAST(count(*) AS BIGINT) AS links, CAST(count(*) FILTER (tier = 'Proven') AS BIGINT) AS proven, CAST(count(*) FILTER (tier = 'PossibleSet') AS BIGINT) AS possible,
    CAST(count(*) FILTER (tier = 'Unresolved') AS BIGINT) AS unresolved, CAST(count(*) FILTER (source <> target AND kind = 'Request') AS BIGINT) AS crossings FROM links""",
    "links",
)
def pipeline_stats(spark, sf):
    return E.pipeline_stats(adapted(spark, sf, "links"))


@query("SELECT label, CAST(count(*) AS BIGINT) AS n FROM links WHERE tier = 'Unresolved' GROUP BY label", "links")
def unresolved_reasons(spark, sf):
    return E.unresolved_reasons(adapted(spark, sf, "links"))


@query(
    """WITH a AS (SELECT p_brand, p_size FROM part WHERE p_size > 10), b AS (SELECT p_brand, p_size FROM part WHERE p_size < 40)
    SELECT *, 'a' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y"""
)
def graph_diff(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return E.differences(p.where("p_size > 10").select("p_brand", "p_size"), p.where("p_size < 40").select("p_brand", "p_size"))


PORTS = """SELECT DISTINCT src AS node, src % 4 AS port, CASE WHEN src % 2 = 0 THEN 'out' ELSE 'in' END AS direction, CASE src % 3 WHEN 0 THEN 'Any' WHEN 1 THEN 'Int' ELSE 'Text' END AS data_type FROM ring"""
ASKED = "SELECT src * 1000000000 + dst AS id, src AS node_a, src % 4 AS port_a, dst AS node_b, dst % 4 AS port_b FROM ring"


@query(
    f"""WITH ports AS ({PORTS}), asked AS ({ASKED}), wires AS (SELECT DISTINCT src AS out_node, src % 4 AS out_port, dst AS in_node, dst % 4 AS in_port FROM ring WHERE src < dst),
    met AS (SELECT q.*, a.direction AS da, b.direction AS db, a.data_type AS ta, b.data_type AS tb, coalesce(a.direction = 'in' AND b.direction = 'out', false) AS flip FROM asked q
      LEFT JOIN ports a ON a.node = node_a AND a.port = port_a LEFT JOIN ports b ON b.node = node_b AND b.port = port_b),
    put AS (SELECT *, CASE WHEN flip THEN node_b ELSE node_a END AS on_, CASE WHEN flip THEN port_b ELSE port_a END AS op, CASE WHEN flip THEN node_a ELSE node_b END AS in_, CASE WHEN flip THEN port_a ELSE port_b END AS ip FROM met)
    SELECT id, CASE WHEN node_a = node_b THEN 'self' WHEN da IS NULL OR db IS NULL THEN 'missing port' WHEN da = db THEN 'direction' WHEN NOT (ta = tb OR ta = 'Any' OR tb = 'Any') THEN 'type'
      WHEN EXISTS (SELECT 1 FROM wires w WHERE w.out_node = on_ AND w.out_port = op AND w.in_node = in_ AND w.in_port = ip) THEN 'duplicate' END AS error FROM put""",
    "ring",
)
def connection_check(spark, sf):
    asked, ports, wires = _connections(spark, sf)
    return E.connection_errors(asked, ports, wires).select("id", "error")


def _connections(spark, sf):
    r = adapted(spark, sf, "ring")
    ports = r.selectExpr("src node", "src % 4 port", "if(src % 2 = 0, 'out', 'in') direction", "case src % 3 when 0 then 'Any' when 1 then 'Int' else 'Text' end data_type").distinct()
    asked = r.selectExpr("src * 1000000000 + dst id", "src node_a", "src % 4 port_a", "dst node_b", "dst % 4 port_b")
    return asked, ports, r.where("src < dst").selectExpr("src out_node", "src % 4 out_port", "dst in_node", "dst % 4 in_port")


@query(
    f"""WITH ports AS ({PORTS}), asked AS ({ASKED}), wires AS (SELECT DISTINCT src AS out_node, src % 4 AS out_port, dst AS in_node, dst % 4 AS in_port FROM ring WHERE src < dst),
    met AS (SELECT q.*, a.direction AS da, b.direction AS db, a.data_type AS ta, b.data_type AS tb, coalesce(a.direction = 'in' AND b.direction = 'out', false) AS flip FROM asked q
      LEFT JOIN ports a ON a.node = node_a AND a.port = port_a LEFT JOIN ports b ON b.node = node_b AND b.port = port_b),
    put AS (SELECT *, CASE WHEN flip THEN node_b ELSE node_a END AS on_, CASE WHEN flip THEN port_b ELSE port_a END AS op, CASE WHEN flip THEN node_a ELSE node_b END AS in_, CASE WHEN flip THEN port_a ELSE port_b END AS ip FROM met)
    SELECT on_ AS out_node, op AS out_port, in_ AS in_node, ip AS in_port, 'Unresolved' AS tier FROM put WHERE (CASE WHEN node_a = node_b THEN 'self' WHEN da IS NULL OR db IS NULL THEN 'missing port' WHEN da = db THEN 'direction' WHEN NOT (ta = tb OR ta = 'Any' OR tb = 'Any') THEN 'type'
      WHEN EXISTS (SELECT 1 FROM wires w WHERE w.out_node = on_ AND w.out_port = op AND w.in_node = in_ AND w.in_port = ip) THEN 'duplicate' END) IS NULL
    UNION SELECT out_node, out_port, in_node, in_port, 'Proven' FROM wires""",
    "ring",
)
def connected_wires(spark, sf):
    asked, ports, wires = _connections(spark, sf)
    return E.connect(wires.distinct().selectExpr("*", "'Proven' tier", "'Manifest' basis"), asked, ports).drop("basis")


@query("SELECT provider, consumer, kind FROM edges WHERE provider NOT LIKE 'supplier:%' AND consumer NOT LIKE 'supplier:%'", "edges")
def node_removal(spark, sf):
    n, e = adapted(spark, sf, "nodes"), adapted(spark, sf, "edges")
    return E.remove_nodes(n, e, n.where("node like 'supplier:%'"))[1].select("provider", "consumer", "kind")


@query(
    """WITH walk(a, b) AS (SELECT src, dst FROM ring UNION SELECT a, dst FROM walk JOIN ring ON b = src),
    n AS (SELECT src AS node FROM ring UNION SELECT dst FROM ring)
    SELECT node, least(node, coalesce((SELECT min(w.b) FROM walk w JOIN walk v ON v.a = w.b AND v.b = w.a WHERE w.a = node), node)) AS component FROM n""",
    "ring",
)
def scc_groups(spark, sf):
    return G.strong_components(adapted(spark, sf, "ring"))


@query(
    """WITH inside AS (SELECT src, dst FROM ring WHERE src % 2 = dst % 2), walk(a, b) AS (SELECT src, dst FROM inside UNION SELECT a, dst FROM walk JOIN inside ON b = src),
    n AS (SELECT src AS node FROM inside UNION SELECT dst FROM inside),
    g AS (SELECT node, least(node, coalesce((SELECT min(w.b) FROM walk w JOIN walk v ON v.a = w.b AND v.b = w.a WHERE w.a = node), node)) AS box FROM n)
    SELECT node % 2 AS container, box, node FROM g WHERE box IN (SELECT box FROM g GROUP BY box HAVING count(*) > 1)""",
    "ring",
)
def cycle_boxes(spark, sf):
    r = adapted(spark, sf, "ring")
    parent = r.select(F.col("src").alias("node")).union(r.select("dst")).distinct().withColumn("container", F.col("node") % 2)
    return G.cycle_boxes(r, parent)


@query()
def acyclic_order(spark, sf):
    """Passes over what is left: tested against a plain version. Containers are folders of a hundred keys."""
    r = adapted(spark, sf, "ring").where("src div 100 = dst div 100")
    return G.acyclic_order(r.selectExpr("cast(src div 100 as string) container", "cast(src as string) src", "cast(dst as string) dst"))


@query(
    """WITH dag AS (SELECT DISTINCT src, dst FROM ring WHERE src < dst), walk(node, layer) AS (SELECT src, 0 FROM dag UNION SELECT dst, 0 FROM dag UNION SELECT dst, layer + 1 FROM walk JOIN dag ON node = src)
    SELECT node, max(layer) AS layer FROM walk GROUP BY node""",
    "ring",
)
def layering(spark, sf):
    return G.longest_layers(adapted(spark, sf, "ring").where("src < dst"))


FLOW_SQL = """WITH usable AS (SELECT DISTINCT source, target, kind FROM links WHERE tier IN ('Proven', 'PossibleSet')),
    chain AS (SELECT DISTINCT source AS src, replace(target, 't', 's') AS dst FROM usable WHERE kind <> 'Request'),
    entries AS (SELECT DISTINCT source AS flow, source AS step FROM usable WHERE kind <> 'Request'),
    walk(flow, step, layer) AS (SELECT flow, step, 0 FROM entries UNION SELECT flow, dst, layer + 1 FROM walk JOIN chain ON step = src WHERE layer < 11),
    reached AS (SELECT flow, step, min(layer) AS layer FROM walk GROUP BY 1, 2),
    senders AS (SELECT DISTINCT e.flow, u.source AS step FROM entries e JOIN usable u ON u.kind = 'Request' AND replace(u.target, 't', 's') = e.step WHERE u.source <> e.step),
    every AS (SELECT flow, step, 0 AS layer, false AS entry FROM senders UNION ALL SELECT flow, step, layer, layer = 0 FROM reached r WHERE NOT EXISTS (SELECT 1 FROM senders s WHERE s.flow = r.flow AND s.step = r.step)),
    placed AS (SELECT flow, layer, step, CAST(row_number() OVER (PARTITION BY flow ORDER BY layer, entry, step) - 1 AS INT) AS pos FROM every)"""


def _flow_inputs(spark, sf):
    links = adapted(spark, sf, "links").withColumn("target", F.replace("target", F.lit("t"), F.lit("s")))
    entries = links.where("tier in ('Proven', 'PossibleSet') and kind <> 'Request'").selectExpr("source flow", "source step").distinct()
    return entries, links


@query(FLOW_SQL + " SELECT flow, layer, pos, step FROM placed WHERE layer < 12 AND pos < 400", "links")
def flow_layers(spark, sf):
    return G.flow_layers(*_flow_inputs(spark, sf)).select("flow", "layer", "pos", "step")


@query(FLOW_SQL.replace("WHERE layer < 11", "WHERE layer < 40") + " SELECT flow, CAST(count(*) FILTER (layer < 2 AND pos < 5) AS BIGINT) AS kept, CAST(count(*) FILTER (layer >= 2 OR pos >= 5) AS BIGINT) AS truncated FROM placed GROUP BY flow", "links")
def flow_truncated(spark, sf):
    return G.flow_truncated(*_flow_inputs(spark, sf), layers=2, steps=5)


@query(
    """WITH waves(node) AS (SELECT src FROM ring WHERE src NOT IN (SELECT dst FROM ring) UNION SELECT dst FROM waves JOIN ring ON node = src) SELECT node FROM waves""",
    "ring",
)
def call_waves(spark, sf):
    r = adapted(spark, sf, "ring")
    entries = r.select("src").distinct().join(r.select(F.col("dst").alias("src")), "src", "left_anti")
    return G.reach(entries.selectExpr("0 root", "src node"), r).select("node")


@query(
    """WITH down(node, hop) AS (SELECT 0, 0 UNION ALL SELECT dst, hop + 1 FROM down JOIN (SELECT DISTINCT p_partkey // 4 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0) d ON node = src WHERE hop < 64)
    SELECT node, hop FROM down WHERE node > 0"""
)
def module_tree(spark, sf):
    tree = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey > 0").selectExpr("p_partkey div 4 src", "p_partkey dst")
    return G.reach(spark.createDataFrame([(0, 0)], "root long, node long"), tree, most=64).where("node > 0").select("node", "hop")


@query("SELECT path FROM paths WHERE path LIKE (SELECT min(regexp_extract(path, '^([^/]*)', 1)) FROM paths) || '/%'", "paths")
def folder_descendants(spark, sf):
    p = adapted(spark, sf, "paths")
    first = p.agg(F.min(F.substring_index("path", "/", 1))).first()[0] or ""
    return G.descendants(p, first).select("path")


@query("SELECT path FROM sources WHERE path LIKE 'pkg1/src/%' OR path LIKE 'pkg2/%'", "sources")
def hidden_set(spark, sf):
    return G.hidden(adapted(spark, sf, "sources"), spark.createDataFrame([("pkg1/src",), ("pkg2",)], "path string"))


@query(
    f"""WITH chains AS (SELECT *, list_concat([''], list_transform(range(1, len(string_split(provider, '/')) + 1), lambda i: array_to_string(string_split(provider, '/')[:i], '/'))) AS a,
      list_concat([''], list_transform(range(1, len(string_split(consumer, '/')) + 1), lambda i: array_to_string(string_split(consumer, '/')[:i], '/'))) AS b FROM file_pairs),
    cut AS (SELECT *, CAST(len(list_intersect(a, b)) AS BIGINT) AS n FROM chains)
    SELECT DISTINCT * FROM (SELECT a[n] AS container, a[n + 1] AS from_item, b[n + 1] AS to_item FROM cut
      UNION ALL SELECT a[i], a[i + 1], '^' FROM cut, range(1, 12) t(i) WHERE i > n AND i < len(a) UNION ALL SELECT b[i], '^', b[i + 1] FROM cut, range(1, 12) t(i) WHERE i > n AND i < len(b)) u""",
    "file_pairs",
)
def wire_lifting(spark, sf):
    return G.lifted(adapted(spark, sf, "file_pairs"))


@query(
    f"""WITH c AS (SELECT *, list_intersect(list_concat([''], list_transform(range(1, len(string_split(provider, '/'))), lambda i: array_to_string(string_split(provider, '/')[:i], '/'))),
      list_concat([''], list_transform(range(1, len(string_split(consumer, '/'))), lambda i: array_to_string(string_split(consumer, '/')[:i], '/')))) AS s FROM file_pairs)
    SELECT provider, consumer, list_sort(s)[-1] AS common FROM c""",
    "file_pairs",
)
def lowest_common_folder(spark, sf):
    return adapted(spark, sf, "file_pairs").select("provider", "consumer", G.lowest_common("provider", "consumer").alias("common"))


@query(
    f"""SELECT DISTINCT regexp_extract(consumer, '^([^/]*)', 1) AS folder, provider FROM file_pairs WHERE regexp_extract(provider, '^([^/]*)', 1) <> regexp_extract(consumer, '^([^/]*)', 1)""",
    "file_pairs",
)
def gate_keys(spark, sf):
    return G.gates(adapted(spark, sf, "file_pairs"))


@query("SELECT CASE WHEN kind IN ('Call', 'Import') THEN kind ELSE 'other' END AS kind, CAST(count(DISTINCT provider) AS BIGINT) AS providers, CAST(count(DISTINCT consumer) AS BIGINT) AS consumers, CAST(count(*) AS BIGINT) AS wires FROM edges GROUP BY 1", "edges")
def project_stats(spark, sf):
    return E.project_stats(adapted(spark, sf, "edges"), ("Call", "Import"))


@query("SELECT DISTINCT source, target FROM links WHERE tier IN ('Proven', 'PossibleSet')", "links")
def usable_links(spark, sf):
    return E.usable_links(adapted(spark, sf, "links"))


@query(
    """WITH asked AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS a, CAST((o_orderkey * 31 + o_custkey) % (SELECT max(c_custkey) + 1 FROM customer) AS BIGINT) AS b FROM orders),
    found(a, node) AS (SELECT a, a FROM asked UNION SELECT f.a, dst FROM found f JOIN ring ON src = node)
    SELECT a, b, EXISTS (SELECT 1 FROM found f WHERE f.a = q.a AND f.node = q.b) AS reaches FROM asked q""",
    "ring",
)
def trace_pairs(spark, sf):
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    pairs = o.join(c.agg((F.max("c_custkey") + 1).alias("n"))).selectExpr("cast(o_custkey as long) a", "cast((o_orderkey * 31 + o_custkey) % n as long) b")
    return R.trace_pairs(pairs, R.reach_index(adapted(spark, sf, "ring"))).select("a", "b", "reaches")
