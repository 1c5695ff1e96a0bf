"""Queries over texts that are made from the bundled tables: extraction, tags, resolution, and command outputs."""

from pyspark.sql import functions as F

from graphweft.operators import extract as X
from graphweft.operators import resolve as V
from graphweft.operators import routers as U
from graphweft.plans.registry import query
from graphweft.sources import git as G
from graphweft.sources import manifests as M
from graphweft.sources import records as R
from graphweft.sources import settings as S
from graphweft.sources import tools as T


def _part(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet")


RUST = r"concat('/// Part\npub fn f', p_partkey, '() { g', p_size, '(1); x::h(); }\nstruct S', p_size, ';\nuse a::{b, c', p_size, '};\n#[test]\nfn t', p_partkey, '() { // fn no() {}\n }\n')"


@query(
    """SELECT path, kind, name, line FROM (SELECT concat('p', p_partkey, '.rs') AS path, unnest([{'kind': 'fn', 'name': concat('f', p_partkey), 'line': 2}, {'kind': 'struct', 'name': concat('S', p_size), 'line': 3},
      {'kind': 'use', 'name': 'a::b', 'line': 4}, {'kind': 'use', 'name': concat('a::c', p_size), 'line': 4}, {'kind': 'fn', 'name': concat('t', p_partkey), 'line': 6}], recursive := true) FROM part) u"""
)
def rust_items(spark, sf):
    files = _part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.expr(RUST).alias("text"))
    return X.items(files).select("path", "kind", "name", "line")


@query("SELECT concat('p', p_partkey, '.rs') AS path, concat('fn:f', p_partkey) AS member_id, unnest([concat('g', p_size), 'x::h']) AS callee FROM part")
def member_calls(spark, sf):
    files = _part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.expr(RUST).alias("text"))
    return X.member_calls(X.items(files))


@query("SELECT path, idx, kind, name FROM (SELECT concat('p', p_partkey, '.rs') AS path, unnest([{'idx': 0, 'kind': 'fn', 'name': concat('f', p_partkey)}, {'idx': 1, 'kind': 'struct', 'name': concat('S', p_size)}, {'idx': 2, 'kind': 'fn', 'name': concat('t', p_partkey)}], recursive := true) FROM part) u")
def member_rows(spark, sf):
    files = _part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.expr(RUST).alias("text"))
    return X.members(X.items(files)).select("path", "idx", "kind", "name")


@query("SELECT concat('p', p_partkey, '.rs') AS path, 1 AS tests FROM part")
def test_counts(spark, sf):
    return X.test_counts(_part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.expr(RUST).alias("text")))


PYTHON = r"concat('class C', p_size, '(Base):\n    def m(self):\n        return f', p_partkey, '()\n\ndef g():\n    pass\n')"


@query("SELECT path, kind, name, owner, line_end FROM (SELECT concat('p', p_partkey, '.py') AS path, unnest([{'kind': 'class', 'name': concat('C', p_size), 'owner': NULL, 'line_end': 3}, {'kind': 'fn', 'name': 'm', 'owner': concat('C', p_size), 'line_end': 3}, {'kind': 'fn', 'name': 'g', 'owner': NULL, 'line_end': 6}], recursive := true) FROM part) u")
def python_items(spark, sf):
    return X.items(_part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), F.expr(PYTHON).alias("text"))).select("path", "kind", "name", "owner", "line_end")


#: A text of each scanner's family by p_partkey % 7, and what is in it: kind, name, line.
FAMILY_TEXTS = {
    "go": ("package a\\n\\nimport \"fmt\"\\n\\ntype S@ struct {\\n}\\n\\nfunc (s *S@) Do() {\\n  fmt.Println()\\n}\\n", [("use", "fmt", 3), ("struct", "S@", 5), ("fn", "Do", 8)]),
    "ts": ("import {x} from \"./y\";\\nexport class A@ extends B {\\n  run() {\\n  }\\n}\\nexport const f = () => {\\n};\\n", [("use", "./y", 1), ("class", "A@", 2), ("fn", "run", 3), ("fn", "f", 6)]),
    "java": ("import a.b;\\npublic class C@ {\\n  public int f(int x) {\\n    return g(x);\\n  }\\n}\\n", [("use", "a.b", 1), ("class", "C@", 2), ("fn", "f", 3)]),
    "c": ("modded class M@ {\\n  override void OnInit() {\\n  }\\n}\\n", [("class", "M@", 1), ("fn", "OnInit", 2)]),
    "lua": ("local m = require(\"x.y\")\\nlocal function one@()\\n  two()\\nend\\n", [("use", "x.y", 1), ("fn", "one@", 2)]),
    "rb": ("require \"set\"\\nclass R@\\n  def go\\n  end\\nend\\n", [("use", "set", 1), ("class", "R@", 2), ("fn", "go", 3)]),
    "sh": ("source lib.sh\\nrun@() {\\n  ls\\n}\\n", [("use", "lib.sh", 1), ("fn", "run@", 2)]),
}
FAMILY_SQL = " UNION ALL ".join(
    f"SELECT concat('p', p_partkey, '.{end}') AS path, '{kind}' AS kind, replace('{name}', '@', CAST(p_partkey AS VARCHAR)) AS name, CAST({line} AS INT) AS line FROM part WHERE p_partkey % 7 = {i}"
    for i, (end, (_, found)) in enumerate(FAMILY_TEXTS.items()) for kind, name, line in found
)


@query(FAMILY_SQL)
def family_items(spark, sf):
    end = "case p_partkey % 7 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(FAMILY_TEXTS)) + " end"
    text = "replace(case p_partkey % 7 " + " ".join(f"when {i} then '{t}'" for i, (t, _) in enumerate(FAMILY_TEXTS.values())) + " end, '@', cast(p_partkey as string))"
    return X.items(_part(spark, sf).selectExpr(f"concat('p', p_partkey, '.', {end}) path", f"{text} text")).select("path", "kind", "name", "line")


FACTS = r"concat('#[cfg(feature = \"x\")]\nmod m', p_partkey, ' {\n  use a::{b, c};\n  #[inline]\n  #[cfg(test)]\n  pub fn f', p_size, '() { g(1).h(); }\n}\nmod other;\nstruct S;\n')"


@query(
    """SELECT path, kind, name, line, module, gate FROM (SELECT concat('p', p_partkey, '.rs') AS path, concat('m', p_partkey) AS mod, unnest([
      {'kind': 'mod', 'name': concat('m', p_partkey), 'line': 2, 'module': '', 'gate': 'cfg(feature = "x")'}, {'kind': 'use', 'name': 'a::b', 'line': 3, 'module': concat('m', p_partkey), 'gate': 'cfg(feature = "x")'},
      {'kind': 'use', 'name': 'a::c', 'line': 3, 'module': concat('m', p_partkey), 'gate': 'cfg(feature = "x")'}, {'kind': 'fn', 'name': concat('f', p_size), 'line': 6, 'module': concat('m', p_partkey), 'gate': 'cfg(feature = "x") & cfg(test)'},
      {'kind': 'call', 'name': 'g', 'line': 6, 'module': concat('m', p_partkey), 'gate': 'cfg(feature = "x") & cfg(test)'}, {'kind': 'call', 'name': '.h', 'line': 6, 'module': concat('m', p_partkey), 'gate': 'cfg(feature = "x") & cfg(test)'},
      {'kind': 'mod', 'name': 'other', 'line': 8, 'module': '', 'gate': NULL}, {'kind': 'struct', 'name': 'S', 'line': 9, 'module': '', 'gate': NULL}], recursive := true) FROM part) u"""
)
def rust_facts(spark, sf):
    files = _part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.expr(FACTS).alias("text"))
    return X.rust_facts(files).select("path", "kind", "name", "line", "module", "gate")


MARKDOWN = r"concat('# Part ', p_partkey, '\n\nSee [it](docs/', p_size, '.md).\n\n```rust\n# no [x](y)\n```\n')"


@query("SELECT path, kind, name, line FROM (SELECT concat('p', p_partkey, '.md') AS path, unnest([{'kind': 'heading', 'name': concat('Part ', p_partkey), 'line': 1}, {'kind': 'link', 'name': concat('docs/', p_size, '.md'), 'line': 3}, {'kind': 'block', 'name': 'rust', 'line': 5}], recursive := true) FROM part) u")
def markdown_items(spark, sf):
    return X.items(_part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".md")).alias("path"), F.expr(MARKDOWN).alias("text"))).select("path", "kind", "name", "line")


TAGS = r"concat('// @route get|POST /a/', p_size, '|/b\nfn h() {\n  let s = \"@route GET /no\"; // @contract x.json#/k partial\n}\n/* @route /bad */\n')"


@query("SELECT path, tag, line, detail FROM (SELECT concat('p', p_partkey, '.rs') AS path, unnest([{'tag': 'route', 'line': 1, 'detail': concat('GET,POST /a/', p_size, ',/b')}, {'tag': 'contract', 'line': 3, 'detail': 'x.json /k'}, {'tag': 'malformed', 'line': 5, 'detail': 'no method'}], recursive := true) FROM part) u")
def tag_scan(spark, sf):
    t = X.tags(_part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.expr(TAGS).alias("text")))
    detail = F.coalesce(F.col("malformed"), F.concat_ws(" ", "file_ref", "pointer", F.array_join("methods", ","), F.array_join("templates", ",")))
    return t.select("path", "tag", "line", detail.alias("detail"))


@query(
    """WITH s AS (SELECT concat('f', p_partkey // 40) AS path, p_size AS a, p_size + p_partkey % 30 AS b, p_partkey AS n FROM part), p AS (SELECT concat('f', s_suppkey // 2) AS path, CAST(s_suppkey * 7 % 60 AS INT) AS line FROM supplier)
    SELECT DISTINCT p.path, line, arg_min(n, (b - a) * 100000 + n) OVER (PARTITION BY p.path, line) AS name FROM p JOIN s ON p.path = s.path AND line BETWEEN a AND b"""
)
def innermost_span(spark, sf):
    spans = _part(spark, sf).selectExpr("concat('f', p_partkey div 40) path", "p_size line", "p_size + p_partkey % 30 line_end", "p_partkey name")
    points = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("concat('f', s_suppkey div 2) path", "int(s_suppkey * 7 % 60) line").distinct()
    return X.innermost(points, spans)


OWNED = "concat('fn a', p_partkey, '() {\n', case p_partkey % 3 when 0 then '}' else '  x();\n}' end, '\n/// @route GET /r\n', case p_partkey % 4 when 0 then '/// more\n' when 1 then '#[inline(\n  always)]\n' when 2 then '\n' else 'let x = 1; ' end, 'fn b', p_partkey, '() { let y = 1; } // @route GET /s\n')"


@query(
    """SELECT concat('p', p_partkey, '.rs') AS path, CAST(CASE WHEN k = 0 THEN 3 ELSE 4 + CASE WHEN p_partkey % 4 < 2 THEN p_partkey % 4 + 1 WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END END + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS INT) AS line,
    CASE WHEN k = 0 AND p_partkey % 4 < 2 THEN concat('b', p_partkey) WHEN k = 0 AND p_partkey % 4 = 3 THEN concat('b', p_partkey) END AS owner FROM part, range(0, 2) t(k)"""
)
def tag_owner_rule(spark, sf):
    files = _part(spark, sf).select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.expr(OWNED).alias("text"))
    return X.tag_owners(X.tags(files), X.items(files).where("kind = 'fn'"))


@query(
    """SELECT c_custkey AS ref, CASE c_custkey % 5 WHEN 0 THEN 'item' WHEN 1 THEN 'item' WHEN 2 THEN 'external' WHEN 3 THEN 'unresolved' ELSE 'ambiguous' END AS tag,
    CASE c_custkey % 5 WHEN 0 THEN concat('c', c_custkey) WHEN 1 THEN concat('n', c_nationkey) WHEN 2 THEN 'external' END AS target FROM customer"""
)
def path_resolution(spark, sf):
    nation, customer = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    modules = nation.selectExpr("concat('n', n_nationkey) module", "'top' parent", "'k' crate", "'top' root").unionAll(spark.createDataFrame([("top", None, "k", "top"), ("re", "top", "k", "top")], "module string, parent string, crate string, root string"))
    names = nation.selectExpr("'top' module", "n_name name", "concat('n', n_nationkey) target", "true is_module", "true public").unionAll(customer.selectExpr("concat('n', c_nationkey)", "concat('C', c_custkey)", "concat('c', c_custkey)", "false", "true"))
    names = names.unionAll(spark.createDataFrame([("top", "re", "re", True, True), ("n0", "Twice", "a", False, True), ("n1", "Twice", "b", False, True)], names.schema))
    imports = nation.selectExpr("'re' module", "n_name name", "array('crate', n_name) segments", "true public").unionAll(spark.createDataFrame([("re", "*", ["crate", "ALGERIA"], True)], "module string, name string, segments array<string>, public boolean"))
    two = nation.where("n_nationkey in (0, 1)").select("n_nationkey", "n_name")
    imports = imports.unionAll(two.selectExpr("'top'", "'*'", "array('crate', n_name)", "true"))
    externs = spark.createDataFrame([("k", "serde", None)], "crate string, name string, root string")
    path = F.expr("case c_custkey % 5 when 0 then array('crate', n_name, concat('C', c_custkey)) when 1 then array('super', 're', n_name) when 2 then array('serde', 'de', 'X') when 3 then array('crate', n_name, 'Nope') else array('crate', 'Twice') end")
    asked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ref"), F.concat(F.lit("n"), "c_nationkey").alias("module"), path.alias("segments"))
    return V.resolve(asked, modules, names, imports, externs).select("ref", "tag", "target")


@query()
def route_evaluation(spark, sf):
    """Router code by an abstract evaluator: tested on written files."""
    code = F.expr(r"""concat('fn app() -> Router {\n  let r = Router::new().route("/a/', s_suppkey, '", get(h).post(crate::p));\n  if debug { r = r.route("/d", any(d)); }\n  r.nest("/api", sub()).merge(sub())\n}\nfn sub() -> Router { Router::new().route("/s/:id", get(s)) }\n')""")
    return U.evaluate(spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("k"), "s_suppkey").alias("crate"), F.lit("src/main.rs").alias("path"), code.alias("text")))


@query(
    """SELECT event_id AS "commit", unnest([concat('a', user_id), concat('n', user_id), 'b.png']) AS path, unnest([NULL, concat('o', user_id), NULL]) AS old_path, unnest([event_id, 1, NULL]) AS added, unnest([2, 0, NULL]) AS deleted FROM events"""
)
def numstat_parse(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    out = F.concat(F.lit("\n"), F.col("event_id"), F.lit("\t2\ta"), "user_id", F.lit("\0"), F.lit("1\t0\t\0o"), "user_id", F.lit("\0n"), "user_id", F.lit("\0-\t-\tb.png\0"))
    return G.parse_numstat(e.select(F.col("event_id").alias("commit"), out.alias("output")))


@query(
    """SELECT CAST(count(*) FILTER (k = 0) AS BIGINT) AS added, CAST(count(*) FILTER (k = 1) AS BIGINT) AS modified, CAST(count(*) FILTER (k = 2) AS BIGINT) AS deleted, CAST(count(*) FILTER (k = 3) AS BIGINT) AS renamed,
    CAST(count(*) FILTER (k = 4) AS BIGINT) AS conflicted, CAST(count(*) FILTER (k = 5) AS BIGINT) AS untracked FROM (SELECT event_id % 6 AS k FROM events) e"""
)
def status_counts(spark, sf):
    out = F.expr(r"case event_id % 6 when 0 then concat('1 AD N... a b ', event_id, '\0') when 1 then '1 .M x y\0' when 2 then '1 .D x y\0' when 3 then '2 R. x new\0? old\0' when 4 then 'u UU x\0' else '? file\0' end")
    return G.status_counts(spark.read.parquet(f"{sf}/events.parquet").select(out.alias("output")))


@query("SELECT CAST(event_id AS VARCHAR) AS path, 'linguist-vendored' AS attribute, CASE event_id % 2 WHEN 0 THEN 'set' ELSE 'unspecified' END AS value FROM events")
def attribute_triples(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    three = F.array(F.col("event_id").cast("string"), F.lit("linguist-vendored"), F.expr("if(event_id % 2 = 0, 'set', 'unspecified')"))
    return G.parse_attributes(e.select("event_id", F.posexplode(three).alias("k", "field")).select((F.col("event_id") * 3 + F.col("k")).alias("pos"), "field"))


@query(
    """SELECT event_id AS "offset", event_id % 4 = 3 AS bad, CASE WHEN event_id % 4 < 3 THEN event_type END AS type, CASE event_id % 4 WHEN 0 THEN concat('u', user_id) END AS uuid, CASE WHEN event_id % 4 < 3 THEN epoch_us(ts) // 1000 END AS time FROM events"""
)
def json_line_skim(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    line = F.when(F.col("event_id") % 4 == 3, F.lit("[1, 2]")).otherwise(F.concat(F.lit('{"type":"'), "event_type", F.lit('","uuid":'), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"u'), "user_id", F.lit('"'))).otherwise("null"), F.lit(',"timestamp":"'), stamp, F.lit('Z","message":{"content":[{"type":"text","text":"x"}]}}')))
    return R.skim(e.select(F.lit("l").alias("path"), F.col("event_id").alias("offset"), line.alias("line"))).select("offset", "bad", "type", "uuid", "time")


@query("SELECT s_suppkey AS path, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE concat('T-', s_suppkey) END AS id, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'ready' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS BIGINT) END AS priority, s_suppkey % 4 = 3 AS bad FROM supplier")
def ticket_files(spark, sf):
    text = F.expr(r"""case s_suppkey % 4 when 0 then concat('id = "T-', s_suppkey, '"\nstatus = "ready"\npriority = ', s_suppkey) when 3 then 'status = "x"' else concat('id = "T-', s_suppkey, '"\nstatus = "ready"\npriority = "high"') end""")
    files = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("t/T-"), "s_suppkey", F.lit(".toml")).alias("path"), text.alias("text"))
    return R.read_tickets(files).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("path"), "id", "status", "priority", F.col("error").isNotNull().alias("bad"))


@query("SELECT concat('d', s_suppkey) AS folder, section, key, line FROM (SELECT s_suppkey, unnest([{'section': 'Logs', 'key': '*.log', 'line': 2}, {'section': 'Logs', 'key': '!keep.log', 'line': 3}, {'section': '', 'key': concat('x', s_suppkey), 'line': 5}], recursive := true) FROM supplier) u")
def ignore_sheets(spark, sf):
    text = F.expr(r"concat('# Logs\n*.log\n!keep.log\n\nx', s_suppkey)")
    files = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("d"), "s_suppkey", F.lit("/.gitignore")).alias("path"), text.alias("text"))
    return S.settings_facts(files).select(F.regexp_replace("path", "/.*$", "").alias("folder"), "section", "key", "line")


@query("SELECT concat('p', s_suppkey) AS package, unnest(['serde', concat('p', s_suppkey + 1), 'win']) AS extern, unnest([false, s_suppkey % 2 = 0, true]) AS gated, unnest([false, s_suppkey + 1 IN (SELECT s_suppkey FROM supplier), false]) AS local FROM supplier")
def crate_graph(spark, sf):
    text = F.expr(r"""concat('[package]\nname = "p', s_suppkey, '"\nversion = "1.0"\n[dependencies]\nserde = "1"\np', s_suppkey + 1, ' = { path = "../p', s_suppkey + 1, '", optional = ', if(s_suppkey % 2 = 0, 'true', 'false'), ' }\n[target.windows.dependencies]\nwin = "1"\n[dev-dependencies]\nonly-tests = "1"\n')""")
    packages = M.cargo_packages(spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("p"), "s_suppkey", F.lit("/Cargo.toml")).alias("path"), text.alias("text")))
    return M.crate_graph(packages, M.package_deps(packages)).select("package", "extern", "gated", "local")


@query(
    """WITH t AS (SELECT concat('t', p_partkey) AS id, p_partkey AS k, CASE WHEN p_partkey > 3 THEN p_partkey // 4 END AS parent FROM part WHERE p_partkey > 0),
    walk(id, k, key) AS (SELECT id, k, [k] FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.k, list_append(key, t.k) FROM t JOIN walk w ON t.parent = w.k)
    SELECT id, CAST(len(key) - 1 AS INT) AS depth, CAST(row_number() OVER (ORDER BY key) - 1 AS INT) AS pos FROM walk"""
)
def tool_preorder(spark, sf):
    p = _part(spark, sf).where("p_partkey > 0")
    return T.preorder(p.selectExpr("concat('t', p_partkey) id", "if(p_partkey > 3, concat('t', p_partkey div 4), null) parent", "p_partkey line", "concat('t', p_partkey) name"))


@query("SELECT concat('d', s_suppkey) AS folder, unnest(['all', 'clean', concat('run', s_suppkey)]) AS name, unnest([NULL, 'Remove all', 'Runs it']) AS description FROM supplier")
def make_targets(spark, sf):
    text = F.expr(r"concat('V := 1\n.PHONY: all\nall: x\n\tcc\nclean: ## Remove all\n%.o: %.c\n# Runs it\nrun', s_suppkey, ': all\n')")
    files = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("d"), "s_suppkey", F.lit("/Makefile")).alias("path"), text.alias("text"))
    return T.discover_tools(files).select(F.regexp_replace("path", "/.*$", "").alias("folder"), "name", "description")
