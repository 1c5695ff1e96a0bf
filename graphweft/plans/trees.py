"""Queries over folder trees."""

from pyspark.sql import functions as F

from graphweft.functions import paths as P
from graphweft.operators import incremental
from graphweft.operators import paths as T
from graphweft.plans.adapters import adapted
from graphweft.plans.registry import query

NAME, PARENT = "regexp_extract({0}, '([^/]*)$', 1)", "CASE WHEN {0} LIKE '%/%' THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
#: (path, folder): all folders above, '' on top
ABOVE = "SELECT path, unnest(list_concat([''], list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[:i], '/')))) AS folder FROM {0}"


def _glob(pattern: str) -> str:
    return "|".join(T.name_regex(p).replace("'", "''") for p in pattern.split())


def _rule_sql() -> str:
    out, n = [], f"{NAME.format('path')}"
    for i, (kind, patterns, _, _) in enumerate(T.RULES):
        if kind in ("name", "extension"):
            out.append(f"WHEN regexp_full_match({n}, '{_glob(patterns)}', 'i') THEN {i}")
        elif kind == "rooted":
            out.append(f"WHEN regexp_full_match(path, '{'|'.join(T.path_regex(p[1:]) for p in patterns.split())}', 'i') THEN {i}")
        elif kind == "ignored":
            out.append(f"WHEN path LIKE 'pkg5/src/%' OR path = 'pkg6/build.rs' THEN {i}")
        elif kind == "attribute" and patterns == "linguist-generated":
            out.append(f"WHEN path LIKE 'pkg7/docs/%' THEN {i}")
        elif kind == "anchored":
            rest = patterns.partition("}/")[2]
            own = "rest = 'build.rs'" if rest == "build.rs" else f"rest LIKE '{rest[:-3]}/_%'"
            own = own.replace("rest", "CASE WHEN a.folder = '' THEN s.path ELSE substr(s.path, len(a.folder) + 2) END")
            out.append(f"WHEN EXISTS (SELECT 1 FROM above a JOIN sources m ON m.path = CASE WHEN a.folder = '' THEN 'Cargo.toml' ELSE concat(a.folder, '/Cargo.toml') END WHERE a.path = s.path AND {own}) THEN {i}")
    return "CASE " + " ".join(out) + f" ELSE {len(T.RULES) - 1} END"


CLASSES = f"above AS ({ABOVE.format('sources')}), ruled AS (SELECT path, {_rule_sql()} AS rule FROM sources s), classes AS (SELECT path, [{', '.join(repr(r[2]) for r in T.RULES)}][rule + 1] AS class, CAST(rule AS INT) AS rule, [{', '.join(repr(r[3]) for r in T.RULES)}][rule + 1] AS basis, len(path) AS size FROM ruled)"


def _classes(spark, sf):
    s = adapted(spark, sf, "sources")
    ignored = spark.createDataFrame([("pkg5/src/",), ("pkg6/build.rs",)], "path string")
    marked = s.where("path like 'pkg7/docs/%'").select("path", F.lit("linguist-generated").alias("attribute"))
    return T.classify(s, ignored, marked)


@query(f"WITH {CLASSES} SELECT path, class, rule, basis FROM classes", "sources")
def classify_rules(spark, sf):
    return _classes(spark, sf)


@query("SELECT path FROM sources WHERE path LIKE 'pkg5/src/%' OR path = 'pkg6/build.rs'", "sources")
def ignored_ancestor(spark, sf):
    return T.ignored_files(adapted(spark, sf, "sources"), spark.createDataFrame([("pkg5/src/",), ("pkg6/build.rs",)], "path string"))


@query(f"SELECT path FROM sources WHERE regexp_full_match({NAME.format('path')}, 'test_[^/]*\\.py|m[^/]*\\.RS', 'i')", "sources")
def name_globs(spark, sf):
    s = adapted(spark, sf, "sources")
    return s.where(T.name_glob(P.name(F.col("path")), "test_*.py") | T.name_glob(P.name(F.col("path")), "m*.RS"))


@query("SELECT path FROM sources WHERE path LIKE 'pkg%/src/_%' AND path NOT LIKE 'pkg%/%/src/%'", "sources")
def path_globs(spark, sf):
    return adapted(spark, sf, "sources").where(T.path_glob(F.col("path"), "pkg*/src/**"))


@query("WITH m AS (SELECT replace(path, '/Cargo.toml', '') AS folder FROM sources WHERE path LIKE '%/Cargo.toml') SELECT DISTINCT path FROM sources JOIN m ON path LIKE folder || '/tests/_%'", "sources")
def manifest_conventions(spark, sf):
    return T.anchored(adapted(spark, sf, "sources"), "Cargo.toml", "tests/**")


@query(
    f"""WITH above AS ({ABOVE.format('paths')}) SELECT folder, CAST(count(*) AS BIGINT) AS files, CAST(sum(tests) AS BIGINT) AS tests, CAST(sum(size) AS BIGINT) AS bytes
    FROM above JOIN paths USING (path) GROUP BY folder""",
    "paths",
)
def folder_rollup(spark, sf):
    return T.folder_rollup(adapted(spark, sf, "paths"))


@query(
    f"""WITH {CLASSES}, counts AS (SELECT folder, class, count(*) AS n FROM above JOIN classes USING (path) GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, class) AS k FROM counts)
    SELECT folder, string_agg(concat(n, ' ', class), ', ' ORDER BY k) AS text FROM top WHERE k <= 3 GROUP BY folder""",
    "sources",
)
def folder_class_top3(spark, sf):
    return T.folder_top_classes(T.folder_classes(_classes(spark, sf)))


@query(
    f"""WITH {CLASSES} SELECT folder, class, CAST(count(*) AS BIGINT) AS files, coalesce(string_agg(DISTINCT CASE WHEN rule BETWEEN 13 AND 22 THEN basis END, ',' ORDER BY CASE WHEN rule BETWEEN 13 AND 22 THEN basis END), '') AS conventions
    FROM above JOIN classes USING (path) GROUP BY ALL""",
    "sources",
)
def folder_class_counts(spark, sf):
    return T.folder_classes(_classes(spark, sf)).withColumn("conventions", F.array_join("conventions", ","))


@query(
    f"""WITH {CLASSES}, r AS (SELECT class, rule, count(*) AS n, sum(size) AS b FROM classes GROUP BY ALL)
    SELECT class, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes, string_agg(rule, ',' ORDER BY n DESC, rule) AS rules FROM r GROUP BY class""",
    "sources",
)
def class_totals(spark, sf):
    return T.class_totals(_classes(spark, sf).withColumn("size", F.length("path"))).withColumn("rules", F.array_join(F.col("rules").cast("array<string>"), ","))


MANIFEST_SQL = f"""m AS (SELECT {PARENT.format('path')} AS folder, arg_min(path, CASE WHEN path LIKE '%Cargo.toml' THEN 0 ELSE 1 END) AS package FROM sources WHERE path LIKE '%Cargo.toml' OR path LIKE '%package.json' GROUP BY 1),
    above AS ({ABOVE.format('sources')}), owned AS (SELECT s.path, coalesce((SELECT arg_max(package, len(a.folder)) FROM above a JOIN m USING (folder) WHERE a.path = s.path), '') AS package FROM sources s)"""


def _owned(spark, sf):
    s = adapted(spark, sf, "sources")
    return T.innermost_package(s, s.where(P.name(F.col("path")).isin("Cargo.toml", "package.json")).select("path", F.col("path").alias("package")))


@query(f"WITH {MANIFEST_SQL} SELECT path, package FROM owned", "sources")
def innermost_package(spark, sf):
    return _owned(spark, sf)


@query(f"WITH {MANIFEST_SQL} SELECT package, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (path LIKE '%test%') AS BIGINT) AS tests FROM owned GROUP BY package", "sources")
def tests_by_package(spark, sf):
    return T.package_totals(_owned(spark, sf).withColumn("tests", F.contains("path", F.lit("test")).cast("int"))).orderBy(F.desc("tests"), "package")


@query(f"WITH {MANIFEST_SQL} SELECT folder, package FROM m", "sources")
def manifest_per_folder(spark, sf):
    from graphweft.model import MANIFESTS, rank

    s = adapted(spark, sf, "sources").where(P.name(F.col("path")).isin("Cargo.toml", "package.json"))
    return s.groupBy(P.parent(F.col("path")).alias("folder")).agg(F.min_by("path", rank(P.name(F.col("path")), MANIFESTS)).alias("package"))


COMMITS = f"above AS ({ABOVE.format('(SELECT DISTINCT path FROM touched) t')}), last AS (SELECT folder, arg_min(commit, pos) AS commit, arg_min(time, pos) AS time FROM above JOIN touched USING (path) GROUP BY folder)"


@query(f"WITH {COMMITS} SELECT folder, commit, time FROM last", "touched")
def last_commit_per_folder(spark, sf):
    return T.last_commits(adapted(spark, sf, "touched"))


@query(f"WITH {COMMITS}, f AS (SELECT unnest(['', 'view', 'click', 'none']) AS path) SELECT path, commit, time FROM f LEFT JOIN last ON folder = CASE WHEN path = '' THEN 'd1' ELSE 'd1/' || path END", "touched")
def folder_last_commit_join(spark, sf):
    folders = spark.createDataFrame([("",), ("view",), ("click",), ("none",)], "path string")
    return T.folders_with_commits(folders, T.last_commits(adapted(spark, sf, "touched")), "d1")


@query(
    f"""WITH m AS (SELECT {PARENT.format('path')} AS folder FROM sources WHERE path LIKE '%/Cargo.toml'), t AS (SELECT p_partkey // 100 AS k, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
    SELECT folder, folder AS package, CAST(coalesce(n, 0) AS BIGINT) AS binaries FROM m LEFT JOIN t ON folder = concat('pkg', k)""",
    "sources",
)
def package_folders(spark, sf):
    m = adapted(spark, sf, "sources").where("path like '%/Cargo.toml'").select(P.parent(F.col("path")).alias("path"))
    targets = spark.read.parquet(f"{sf}/part.parquet").selectExpr("concat('pkg', p_partkey div 100) package", "if(p_partkey % 3 = 0, 'bin', 'lib') kind")
    return T.packages_at_folders(m, m.selectExpr("path package", "path folder"), targets)


@query(
    f"""WITH h AS (SELECT DISTINCT {PARENT.format('path')} AS path FROM sources WHERE path LIKE '%/package.json'), above AS ({ABOVE.format('sources')}),
    below AS (SELECT h.path AS top, s.path FROM h JOIN sources s ON s.path LIKE h.path || '/%'),
    dirs AS (SELECT top, count(DISTINCT folder) AS n FROM below JOIN above USING (path) WHERE folder LIKE top || '/%' GROUP BY top)
    SELECT top AS path, CAST(count(*) AS BIGINT) AS files, CAST(coalesce(any_value(n), 0) AS BIGINT) AS dirs, CAST(sum(len(path)) AS BIGINT) AS bytes FROM below LEFT JOIN dirs USING (top) GROUP BY top""",
    "sources",
)
def heavy_folder_totals(spark, sf):
    s = adapted(spark, sf, "sources").withColumn("size", F.length("path").cast("long"))
    heavy = s.where("path like '%/package.json'").select(P.parent(F.col("path")).alias("path")).distinct()
    return T.heavy_totals(heavy, s)


@query(
    """SELECT concat('d', u) AS path, CASE WHEN u = 0 THEN 'ignored' WHEN u % 3 = 1 THEN 'dependencies' WHEN u % 3 = 2 AND u > 2 THEN 'build cache' END AS reason
    FROM (SELECT DISTINCT user_id AS u FROM events) e WHERE u = 0 OR u % 3 = 1 OR (u % 3 = 2 AND u > 2)"""
)
def heavy_folders(spark, sf):
    u = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id u").distinct()
    files = u.where("u % 3 = 1").selectExpr("concat('d', u, '/pyvenv.cfg') path", "'' head").unionAll(u.where("u % 3 = 2").selectExpr("concat('d', u, '/CACHEDIR.TAG') path", f"if(u > 2, '{T.CACHEDIR_SIGNATURE}', 'x') head"))
    return T.heavy_folders(u.selectExpr("concat('d', u) path"), files, spark.createDataFrame([("d0/",)], "path string"))


@query(
    f"""WITH above AS ({ABOVE.format('sources')}), f AS (SELECT DISTINCT folder AS path, false AS is_file FROM above WHERE folder <> ''), every AS (SELECT * FROM f UNION ALL SELECT path, true FROM sources),
    shown AS (SELECT * FROM every WHERE path NOT LIKE '%/%' OR {PARENT.format('path')} IN ('pkg1', 'pkg2', 'pkg1/src'))
    SELECT path, CAST(len(string_split(path, '/')) - 1 AS INT) AS depth, is_file, CAST(row_number() OVER (PARTITION BY {PARENT.format('path')} ORDER BY is_file, lower({NAME.format('path')}), {NAME.format('path')}) - 1 AS INT) AS pos FROM shown""",
    "sources",
)
def tree_rows(spark, sf):
    s = adapted(spark, sf, "sources")
    folders = s.select(F.explode(P.ancestors(F.col("path"), top=False)).alias("path")).distinct()
    return T.tree_rows(folders.withColumn("is_file", F.lit(False)).unionAll(s.withColumn("is_file", F.lit(True))), spark.createDataFrame([("pkg1",), ("pkg2",), ("pkg1/src",)], "path string"))


#: Changes of a tree: files that grow, go and come.
AFTER = """SELECT path, size + CASE WHEN size % 7 = 1 THEN 1 ELSE 0 END AS size FROM paths WHERE size % 7 <> 0 UNION ALL SELECT concat(path, '/more/new'), 5 FROM paths WHERE size % 11 = 0"""


def _file_changes(spark, sf):
    """(files before, changes) of the tree of addresses."""
    before = adapted(spark, sf, "paths").where("path <> ''").selectExpr("path", "size bytes", "xxhash64(path, size) hash")
    change = lambda of, path, bytes_, gone: before.where(of).selectExpr(f"{path} path", f"cast({bytes_} as long) bytes", f"xxhash64({path}, cast({bytes_} as long)) hash", f"{gone} gone")
    return before, change("bytes % 7 = 0", "path", "0", "true").unionByName(change("bytes % 7 = 1", "path", "bytes + 1", "false")).unionByName(change("bytes % 11 = 0", "concat(path, '/more/new')", "5", "false"))


@query(f"WITH after AS ({AFTER}), above AS ({ABOVE.format('after')}) SELECT folder, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM above JOIN after USING (path) GROUP BY folder", "paths")
def incremental_tree(spark, sf):
    before, changes = _file_changes(spark, sf)
    after = incremental.refreshed_tree(incremental.settle(incremental.tree(before)), changes)
    return after.where("not is_file").select(F.col("path").alias("folder"), "files", "bytes")


@query(
    f"""WITH after AS ({AFTER}), differ AS (SELECT path FROM paths FULL JOIN after USING (path) WHERE paths.size IS DISTINCT FROM after.size),
    a AS (SELECT DISTINCT folder FROM ({ABOVE.format('paths')}) x), b AS (SELECT DISTINCT folder FROM ({ABOVE.format('after')}) y), touched AS (SELECT DISTINCT folder FROM ({ABOVE.format('differ')}) z)
    SELECT folder, CASE WHEN a.folder IS NULL THEN 'added' WHEN b.folder IS NULL THEN 'removed' ELSE 'changed' END AS change FROM touched LEFT JOIN a USING (folder) LEFT JOIN b USING (folder)""",
    "paths",
)
def changed_subtrees(spark, sf):
    before, changes = _file_changes(spark, sf)
    old = incremental.settle(incremental.tree(before))
    return incremental.changed(old, incremental.settle(incremental.refreshed_tree(old, changes))).where("not is_file").select(F.col("path").alias("folder"), "change")
