"""Folder trees: classification of files, roll-ups at any depth, packages and last commits.

Ancestors are exploded into equi-join keys; aggregates over them are combined on the map side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.paths import ancestors, depth, name, parent
from graphweft.model import MANIFESTS, rank

#: The classification rules in their order (kind, patterns, class, basis); the first that matches decides.
RULES = (
    ("attribute", "linguist-generated", "build output", "Linguist"),
    ("attribute", "linguist-vendored", "vendored", "Linguist"),
    ("attribute", "linguist-documentation", "docs", "Linguist"),
    ("ignored", ".gitignore", "build output", "git"),
    ("name", "README README.* CHANGELOG CHANGELOG.* LICENSE LICENSE.* LICENCE LICENCE.* COPYING COPYING.* CONTRIBUTING CONTRIBUTING.* NOTICE NOTICE.* AUTHORS", "docs", "well-known names"),
    ("name", "*_test.go", "tests", "Go"),
    ("name", "test_*.py *_test.py", "tests", "pytest"),
    ("name", "*.test.js *.test.jsx *.test.ts *.test.tsx *.test.mjs *.test.cjs *.spec.js *.spec.jsx *.spec.ts *.spec.tsx *.spec.mjs *.spec.cjs", "tests", "Jest, Vitest"),
    ("name", "*.schema.json openapi.json openapi.yaml openapi.yml swagger.json swagger.yaml swagger.yml", "schemas", "JSON Schema, OpenAPI"),
    ("name", "Makefile GNUmakefile justfile .justfile Dockerfile Dockerfile.* Containerfile Taskfile.yml Taskfile.yaml", "tooling", "make, just, Docker, Task"),
    ("name", "Cargo.lock package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock uv.lock Pipfile.lock go.sum Gemfile.lock composer.lock flake.lock", "config", "package managers"),
    ("name", "Cargo.toml package.json pyproject.toml setup.cfg go.mod go.work Gemfile Pipfile requirements.txt requirements-*.txt CMakeLists.txt tsconfig.json tsconfig.*.json rust-toolchain rust-toolchain.toml", "config", "package managers"),
    ("name", ".gitignore .gitattributes .gitmodules .editorconfig .env .env.* .npmrc .nvmrc .prettierrc .prettierrc.* .eslintrc .eslintrc.* .clang-format rustfmt.toml .rustfmt.toml clippy.toml .clippy.toml", "config", "well-known names"),
    ("rooted", "/.github/workflows/*.yml /.github/workflows/*.yaml", "CI", "GitHub Actions"),
    ("rooted", "/.gitlab-ci.yml", "CI", "GitLab CI/CD"),
    ("rooted", "/.circleci/config.yml", "CI", "CircleCI"),
    ("rooted", "/Jenkinsfile", "CI", "Jenkins"),
    ("rooted", "/azure-pipelines.yml", "CI", "Azure Pipelines"),
    ("rooted", "/.ai/tickets/T-*.toml", "tickets", "tickets"),
    ("anchored", "{Cargo.toml}/build.rs", "tooling", "Cargo"),
    ("anchored", "{Cargo.toml}/tests/**", "tests", "Cargo"),
    ("anchored", "{Cargo.toml}/benches/**", "tests", "Cargo"),
    ("anchored", "{Cargo.toml}/examples/**", "docs", "Cargo"),
    ("extension", "*.rs *.py *.pyi *.js *.mjs *.cjs *.ts *.mts *.cts *.tsx *.jsx *.go *.c *.h *.cc *.cpp *.cxx *.hpp *.hh *.hxx *.cs *.java *.kt *.kts *.swift *.rb *.php *.lua *.dart *.scala *.zig *.vue *.svelte *.html *.htm *.css *.scss *.sass *.less *.sql *.wgsl *.glsl *.hlsl *.vert *.frag *.comp *.shader", "code", "languages"),
    ("extension", "*.sh *.bash *.zsh *.fish *.ps1 *.psm1 *.bat *.cmd *.mk *.cmake", "tooling", "shells, make, CMake"),
    ("extension", "*.md *.markdown *.mdx *.rst *.adoc *.txt *.org *.tex *.pdf", "docs", "document formats"),
    ("extension", "*.proto *.graphql *.gql *.xsd *.avsc *.thrift *.capnp", "schemas", "schema languages"),
    ("extension", "*.toml *.yaml *.yml *.json *.jsonc *.json5 *.ini *.cfg *.conf *.properties *.xml *.plist *.env *.csv *.tsv *.jsonl *.ndjson", "config", "data formats"),
    ("extension", "*.png *.jpg *.jpeg *.gif *.webp *.bmp *.ico *.svg *.tga *.dds *.psd *.exr *.hdr *.tif *.tiff *.ttf *.otf *.woff *.woff2 *.wav *.ogg *.mp3 *.flac *.mp4 *.webm *.mov *.fbx *.gltf *.glb *.blend *.bvh", "assets", "media formats"),
    ("extension", "*.et *.ent *.layer *.layout *.emat *.edds *.xob *.meta", "assets", "Enfusion"),
    ("extension", "*.log *.o *.a *.lib *.so *.dylib *.dll *.exe *.pdb *.pyc *.pyo *.class *.rlib *.rmeta", "build output", "compilers, loggers"),
    ("fallback", "*", "other", "none"),
)
#: Files that make a folder heavy, and why.
HEAVY_MARKERS = {
    "CACHEDIR.TAG": "build cache", "pyvenv.cfg": "dependencies", ".package-lock.json": "dependencies",
    ".modules.yaml": "dependencies", ".yarn-integrity": "dependencies", ".yarn-state.yml": "dependencies",
}
CACHEDIR_SIGNATURE = "Signature: 8a477f597d28d172789f06886806bc55"
VCS_FOLDERS = (".git", ".hg", ".svn")


def name_regex(pattern: str) -> str:
    """A glob within one name as a regular expression; ASCII case is ignored by callers."""
    return "[^/]*".join(re.escape(p) for p in pattern.split("*"))


def path_regex(pattern: str) -> str:
    """A glob over names: ** stands for one name or more at the end, and for any number elsewhere."""
    out, names = "", pattern.split("/")
    for i, part in enumerate(names):
        last = i == len(names) - 1
        if part == "**":
            out += "[^/]*(?:/[^/]*)*" if last else "(?:[^/]*/)*"
        else:
            out += name_regex(part) + ("" if last else "/")
    return out


def name_glob(column: Column, pattern: str) -> Column:
    return column.rlike(f"(?i)^(?:{name_regex(pattern)})$")


def path_glob(column: Column, pattern: str) -> Column:
    return column.rlike(f"(?i)^(?:{path_regex(pattern)})$")


def anchored(files: DataFrame, manifest: str, pattern: str) -> DataFrame:
    """Paths below a folder that holds manifest whose rest matches pattern: ancestors semi-joined with the manifests' folders."""
    holds = files.where(name(F.col("path")) == manifest).select(parent(F.col("path")).alias("above")).distinct()
    below = files.where(F.col("path").rlike(f"(?i)(?:^|/)(?:{path_regex(pattern)})$")).select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    rest = F.when(F.col("above") == "", F.col("path")).otherwise(F.substr("path", F.length("above") + 2))
    return below.where(path_glob(rest, pattern)).join(holds, "above", "left_semi").select("path").distinct()


def ignored_files(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files that are ignored, or below a folder that is. ignored: path, folders with a trailing /."""
    own = F.array_append(F.transform(ancestors(F.col("path"), top=False), lambda a: F.concat(a, F.lit("/"))), F.col("path"))
    return files.select("path", F.explode(own).alias("at")).join(ignored.select(F.col("path").alias("at")), "at", "left_semi").select("path").distinct()


def classify(files: DataFrame, ignored: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """(path, class, rule, basis): the first of the rules that matches each file.

    ignored: path; attributes: path, attribute. Rules over names are one CASE expression; those over other files come in
    as flags by semi-joins.
    """
    rows = files.select("path").distinct()
    flags: dict[str, Column] = {}

    def flag(key: str, paths: DataFrame) -> None:
        nonlocal rows
        rows = rows.join(paths.select("path").distinct().withColumn(key, F.lit(True)), "path", "left")
        flags[key] = F.coalesce(F.col(key), F.lit(False))

    if ignored is not None:
        flag("is_ignored", ignored_files(rows, ignored))
    for n, (kind, patterns, _, _) in enumerate(RULES):
        if kind == "attribute" and attributes is not None:
            flag(f"has_{n}", attributes.where(F.col("attribute") == patterns))
        elif kind == "anchored":
            manifest, _, rest = patterns[1:].partition("}/")
            flag(f"has_{n}", anchored(files, manifest, rest))
    rule = None
    for n, (kind, patterns, _, _) in enumerate(RULES):
        if kind in ("name", "extension"):
            hit = name(F.col("path")).rlike("(?i)^(?:" + "|".join(map(name_regex, patterns.split())) + ")$")
        elif kind == "rooted":
            hit = F.col("path").rlike("(?i)^(?:" + "|".join(path_regex(p[1:]) for p in patterns.split()) + ")$")
        elif kind == "ignored":
            hit = flags.get("is_ignored", F.lit(False))
        elif kind == "fallback":
            hit = F.lit(True)
        else:
            hit = flags.get(f"has_{n}", F.lit(False))
        rule = F.when(hit, n) if rule is None else rule.when(hit, n)
    chosen = rows.withColumn("rule", rule.cast("int"))
    at = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in RULES)), F.col("rule") + 1)
    return chosen.select("path", at(2).alias("class"), "rule", at(3).alias("basis"))


def heavy_folders(dirs: DataFrame, files: DataFrame, ignored: DataFrame) -> DataFrame:
    """(path, reason) of folders not to descend: version control, ignored, then a marker file (a cache tag needs its signature).

    dirs: path; files: path, head; ignored: path with a trailing /.
    """
    marks = F.create_map(*[F.lit(x) for pair in HEAVY_MARKERS.items() for x in pair])
    order = F.array_position(F.array(*map(F.lit, HEAVY_MARKERS)), name(F.col("path")))
    tagged = (name(F.col("path")) != "CACHEDIR.TAG") | F.col("head").startswith(CACHEDIR_SIGNATURE)
    marked = files.where(name(F.col("path")).isin(*HEAVY_MARKERS) & tagged).groupBy(parent(F.col("path")).alias("path")).agg(F.min_by(F.element_at(marks, name(F.col("path"))), order).alias("mark"))
    out = dirs.select("path").join(marked, "path", "left").join(ignored.select(F.expr("rtrim('/', path)").alias("path")).distinct().withColumn("out", F.lit(True)), "path", "left")
    reason = F.when(name(F.col("path")).isin(*VCS_FOLDERS), "version control").when(F.col("out"), "ignored").otherwise(F.col("mark"))
    return out.select("path", reason.alias("reason")).where("reason is not null")


def heavy_totals(heavy: DataFrame, files: DataFrame) -> DataFrame:
    """(path, files, dirs, bytes) below each heavy folder. files: path, size."""
    below = files.select("path", "size", F.explode(ancestors(F.col("path"))).alias("at")).join(heavy.select(F.col("path").alias("at")), "at")
    inner = below.select("at", F.explode(ancestors(F.col("path"))).alias("dir")).where(F.col("dir").startswith(F.concat("at", F.lit("/")))).distinct().groupBy("at").agg(F.count(F.lit(1)).alias("dirs"))
    return below.groupBy("at").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).join(inner, "at", "left").select(F.col("at").alias("path"), "files", F.coalesce("dirs", F.lit(0)).alias("dirs"), "bytes")


def folder_rollup(files: DataFrame) -> DataFrame:
    """(folder, files, tests, bytes) at any depth. files: path, tests, size. Leaf folders are summed before their ancestors are exploded."""
    leaves = files.groupBy(parent(F.col("path")).alias("leaf")).agg(F.count(F.lit(1)).alias("files"), F.sum("tests").alias("tests"), F.sum("size").alias("bytes"))
    spread = leaves.withColumn("folder", F.explode(F.array_distinct(F.array_append(ancestors(F.col("leaf")), F.col("leaf")))))
    return spread.groupBy("folder").agg(F.sum("files").alias("files"), F.sum("tests").alias("tests"), F.sum("bytes").alias("bytes"))


def folder_classes(classes: DataFrame) -> DataFrame:
    """(folder, class, files, conventions) at any depth. classes: path, class, basis, rule."""
    convention = F.when(F.element_at(F.array(*(F.lit(r[0] in ("rooted", "anchored")) for r in RULES)), F.col("rule") + 1), F.col("basis"))
    leaves = classes.groupBy(parent(F.col("path")).alias("leaf"), "class").agg(F.count(F.lit(1)).alias("files"), F.collect_set(convention).alias("c"))
    spread = leaves.withColumn("folder", F.explode(F.array_distinct(F.array_append(ancestors(F.col("leaf")), F.col("leaf")))))
    return spread.groupBy("folder", "class").agg(F.sum("files").alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("conventions"))


def folder_top_classes(counts: DataFrame, k: int = 3) -> DataFrame:
    """(folder, text): the k commonest classes, most first, then by name."""
    w = Window.partitionBy("folder").orderBy(F.desc("files"), "class")
    top = counts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    words = F.transform(F.array_sort(F.collect_list(F.struct("n", "files", "class"))), lambda x: F.concat(x["files"].cast("string"), F.lit(" "), x["class"]))
    return top.groupBy("folder").agg(F.array_join(words, ", ").alias("text"))


def class_totals(classes: DataFrame) -> DataFrame:
    """(class, files, bytes, rules): rules that decided, most files first, then by number. classes: path, class, rule, size."""
    by_rule = classes.groupBy("class", "rule").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    rules = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), "rule"))), lambda x: x["rule"])
    return by_rule.groupBy("class").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), rules.alias("rules"))


def innermost_package(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, package): the deepest folder above each file that holds a manifest; outsiders have the package ''.

    manifests: path, package. A folder with several keeps one, by the order of MANIFESTS.
    """
    owner = manifests.groupBy(parent(F.col("path")).alias("at")).agg(F.min_by("package", rank(name(F.col("path")), MANIFESTS)).alias("package"))
    leaves = files.select(parent(F.col("path")).alias("leaf")).distinct()
    above = leaves.withColumn("at", F.explode(F.array_distinct(F.array_append(ancestors(F.col("leaf")), F.col("leaf"))))).join(owner, "at")
    deepest = above.groupBy("leaf").agg(F.max_by("package", depth(F.col("at"))).alias("package"))
    return files.select("path", parent(F.col("path")).alias("leaf")).join(deepest, "leaf", "left").select("path", F.coalesce("package", F.lit("")).alias("package"))


def package_totals(owned: DataFrame) -> DataFrame:
    """(package, files, tests), most tests first by callers. owned: path, package, tests."""
    return owned.groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.sum("tests").alias("tests"))


def last_commits(touched: DataFrame) -> DataFrame:
    """(folder, commit, time): the newest commit under every folder, '' being the top. touched: commit, time, pos (0 is newest), path.

    A log lists commits newest first: the least position counts, not the time.
    """
    leaves = touched.groupBy(parent(F.col("path")).alias("leaf")).agg(F.min_by(F.struct("commit", "time"), "pos").alias("c"), F.min("pos").alias("pos"))
    spread = leaves.withColumn("folder", F.explode(F.array_distinct(F.array_append(ancestors(F.col("leaf")), F.col("leaf")))))
    return spread.groupBy("folder").agg(F.min_by("c", "pos").alias("c")).select("folder", "c.commit", "c.time")


def folders_with_commits(folders: DataFrame, commits: DataFrame, prefix: str = "") -> DataFrame:
    """Folder rows with their last commit; prefix: where the folders' root lies in the repository."""
    at = F.when(F.col("path") == "", F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "/" if prefix else ""), F.col("path")))
    return folders.withColumn("at", at).join(commits.withColumnRenamed("folder", "at"), "at", "left").drop("at")


def packages_at_folders(folders: DataFrame, packages: DataFrame, targets: DataFrame) -> DataFrame:
    """Folders that are a package's, with its name and number of binaries. packages: package, folder; targets: package, kind."""
    bins = targets.where("kind = 'bin'").groupBy("package").agg(F.count(F.lit(1)).alias("binaries"))
    return folders.select(F.col("path").alias("folder")).join(packages, "folder").join(bins, "package", "left").select("folder", "package", F.coalesce("binaries", F.lit(0)).alias("binaries"))


def tree_rows(paths: DataFrame, open_folders: DataFrame) -> DataFrame:
    """(path, depth, is_file, pos): rows of a tree view: folders first, then names; only what open folders show.

    paths: path, is_file. A row shows if all folders above it are open.
    """
    shut = paths.select("path", F.explode(ancestors(F.col("path"), top=False)).alias("at")).join(open_folders.select(F.col("path").alias("at")), "at", "left_anti").select("path").distinct()
    keyed = paths.join(shut, "path", "left_anti").withColumn("depth", F.size(ancestors(F.col("path"))) - 1)
    order = Window.partitionBy(parent(F.col("path"))).orderBy("is_file", F.lower(name(F.col("path"))), name(F.col("path")))
    return keyed.withColumn("pos", F.row_number().over(order) - 1).select("path", "depth", "is_file", "pos")
