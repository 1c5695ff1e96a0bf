"""Packages: targets and dependencies from manifests or from the package manager's own answer, and the crate graph."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.paths import joined, parent
from graphweft.sources.files import parsed

PACKAGE = "package string, version string, edition string, targets array<struct<name:string,kind:string,root:string>>, deps array<struct<name:string,package:string,kind:string,path:string,target:string,optional:boolean,workspace:boolean,line:int>>"


def line_of(text: str, mark: str) -> int:
    """The line (from 1) on which mark first stands; 0 if it doesn't."""
    at = text.find(mark)
    return text.count("\n", 0, at) + 1 if at >= 0 else 0


def _dependencies(table: dict, text: str, target: str | None = None):
    for key, kind in (("dependencies", "normal"), ("build-dependencies", "build"), ("dev-dependencies", "dev")):
        for name, spec in (table.get(key) or {}).items():
            spec = spec if isinstance(spec, dict) else {"version": spec}
            found = re.search(rf'(?m)^\s*"?{re.escape(name)}"?(\.[\w-]+)?\s*=|^\[.*dependencies\.{re.escape(name)}\]', text)
            yield {"name": name, "package": spec.get("package") or name, "kind": kind, "path": spec.get("path"), "target": target, "optional": bool(spec.get("optional")), "workspace": bool(spec.get("workspace")), "line": text.count("\n", 0, found.start()) + 1 if found else 0}
    if target is None:
        for name, own in (table.get("target") or {}).items():
            yield from _dependencies(own, text, name)


def _read_cargo(path: str, text: str):
    table = tomllib.loads(text)
    package = table.get("package")
    if not package:
        return
    value = lambda k, default: package.get(k, default) if not isinstance(package.get(k), dict) else None
    targets = []
    if "lib" in table:
        targets.append({"name": table["lib"].get("name") or package["name"].replace("-", "_"), "kind": "proc-macro" if table["lib"].get("proc-macro") else "lib", "root": table["lib"].get("path", "src/lib.rs")})
    for key, kind, folder in (("bin", "bin", "src/bin"), ("example", "example", "examples"), ("test", "test", "tests"), ("bench", "bench", "benches")):
        targets += [{"name": t.get("name"), "kind": kind, "root": t.get("path") or f"{folder}/{t.get('name')}.rs"} for t in table.get(key, [])]
    if package.get("build", True):
        targets.append({"name": "build-script", "kind": "custom-build", "root": package["build"] if isinstance(package.get("build"), str) else "build.rs"})
    yield package["name"], value("version", None), value("edition", "2015"), targets, list(_dependencies(table, text))


def cargo_packages(files: DataFrame) -> DataFrame:
    """A row for each package manifest (path, text); a manifest that doesn't parse has an error."""
    return parsed(files, _read_cargo, PACKAGE)


def discovered_targets(packages: DataFrame, paths: DataFrame) -> DataFrame:
    """(package, name, kind, root): declared targets whose file exists, and those that lie where the tool looks.

    packages: path, package, targets; paths: path of all files.
    """
    at = packages.select("package", parent(F.col("path")).alias("folder"), "targets")
    told = at.select("package", "folder", F.inline("targets")).select("package", "name", "kind", joined(F.col("folder"), F.col("root")).alias("root"))
    told = told.join(paths.select(F.col("path").alias("root")), "root", "left_semi")
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substr("path", F.length("folder") + 2))
    prefix = F.explode(F.array(F.regexp_replace("path", r"/?(src/(lib|main)\.rs|src/bin/[^/]+(\.rs|/main\.rs)|(examples|tests|benches)/[^/]+(\.rs|/main\.rs))$", "")))
    found = paths.where(F.col("path").rlike(r"(^|/)(src/(lib|main)\.rs|src/bin/[^/]+(\.rs|/main\.rs)|(examples|tests|benches)/[^/]+(\.rs|/main\.rs))$")).select("path", prefix.alias("folder"))
    own = found.join(at.drop("targets"), "folder").withColumn("rest", rest)
    kind = F.when(F.col("rest") == "src/lib.rs", "lib").when(F.col("rest").startswith("src/"), "bin").when(F.col("rest").startswith("examples/"), "example").when(F.col("rest").startswith("tests/"), "test").otherwise("bench")
    name = F.when(F.col("rest").isin("src/lib.rs"), F.replace("package", F.lit("-"), F.lit("_"))).when(F.col("rest") == "src/main.rs", F.col("package")).otherwise(F.regexp_extract("rest", r"/([^/]+?)(?:\.rs|/main\.rs)$", 1))
    auto = own.select("package", name.alias("name"), kind.alias("kind"), F.col("path").alias("root"))
    fresh = auto.join(told.select("package", "root"), ["package", "root"], "left_anti").join(told.where("kind in ('lib', 'proc-macro')").select("package").withColumn("kind", F.lit("lib")), ["package", "kind"], "left_anti")
    return told.select("package", "name", "kind", "root").unionByName(fresh.select("package", "name", "kind", "root")).distinct()


def in_lib_or_bin(modules: DataFrame, targets: DataFrame) -> DataFrame:
    """modules (module, root: the file its crate starts with) that belong to a library or a binary, not to tests, examples or benches."""
    kept = targets.where(F.col("kind").isin("lib", "proc-macro", "bin")).select("root").distinct()
    return modules.join(kept, "root", "left_semi")


def package_deps(packages: DataFrame) -> DataFrame:
    """(package, name, on, kind, path, target, optional, line) of all dependencies; workspace ones take the root's path. path is project-relative.

    packages: path, package, deps; the workspace's own table comes as a package row named '' (see workspace_deps).
    """
    every = packages.select("path", "package", F.inline("deps").alias("name", "on", "kind", "dep_path", "target", "optional", "workspace", "line"))
    folder = parent(F.col("path"))
    own = every.where("package <> ''")
    root = every.where("package = ''").select(F.col("name").alias("w_name"), joined(folder, F.col("dep_path")).alias("w_path"), F.col("on").alias("w_on"))
    met = own.join(root, F.col("workspace") & (F.col("name") == F.col("w_name")), "left")
    return met.select("package", "name", F.coalesce("w_on", "on").alias("on"), "kind", F.coalesce("w_path", joined(folder, F.col("dep_path"))).alias("path"), "target", "optional", "line")


def workspace_deps(files: DataFrame) -> DataFrame:
    """The shared dependency tables of workspace roots, as rows of packages with an empty name."""

    def read(path: str, text: str):
        table = tomllib.loads(text).get("workspace", {})
        if table.get("dependencies"):
            yield "", None, None, [], list(_dependencies({"dependencies": table["dependencies"]}, text))

    return parsed(files, read, PACKAGE)


def crate_graph(packages: DataFrame, deps: DataFrame) -> DataFrame:
    """(package, extern, on, gated): the names a package's code may use, and whether each is conditional.

    A name is gated if it is optional, only for some target, or differs between targets. Dev dependencies stay out.
    """
    known = packages.select(F.col("package").alias("on")).distinct().withColumn("local", F.lit(True))
    kept = deps.where("kind <> 'dev'").withColumn("extern", F.replace("name", F.lit("-"), F.lit("_")))
    grouped = kept.groupBy("package", "extern").agg(F.min("on").alias("on"), (F.bool_and(F.coalesce("optional", F.lit(False)) | F.col("target").isNotNull()) | (F.count_distinct("on") > 1)).alias("gated"))
    return grouped.join(known, "on", "left").select("package", "extern", "on", "gated", F.coalesce("local", F.lit(False)).alias("local"))


def metadata_packages(answers: DataFrame) -> DataFrame:
    """The same rows from the package manager's JSON answers (path, text), which win where they are."""

    def read(path: str, text: str):
        for p in json.loads(text)["packages"]:
            targets = [{"name": t["name"], "kind": t["kind"][0], "root": t["src_path"]} for t in p.get("targets", [])]
            deps = [{"name": d.get("rename") or d["name"], "package": d["name"], "kind": d.get("kind") or "normal", "path": d.get("path"), "target": d.get("target"), "optional": d.get("optional", False), "workspace": False, "line": 0} for d in p.get("dependencies", [])]
            yield p["name"], p.get("version"), p.get("edition"), targets, deps

    return parsed(answers, read, PACKAGE)


def with_fallback(answers: DataFrame, manifests: DataFrame) -> DataFrame:
    """Packages as the manager tells them, and those it couldn't read from their manifests."""
    own = answers.where("error is null")
    return own.unionByName(manifests.where("error is null").join(own.select("package"), "package", "left_anti"))


def other_packages(files: DataFrame) -> DataFrame:
    """(path, package) of package.json, pyproject.toml and go.mod manifests."""

    def read(path: str, text: str):
        name = path.rsplit("/", 1)[-1]
        if name == "package.json":
            yield (json.loads(text).get("name"),)
        elif name == "pyproject.toml":
            table = tomllib.loads(text)
            yield (table.get("project", {}).get("name") or table.get("tool", {}).get("poetry", {}).get("name"),)
        elif name == "go.mod":
            yield (m.group(1) if (m := re.search(r"(?m)^module\s+(\S+)", text)) else None,)

    return parsed(files, read, "package string").where("package is not null").select("path", "package")
