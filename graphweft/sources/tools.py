"""Tools: aliases, binaries, scripts, targets, recipes, workflows and nested commands, as an adjacency list."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.text import kebab_case
from graphweft.operators.order import running
from graphweft.sources.files import parsed
from graphweft.sources.manifests import line_of
from graphweft.storage import settle

TOOL = "id string, parent string, kind string, name string, invocation string, description string, line int"


def _above(lines: list[str], i: int) -> str | None:
    """What a comment right above a line says."""
    text = lines[i - 1].strip() if i else ""
    return (text.strip("#").strip() or None) if text.startswith("#") else None


def _in(path: str, command: str) -> str:
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    return f"cd {folder} && {command}" if folder else command


def _make(path: str, text: str):
    lines, seen = text.splitlines(), set()
    for i, line in enumerate(lines):
        m = re.match(r"([^\s#.=%$(:][^=%$(:]*):(?!=)(.*)$", line)
        if not m:
            continue
        told = m[2].split("##", 1)[1].strip() if "##" in m[2] else _above(lines, i)
        for name in m[1].split():
            if name not in seen:
                seen.add(name)
                yield f"{path}#{name}", None, "make", name, _in(path, f"make {name}"), told, i + 1


def _just(path: str, text: str):
    lines = text.splitlines()
    for i, line in enumerate(lines):
        m = re.match(r"@?([\w-]+)(?:\s[^:]*)?:(?!=)", line)
        if m and m[1] not in ("set", "alias", "export", "import", "mod"):
            yield f"{path}#{m[1]}", None, "just", m[1], _in(path, f"just {m[1]}"), _above(lines, i), i + 1


def _npm(path: str, text: str):
    for name, command in (json.loads(text).get("scripts") or {}).items():
        yield f"{path}#{name}", None, "npm", name, _in(path, f"npm run {name}"), command if isinstance(command, str) else None, line_of(text, f'"{name}"')


def _aliases(path: str, text: str):
    for name, words in (tomllib.loads(text).get("alias") or {}).items():
        said = words if isinstance(words, str) else " ".join(w for w in words if isinstance(w, str))
        yield f"{path}#{name}", None, "cargo alias", name, f"cargo {name}", f"cargo {said}", line_of(text, name)


def _workflow(path: str, text: str):
    """The workflow and its jobs, by indentation: names are keys under jobs."""
    lines = text.splitlines()
    title = next((m[1].strip("\"' ") for x in lines if (m := re.match(r"name:\s*(.+)$", x))), path.rsplit("/", 1)[-1])
    yield path, None, "workflow", title, path, None, 1
    inside, depth = False, None
    for n, line in enumerate(lines, 1):
        if re.match(r"\S", line):
            inside = line.startswith("jobs:")
        elif inside and (m := re.match(r"(\s+)([\w-]+):\s*(#.*)?$", line)):
            depth = depth or len(m[1])
            if len(m[1]) == depth:
                yield f"{path}#{m[2]}", path, "job", m[2], path, None, n


def _commands(path: str, text: str):
    """Variants of enums that derive subcommands, with the enum each one holds; nesting is joined later by name."""
    for m in re.finditer(r"#\[derive\([^)]*Subcommand[^)]*\)\]\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)\s*\{", text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        body, start = text[m.end() : at - 1], text.count("\n", 0, m.end()) + 1
        flat, level = "", 0
        for c in body:
            level -= c in ")}"
            flat += c if level == 0 or c in "\n" else "\0" if c in "\n" else c if level == 1 else " "
            level += c in "({"
        for v in re.finditer(r"(?m)^\s*(?:///\s?(.*)\n\s*)?(?:#\[[^\]]*?(?:name\s*=\s*\"([^\"]+)\")?[^\]]*\]\s*)*([A-Z]\w*)\s*(?:\(([^)]*)\)|\{([^}]*)\})?\s*,?\s*$", flat):
            held = re.search(r"([A-Z]\w*)\s*(?:>|$|,)", (v[4] or v[5] or "").strip())
            yield f"{path}#{m[1]}::{v[3]}", m[1], "command", v[2] or v[3], held[1] if held else None, (v[1] or "").strip() or None, start + flat.count("\n", 0, v.start(3))


def _read(path: str, text: str):
    name = path.rsplit("/", 1)[-1]
    if name in ("Makefile", "GNUmakefile") or name.endswith(".mk"):
        return _make(path, text)
    if name.lower() in ("justfile", ".justfile"):
        return _just(path, text)
    if name == "package.json":
        return _npm(path, text)
    if path.endswith((".cargo/config.toml", ".cargo/config")):
        return _aliases(path, text)
    if ".github/workflows/" in f"/{path}" and name.endswith((".yml", ".yaml")):
        return _workflow(path, text)
    return _commands(path, text) if name.endswith(".rs") else ()


def discover_tools(files: DataFrame) -> DataFrame:
    """Tools of all files (path, text) but commands: id, parent, kind, name, invocation, description, line."""
    return parsed(files, _read, TOOL).where("kind is null or kind <> 'command'")


def command_variants(files: DataFrame) -> DataFrame:
    """(enum, name, holds, description, path, line) of subcommand enums; names not given are kebab case."""
    rows = parsed(files, _read, TOOL).where("kind = 'command'")
    ident = F.regexp_extract("id", r"::(\w+)$", 1)
    return rows.select(F.col("parent").alias("enum"), F.when(F.col("name") == ident, kebab_case(F.col("name"))).otherwise(F.col("name")).alias("name"), F.col("invocation").alias("holds"), "description", "path", "line")


def find_enums(wanted: DataFrame, enums: DataFrame, closure: DataFrame) -> DataFrame:
    """(package, type, found_in): the enum of a bare name in a package's dependency closure, its own package first.

    wanted: package, type; enums: package, enum; closure: package, on, hop (itself at 0).
    """
    e = enums.select(F.col("package").alias("on"), F.col("enum").alias("type"))
    return wanted.join(closure, "package").join(e, ["on", "type"]).groupBy("package", "type").agg(F.min_by("on", F.struct("hop", "on")).alias("found_in"))


def preorder(tools: DataFrame) -> DataFrame:
    """tools (id, parent, line, name) with depth and position of a depth-first walk: keys are arrays of (line, name) from the root.

    Levels go on until one is empty, each written; what no root leads to isn't walked. Positions are numbered by ranges.
    """
    step = F.struct("line", "name", "id")
    below = settle(tools.where("parent is not null").select("id", F.col("parent").alias("of"), step.alias("step")))
    level = settle(tools.where("parent is null").select("id", F.array(step).alias("key")))
    out = level
    while not level.isEmpty():
        level = settle(below.join(level.select(F.col("id").alias("of"), "key"), "of").select("id", F.concat("key", F.array("step")).alias("key")))
        out = out.unionAll(level)
    return running(out, "key").select("id", (F.size("key") - 1).alias("depth"), F.col("before").cast("int").alias("pos"))


def in_kebab(name: Column) -> Column:
    return kebab_case(name)
