"""Settings sheets as facts with lines, and the shape of JSON Schemas."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import DataFrame

from graphweft.sources.files import parsed

FACT = "sheet string, section string, key string, value string, line int"
SCHEMA_SHAPE = "title string, kind string, properties int, required int, definitions int, refs int, formats array<string>"


def _flat(table: dict, prefix: str = ""):
    for key, value in table.items():
        if isinstance(value, dict):
            yield from _flat(value, f"{prefix}{key}.")
        else:
            yield prefix.rstrip("."), key, value


def _shown(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, default=str)


def _toml_facts(path: str, text: str):
    lines = text.split("\n")
    for section, key, value in _flat(tomllib.loads(text)):
        at = 0
        if section:
            heads = [i for i, x in enumerate(lines) if x.strip().strip("[]").replace('"', "").strip() == section and x.strip().startswith("[")]
            at = heads[0] if heads else 0
        own = [i for i in range(at, len(lines)) if re.match(rf'\s*"?{re.escape(key)}"?\s*=', lines[i])]
        yield path.rsplit("/", 1)[-1], section, key, _shown(value), own[0] + 1 if own else 0


def _editorconfig(path: str, text: str):
    section = ""
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1]
        elif "=" in line and not line.startswith(("#", ";")):
            key, _, value = line.partition("=")
            yield ".editorconfig", section, key.strip().lower(), value.strip(), n


def _gitattributes(path: str, text: str):
    for n, line in enumerate(text.splitlines(), 1):
        words = line.split()
        if words and not words[0].startswith("#"):
            for a in words[1:]:
                key, _, value = a.lstrip("-!").partition("=")
                yield ".gitattributes", words[0], key, "unset" if a.startswith("-") else "unspecified" if a.startswith("!") else value or "set", n


def _gitignore(path: str, text: str):
    """Patterns under the comment line last above them; a blank line ends a heading."""
    heading = ""
    for n, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if not bare:
            heading = ""
        elif bare.startswith("#"):
            heading = bare.lstrip("#").strip()
        else:
            yield ".gitignore", heading, bare, "include" if bare.startswith("!") else "ignore", n


def _facts(path: str, text: str):
    name = path.rsplit("/", 1)[-1]
    reader = {".editorconfig": _editorconfig, ".gitattributes": _gitattributes, ".gitignore": _gitignore}.get(name, _toml_facts if name.endswith(".toml") else None)
    return reader(path, text) if reader else ()


def settings_facts(files: DataFrame) -> DataFrame:
    """(path, sheet, section, key, value, line) of manifests, toolchain, lint, format, editor, ignore and attribute files (path, text)."""
    return parsed(files, _facts, FACT)


def _shape(path: str, text: str):
    value = json.loads(text)
    if not isinstance(value, dict) or "$schema" not in value:
        return
    count, formats, todo = {"properties": 0, "required": 0, "definitions": 0, "refs": 0}, set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += x
        elif isinstance(x, dict):
            count["properties"] += len(x["properties"]) if isinstance(x.get("properties"), dict) else 0
            count["required"] += len(x["required"]) if isinstance(x.get("required"), list) else 0
            count["definitions"] += sum(len(x[k]) for k in ("definitions", "$defs") if isinstance(x.get(k), dict))
            count["refs"] += isinstance(x.get("$ref"), str)
            formats |= {x["format"]} if isinstance(x.get("format"), str) else set()
            todo += x.values()
    kind = value.get("type") if isinstance(value.get("type"), str) else None
    yield value.get("title"), kind, *count.values(), sorted(formats)


def schema_shapes(files: DataFrame) -> DataFrame:
    """The shape of each JSON file (path, text) that has a $schema."""
    return parsed(files, _shape, SCHEMA_SHAPE)
