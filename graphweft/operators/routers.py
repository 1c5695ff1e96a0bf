"""Route tables out of router code: builder chains are evaluated abstractly, one crate's functions at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from graphweft.operators.extract import Text
from graphweft.operators.spread import tasks

ROUTE = "crate string, root string, method string, template string, handler string, condition string, path string, line int"
SKIPPED = "crate string, path string, line int, reason string"
METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "trace", "any")


def _arguments(code: str, text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Ranges of the arguments between the parentheses that open at at, and the offset behind them."""
    depth, start, out, i = 0, at + 1, [], at
    while i < len(code):
        c = code[i]
        depth += (c in "([{") - (c in ")]}")
        if (c == "," and depth == 1) or depth == 0:
            if text[start:i].strip():
                out.append((start, i))
            start = i + 1
            if depth == 0:
                return out, i + 1
        i += 1
    return out, i


class Evaluator:
    """Routers of a crate's functions by name; a function is evaluated once, and not inside itself."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.functions: dict[str, tuple[str, Text, int, int]] = {}
        self.skipped: list[tuple[str, int, str]] = []
        self.known: dict[str, list[tuple]] = {}
        self.called: set[str] = set()
        for path, text in files:
            t = Text(text, "rust")
            for m in re.finditer(r"\bfn\s+(\w+)[^{;]*->\s*[^{;]*\bRouter\b[^{;]*\{", t.code):
                self.functions[m[1]] = (path, t, m.end() - 1, t.close(m.end() - 1))

    def routes(self, name: str, inside: tuple[str, ...] = ()) -> list[tuple]:
        """(method, template, handler, condition, path, line) of a function's router."""
        if name in inside:
            path, t, a, _ = self.functions[name]
            self.skipped.append((path, t.line(a), "a router that holds itself"))
            return []
        if name not in self.known:
            path, t, a, b = self.functions[name]
            self.known[name] = self._block(path, t, a + 1, b, {}, None, (*inside, name))
        return self.known[name]

    def _block(self, path, t, a, b, names, condition, inside) -> list[tuple]:
        """The value of a block: its let bindings, rebindings under conditions, and its last expression."""
        at, value = a, []
        names = dict(names)
        while at < b:
            m = re.compile(r"\s*(?:let\s+(?:mut\s+)?(\w+)(?:\s*:[^=;]+)?\s*=\s*|(\w+)\s*=\s*(?!=)|if\s+|return\s+)?").match(t.code, at)
            head = m.group().strip()
            at = m.end()
            if at >= b:
                break
            if head.startswith("if"):
                brace = t.code.find("{", at, b)
                if brace < 0:
                    break
                test, end = " ".join(t.text[at:brace].split()), t.close(brace)
                both = f"{condition} && {test}" if condition else test
                for n in re.finditer(r"(\w+)\s*=\s*(?!=)", t.code[brace:end]):
                    if n[1] in names:
                        stop = self._end(t, brace + n.end(), end)
                        names[n[1]] = self._chain(path, t, brace + n.end(), stop, names, both, inside)
                at = end + 1
                continue
            stop = self._end(t, at, b)
            found = self._chain(path, t, at, stop, names, condition, inside)
            if m[1] or m[2]:
                names[m[1] or m[2]] = found
            elif found:
                value = found
            at = stop + 1
        return value

    @staticmethod
    def _end(t: Text, at: int, b: int) -> int:
        depth = 0
        for i in range(at, b):
            depth += (t.code[i] in "([{") - (t.code[i] in ")]}")
            if t.code[i] == ";" and depth == 0:
                return i
        return b

    def _chain(self, path, t, a, b, names, condition, inside) -> list[tuple]:
        """A router expression: a start and the builder calls on it."""
        m = re.compile(r"\s*([\w:]+)(?:::<[^>]*>)?\s*(\(?)").match(t.code, a, b)
        if not m:
            return []
        last = m[1].split("::")[-1]
        at = m.end() if not m[2] else _arguments(t.code, t.text, m.end() - 1)[1]
        if last in names and not m[2]:
            routes = list(names[last])
        elif m[2] and last in self.functions and "Router" not in m[1]:
            self.called.add(last)
            routes = list(self.routes(last, inside))
        elif m[1].endswith(("Router::new", "Router::default")):
            routes = []
        else:
            return []
        while call := re.compile(r"\s*\.\s*(\w+)(?:::<[^>]*>)?\s*\(").match(t.code, at, b):
            args, at = _arguments(t.code, t.text, call.end() - 1)
            line = t.line(call.start(1))
            if call[1] in ("route", "nest", "route_service", "nest_service"):
                text = t.text[slice(*args[0])].strip() if args else ""
                if len(args) < 2 or not re.fullmatch(r'r?"[^"]*"', text):
                    self.skipped.append((path, line, "a path that isn't a literal"))
                    continue
                template = text.lstrip("r").strip('"')
                if call[1] == "route":
                    for method, handler in self._handlers(t, *args[1]):
                        routes.append((method, template, handler, condition, path, line))
                elif call[1] == "nest":
                    inner = self._chain(path, t, *args[1], names, condition, inside)
                    routes += [(r[0], "/" + "/".join(x for x in f"{template}/{r[1]}".split("/") if x), *r[2:]) for r in inner]
                else:
                    self.skipped.append((path, line, "a service"))
            elif call[1] == "merge" and args:
                routes += self._chain(path, t, *args[0], names, condition, inside)
        return routes

    @staticmethod
    def _handlers(t: Text, a: int, b: int):
        at = a
        while m := re.compile(r"\s*\.?\s*(?:\w+::)*(\w+)\s*\(").match(t.code, at, b):
            args, at = _arguments(t.code, t.text, m.end() - 1)
            if m[1] in METHODS and args:
                yield m[1].upper(), t.text[slice(*args[0])].strip()


def evaluate(files: DataFrame) -> DataFrame:
    """(crate, root, method, template, handler, condition, path, line) of routers (crate, path, text).

    Roots are functions that give a router and that no other router uses. A crate's sources are one group: a name's
    meaning depends on all of them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = Evaluator(list(zip(pdf["path"], pdf["text"], strict=True)))
        tables = {name: e.routes(name) for name in sorted(e.functions)}
        rows = [(pdf["crate"].iloc[0], root, *r) for root, routes in tables.items() if root not in e.called for r in routes]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ROUTE.split(", ")])

    return _routers(files).groupBy("crate").applyInPandas(run, ROUTE)


def skipped(files: DataFrame) -> DataFrame:
    """(crate, path, line, reason): router calls that can't be evaluated."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = Evaluator(list(zip(pdf["path"], pdf["text"], strict=True)))
        for name in sorted(e.functions):
            e.routes(name)
        return pd.DataFrame(sorted({(pdf["crate"].iloc[0], *s) for s in e.skipped}), columns=["crate", "path", "line", "reason"])

    return _routers(files).groupBy("crate").applyInPandas(run, SKIPPED)


def _routers(files: DataFrame) -> DataFrame:
    """Sources with routers, dealt out by crate: crates are many and small, and their evaluation is slow."""
    return files.where("contains(text, 'Router')").select("crate", "path", "text").repartition(tasks(files.sparkSession), "crate")
