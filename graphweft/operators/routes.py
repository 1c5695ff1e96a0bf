"""Routes, senders and contracts: templates as canonical strings, so that matching them is an equi-join."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphweft.functions.paths import name
from graphweft.operators.spread import tasks


def template_path(text: Column) -> Column:
    """A route's path: query, fragment, scheme and host off. The ? that ends a :name segment belongs to it."""
    bare = F.regexp_replace(F.trim(text), r"(?<!/:[A-Za-z0-9_]{1,200}(?=\?(?:/|$)))\?.*$|#.*$", "")
    return F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def segments(text: Column) -> Column:
    """Typed segments struct(kind, text): literal, param, wildcard or opaque."""

    def typed(part: Column) -> Column:
        kind = (
            F.when(part.rlike(r"^:[A-Za-z0-9_]+[*+]$|^\*[A-Za-z0-9_]*$|^\{\*[A-Za-z0-9_]+\}$"), "wildcard")
            .when(part.rlike(r"^:[A-Za-z0-9_]+$|^\{[A-Za-z0-9_]+\}$"), "param")
            .when(part.rlike(r"^[:*]"), "opaque")
            .when(F.regexp_replace(part, r"\{\{|\}\}", "").rlike(r"[{}]"), "opaque")
            .otherwise("literal")
        )
        return F.struct(kind.alias("kind"), part.alias("text"))

    return F.transform(F.filter(F.split(template_path(text), "/"), lambda p: p != ""), typed)


def canonical(text: Column) -> Column:
    """The template with parameter names erased: {}, wildcards {*}, the root /. A literal brace stays doubled."""
    piece = lambda s: F.when(s["kind"] == "param", "{}").when(s["kind"] == "wildcard", "{*}").otherwise(s["text"])
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(text), piece), "/"))


def joinable(text: Column) -> Column:
    """Whether a template can unify with another at all: it has no wildcard and no opaque segment."""
    return ~F.exists(segments(text), lambda s: s["kind"].isin("wildcard", "opaque"))


def nested(prefix: Column, rest: Column) -> Column:
    """The path of a route whose router is nested under prefix."""
    return F.concat(F.lit("/"), F.array_join(F.concat(F.filter(F.split(template_path(prefix), "/"), lambda p: p != ""), F.filter(F.split(template_path(rest), "/"), lambda p: p != "")), "/"))


def unified(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of templates (a: id, template; b: id, template) that describe the same requests: an equi-join on canonical forms."""
    side = lambda d, n: d.where(joinable(F.col("template"))).select(F.col("id").alias(n), canonical(F.col("template")).alias("canonical"))
    return side(a, "a_id").join(side(b, "b_id"), "canonical").select("a_id", "b_id", "canonical")


def method_matches(tag: Column, entry: Column) -> Column:
    return (tag == entry) | (tag == "ANY") | (entry == "ANY")


def alternatives(tags: DataFrame) -> DataFrame:
    """(id, method, template): methods times templates of each tag."""
    return tags.select("id", F.explode("methods").alias("method"), "templates").select("id", "method", F.explode("templates").alias("template"))


def sender_links(senders: DataFrame, routes: DataFrame) -> DataFrame:
    """(sender, method, template, tier, candidates, steps): what each alternative of a sender reaches.

    senders: sender, method, template; routes: step, method, template, resolved. The template carries the join, the
    method is a residual. One route step all of whose rows are resolved is proven; several are a possible set; else it
    is unresolved.
    """
    r = routes.where(joinable(F.col("template"))).select("step", F.col("method").alias("m"), canonical(F.col("template")).alias("c"), "resolved")
    s = senders.distinct().withColumn("c", F.when(joinable(F.col("template")), canonical(F.col("template"))))
    met = s.join(r, (s["c"] == r["c"]) & method_matches(s["method"], r["m"]), "left")
    counted = met.groupBy("sender", "method", "template").agg(F.array_sort(F.collect_set("step")).alias("steps"), F.coalesce(F.bool_and("resolved"), F.lit(False)).alias("resolved"))
    n = F.size("steps")
    tier = F.when(n > 1, "PossibleSet").when((n == 1) & F.col("resolved"), "Proven").otherwise("Unresolved")
    return counted.select("sender", "method", "template", tier.alias("tier"), n.alias("candidates"), "steps")


def handler_agreement(tags: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, agrees): whether every alternative of a handler's tag matches a route entry of that handler.

    tags: id, handler, methods, templates; routes: handler, method, template.
    """
    every = alternatives(tags).join(tags.select("id", "handler"), "id").withColumn("c", F.when(joinable(F.col("template")), canonical(F.col("template"))))
    r = routes.where(joinable(F.col("template"))).select(F.col("handler").alias("h"), F.col("method").alias("m"), canonical(F.col("template")).alias("rc"))
    missed = every.join(r, (every["handler"] == r["h"]) & (every["c"] == r["rc"]) & method_matches(every["method"], r["m"]), "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return tags.select("id").join(missed, "id", "left").select("id", F.col("n").isNull().alias("agrees"))


def contract_candidates(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, tier, candidates, files): files a contract names exactly, else those it is the end of after a /.

    refs: ref; files: path. Files are met by their last name; a reference that names a whole path takes only that.
    """
    r, f = refs.select("ref").distinct().withColumn("last", name(F.col("ref"))), files.select("path").distinct().withColumn("last", name(F.col("path")))
    met = r.join(f, "last").where((F.col("path") == F.col("ref")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("ref")))).withColumn("whole", F.col("path") == F.col("ref"))
    grouped = met.groupBy("ref").agg(F.bool_or("whole").alias("whole"), F.array_sort(F.collect_set("path")).alias("found"))
    out = refs.select("ref").distinct().join(grouped, "ref", "left").select("ref", F.when(F.col("whole"), F.array("ref")).otherwise(F.coalesce("found", F.array().cast("array<string>"))).alias("files"))
    n = F.size("files")
    return out.select("ref", F.when(n == 0, "Unresolved").when(n == 1, "Proven").otherwise("PossibleSet").alias("tier"), n.alias("candidates"), "files")


def pointer_path(pointer: str) -> str:
    """An RFC 6901 pointer as a variant path."""
    out = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def pointer_exists(json: Column, pointer: str) -> Column:
    """Whether a JSON text holds something at a pointer; a text that isn't JSON holds nothing, a null there is something."""
    value = F.try_variant_get(F.try_parse_json(json), pointer_path(pointer), "variant")
    return F.coalesce(value.isNotNull(), F.lit(False))


def pointer_line(text: str, pointer: str) -> int:
    """The line (from 1) of the key or element a pointer names; 1 for the whole document, 0 if it isn't there.

    One pass over the text: a stack of places, each compared with the pointer where it opens.
    """
    want = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    if not want:
        return 1
    stack: list[list] = []  # [kind, key or index]
    line, i, n = 1, 0, len(text)

    def here() -> bool:
        return [str(s[1]) for s in stack] == want

    fresh = True  # an element or value is due
    while i < n:
        c = text[i]
        if c == "\n":
            line += 1
        elif c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            raw, at = text[i + 1 : j], line
            rest = j + 1
            while rest < n and text[rest] in " \t\r\n":
                rest += 1
            if stack and stack[-1][0] == "{" and rest < n and text[rest] == ":" and fresh:
                import json

                stack[-1][1] = json.loads(f'"{raw}"')
                if here():
                    return at
                fresh = False
            elif stack and stack[-1][0] == "[" and fresh:
                if here():
                    return at
                fresh = False
            i = j
        elif c in "{[":
            if stack and stack[-1][0] == "[" and fresh and here():
                return line
            stack.append([c, 0 if c == "[" else None])
            fresh = True
        elif c in "}]":
            stack.pop() if stack else None
            fresh = False
        elif c == ",":
            if stack and stack[-1][0] == "[":
                stack[-1][1] += 1
            fresh = True
        elif not c.isspace() and c != ":" and stack and stack[-1][0] == "[" and fresh:
            if here():
                return line
            fresh = False
        i += 1
    return 0


def pointer_lines(texts: DataFrame, json: str = "text", pointer: str = "pointer", line: str = "line") -> DataFrame:
    """texts with the line that each row's pointer names in its JSON text (see pointer_line); a null text or pointer gives null."""

    def run(batches):
        for batch in batches:
            at = [None if t is None or p is None else pointer_line(t, p) for t, p in zip(batch.column(json).to_pylist(), batch.column(pointer).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, line])

    dealt = texts.repartition(tasks(texts.sparkSession), json, pointer)  # a pass over a text is slow, and small tables are one partition
    return dealt.mapInArrow(run, StructType([*texts.schema.fields, StructField(line, IntegerType())]))
