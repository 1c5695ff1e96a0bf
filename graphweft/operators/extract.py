"""Items out of source texts: scanners over text whose comments and strings are blanked, one row an item.

Files (path, text) become items by a map over rows; a file that fails gives a row with its error.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.sources.files import parsed
from graphweft.storage import settle

ITEM = "kind string, name string, owner string, visibility string, signature string, line int, line_end int, docs string, calls array<string>, bases array<string>"
FAMILIES = {
    "rust": ("rs",),
    "python": ("py", "pyi"),
    "go": ("go",),
    "script": ("js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx"),
    "brace": ("java", "kt", "kts", "cs", "swift", "scala", "dart", "php", "c", "h", "cc", "cpp", "cxx", "hpp", "hh"),
    "ruby": ("rb",),
    "lua": ("lua",),
    "shell": ("sh", "bash"),
    "markdown": ("md", "markdown"),
}
BLANK = {
    "hash": re.compile(r"#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL),
    "rust": re.compile(r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.DOTALL),
    "slash": re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL),
    "lua": re.compile(r"--\[\[.*?\]\]|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL),
}
NO_CALLS = frozenset("if while for match switch return catch function fn func def elif and or not in when with assert sizeof typeof await new class else loop let move async unsafe Some Ok Err None".split())


def family_of(path: str, text: str = "") -> str | None:
    """Which scanner reads a file; a .c file that looks like Enforce Script is that."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension == "c" and re.search(r"(?m)^\s*(?:modded\s+class|class\s+\w+\s*(?::|extends)\s*\w+|override\s+\w)", text):
        return "enforce"
    return next((f for f, ends in FAMILIES.items() if extension in ends), None)


def blanked(text: str, family: str) -> str:
    """text with comments and strings turned into spaces, line breaks kept: offsets stay."""
    rule = BLANK["rust" if family == "rust" else "hash" if family in ("python", "ruby", "shell") else "lua" if family == "lua" else "slash"]
    return rule.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


class Text:
    """A text, its blanked form, lines by offset, and matching braces."""

    def __init__(self, text: str, family: str) -> None:
        self.text, self.code = text, blanked(text, family)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def close(self, at: int) -> int:
        """The offset of the brace that closes the one at at; the text's end if none does."""
        depth = 0
        for m in re.compile(r"[{}]").finditer(self.code, at):
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return m.start()
        return len(self.code) - 1

    def docs(self, at: int, mark: str) -> str | None:
        """The comment lines right above the line of at."""
        lines, n, out = self.text.split("\n"), self.line(at) - 2, []
        while n >= 0 and (s := lines[n].strip()) and (s.startswith(mark) or s.startswith(("#[", "@"))):
            if s.startswith(mark):
                out.append(s[len(mark) :].strip())
            n -= 1
        return "\n".join(reversed(out)) or None

    def calls(self, a: int, b: int) -> list[str]:
        """Names called between two offsets, each once, in order."""
        found = (m[1] for m in re.finditer(r"([A-Za-z_][\w]*(?:(?:::|\.)[A-Za-z_]\w*)*)\s*!?\(", self.code[a:b]))
        return list(dict.fromkeys(x for x in found if x.split(".")[-1].split("::")[-1] not in NO_CALLS and x not in NO_CALLS))


def _rows_by_braces(t: Text, patterns: list[tuple[str, re.Pattern]], mark: str, private: str):
    """Items that patterns find; owners are the innermost class-like items around, functions in functions fold into the outer one."""
    found = []
    for kind, rule in patterns:
        for m in rule.finditer(t.code):
            brace = t.code.find("{", m.end() - 1)
            stop = t.code.find(";", m.end() - 1)
            bodied = brace >= 0 and (stop < 0 or brace < stop)
            end = t.close(brace) if bodied else (stop if stop >= 0 else m.end())
            found.append((m.start("name"), end, kind, m, brace if bodied else None))
    found.sort(key=lambda x: (x[0], -x[1]))
    stack: list[tuple] = []
    for start, end, kind, m, brace in found:
        while stack and stack[-1][1] < start:
            stack.pop()
        if kind == "fn" and any(s[2] == "fn" for s in stack):
            continue
        owner = next((s[3]["name"] for s in reversed(stack) if s[2] in ("struct", "impl", "trait", "class", "enum")), None)
        named = m.groupdict()
        bases = [b.strip().split("<")[0].split(".")[-1].split("::")[-1] for b in re.split(r",|\bimplements\b|\+", named.get("bases") or "") if b.strip()]
        signature = " ".join(t.text[t.text.rfind("\n", 0, m.start()) + 1 if m.start() else 0 : brace if brace else end].split())
        calls = t.calls(brace, end) if kind == "fn" and brace else []
        yield kind, m["name"], owner, (named.get("vis") or "").strip() or private, signature[:400], t.line(start), t.line(end), t.docs(m.start("name"), mark), calls, bases
        stack.append((start, end, kind, m))


RUST = [
    ("fn", re.compile(r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*\bfn\s+(?P<name>\w+)")),
    ("struct", re.compile(r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?\bstruct\s+(?P<name>\w+)")),
    ("enum", re.compile(r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?\benum\s+(?P<name>\w+)")),
    ("trait", re.compile(r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?\btrait\s+(?P<name>\w+)")),
    ("impl", re.compile(r"(?m)^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:(?P<bases>[\w:<>, ]+?)\s+for\s+)?(?P<name>\w+)")),
]
SCRIPT = [
    ("class", re.compile(r"(?P<vis>\bexport\s+(?:default\s+)?)?(?:abstract\s+)?\bclass\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.]+(?:\s+implements\s+[\w., ]+)?))?")),
    ("trait", re.compile(r"(?P<vis>\bexport\s+)?\binterface\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w., ]+))?")),
    ("enum", re.compile(r"(?P<vis>\bexport\s+)?(?:const\s+)?\benum\s+(?P<name>\w+)")),
    ("fn", re.compile(r"(?P<vis>\bexport\s+(?:default\s+)?)?(?:async\s+)?\bfunction\s*\*?\s*(?P<name>\w+)")),
    ("fn", re.compile(r"(?m)^\s*(?P<vis>export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|\w+)\s*(?::\s*[\w<>\[\], ]+)?=>\s*")),
    ("fn", re.compile(r"(?m)^\s+(?P<vis>(?:public|private|protected|static|async|readonly)\s+)*(?!if|for|while|switch|catch|return|function|else)(?P<name>#?\w+)\s*\([^;{}\n]*\)\s*(?::\s*[\w<>\[\]|., ]+)?\s*(?=\{)")),
]
BRACE = [
    ("class", re.compile(r"(?P<vis>\b(?:public|private|protected|internal|export)\s+)?(?:(?:static|final|abstract|sealed|partial|data|open)\s+)*\b(?:class|struct|record|object|interface|trait|protocol)\s+(?P<name>\w+)(?:\s*(?:\([^)]*\))?\s*(?::|extends|implements)\s*(?P<bases>[\w<>:., ]+?))?\s*(?=\{|where)")),
    ("enum", re.compile(r"(?P<vis>\b(?:public|private|internal)\s+)?\benum\s+(?:class\s+)?(?P<name>\w+)")),
    ("fn", re.compile(r"(?m)^\s*(?P<vis>(?:public|private|protected|internal)\s+)?(?:(?:static|final|override|virtual|async|inline|suspend|abstract|open|const|function|fun|func|def)\s+)*(?:[\w:<>\[\],*&?]+\s+)?[*&]?(?!if|for|while|switch|catch|return|else|new)(?P<name>~?\w+)\s*\([^;{}]*\)\s*(?:(?:const|noexcept|throws\s+[\w., ]+|->\s*[\w<>?]+|:\s*[\w<>?]+)\s*)*(?=\{)")),
]
GO = [
    ("struct", re.compile(r"\btype\s+(?P<name>\w+)\s+struct\b")),
    ("trait", re.compile(r"\btype\s+(?P<name>\w+)\s+interface\b")),
    ("fn", re.compile(r"(?m)^func\s+(?:\(\s*\w+\s+\*?(?P<bases>\w+)[^)]*\)\s*)?(?P<name>\w+)")),
]
ENFORCE = [
    ("class", re.compile(r"(?P<vis>\b(?:modded|sealed)\s+)?\bclass\s+(?P<name>\w+)(?:\s*<[^>{]*>)?(?:\s*(?::|extends)\s*(?P<bases>\w+))?")),
    ("enum", re.compile(r"\benum\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>\w+))?")),
    ("fn", re.compile(r"(?m)^\s*(?P<vis>(?:private|protected)\s+)?(?:(?:override|static|proto|external|event|native|ref|const|sealed|thread)\s+)*[\w<>\[\]]+\s+(?!if|for|while|switch|return|else|new)(?P<name>~?\w+)\s*\([^;{}]*\)\s*(?=\{|;)")),
]


def _python(t: Text):
    """Definitions by indentation."""
    lines = t.code.split("\n")
    found = []
    for m in re.finditer(r"(?m)^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)\s*(?:\(([^)]*)\))?", t.code):
        depth, n = len(m[1].expandtabs()), t.line(m.start(2)) - 1
        end = n
        for k in range(n + 1, len(lines)):
            if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= depth and not lines[k].strip().startswith(")"):
                break
            end = k if t.text.split("\n")[k].strip() else end
        found.append((m, depth, n, end))
    stack: list[tuple] = []
    for m, depth, n, end in found:
        while stack and stack[-1][1] >= depth:
            stack.pop()
        kind = "class" if m[2] == "class" else "fn"
        if not (kind == "fn" and any(s[0][2] == "def" for s in stack)):
            owner = next((s[0][3] for s in reversed(stack) if s[0][2] == "class"), None)
            doc = re.match(r'\s*(?:r?"""(.*?)"""|\'\'\'(.*?)\'\'\')', t.text[t.text.find(":", m.end()) + 1 :], re.DOTALL)
            a, b = t.starts[n], t.starts[end + 1] if end + 1 < len(t.starts) else len(t.code)
            bases = [x.split("=")[0].strip().split(".")[-1] for x in (m[4] or "").split(",") if x.strip()] if kind == "class" else []
            yield kind, m[3], owner, "private" if m[3].startswith("_") else "public", " ".join(m.group().split()), n + 1, end + 1, (doc[1] or doc[2] or "").strip() or None if doc else None, t.calls(m.end(), b) if kind == "fn" else [], bases
            del a
        stack.append((m, depth))


def _keyword_blocks(t: Text, rule: re.Pattern, mark: str):
    """Functions and classes of languages that end blocks with a word: one line each, to the next at no greater depth."""
    found = list(rule.finditer(t.code))
    for i, m in enumerate(found):
        depth = len(m[1])
        stop = next((x.start() for x in found[i + 1 :] if len(x[1]) <= depth), len(t.code))
        yield ("class" if m[2] in ("class", "module") else "fn"), m[3].split(":")[-1].split(".")[-1], None, "public", m.group().strip(), t.line(m.start(2)), t.line(max(m.start(2), stop - 1)), t.docs(m.start(2), mark), t.calls(m.end(), stop), []


def _markdown(text: str):
    """Headings, fenced blocks and links; nothing inside a fence is a heading or link."""
    fence, opened, title, n = None, 0, "", 0
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\s{0,3}(`{3,}|~{3,})\s*([\w+-]*)", line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                yield "block", title, None, None, None, opened, n, None, [], []
                fence = None
            continue
        if m:
            fence, opened, title = m[1], n, m[2]
            continue
        if h := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            yield "heading", h[2], str(len(h[1])), None, line.strip(), n, n, None, [], []
        for link in re.finditer(r"(?<!!)\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)", re.sub(r"`[^`]*`", lambda x: " " * len(x.group()), line)):
            yield "link", link[2], link[1], None, None, n, n, None, [], []
    if fence:
        yield "block", title, None, None, None, opened, n, None, [], []


def _uses(t: Text, family: str):
    """Imports as written, one row each; Rust's trees are spread to leaves."""
    if family == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", t.code):
            for leaf in use_leaves(m[1]):
                yield "use", leaf, None, None, None, t.line(m.start()), t.line(m.end()), None, [], []
        return
    rules = {"python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "script": r"(?:\bfrom\s+|\brequire\(\s*|\bimport\s+\(?\s*)['\"]([^'\"\n]+)['\"]", "go": r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", "brace": r"(?m)^\s*(?:import|using|#include)\s+(?:static\s+)?[<\"]?([\w./*:]+)[>\"]?", "lua": r"require\s*\(?\s*['\"]([^'\"]+)", "ruby": r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)", "shell": r"(?m)^\s*(?:source|\.)\s+(\S+)"}
    for m in re.finditer(rules.get(family, r"(?!)"), t.text):
        at = m.start(m.lastindex)
        yield "use", m[m.lastindex], None, None, None, t.line(at), t.line(m.end()), None, [], []


def use_leaves(tree: str, prefix: str = "") -> list[str]:
    """a::{b, c::{d, self}} as whole paths; ' as ' names stay."""
    tree = tree.strip()
    head, brace, rest = tree.partition("{")
    if not brace:
        whole = f"{prefix}{tree}"
        return [re.sub(r"::self\b", "", whole)] if tree else []
    depth, part, out = 0, "", []
    for c in rest[: rest.rfind("}")] + ",":
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c == "," and not depth:
            out += use_leaves(part, prefix + head.strip())
            part = ""
        else:
            part += c
    return out


def read_items(path: str, text: str):
    family = family_of(path, text)
    if family is None:
        return
    if family == "markdown":
        yield from _markdown(text)
        return
    lines = [x for x in text.splitlines() if x.strip()][:10]
    if lines and sum(len(x.encode()) for x in lines) // len(lines) > 400:
        return  # minified
    t = Text(text, family)
    yield from _uses(t, family)
    if family == "python":
        yield from _python(t)
    elif family in ("ruby", "lua", "shell"):
        rule = {"ruby": r"(?m)^([ \t]*)(def|class|module)\s+([\w.:]+)", "lua": r"(?m)^([ \t]*)(?:local\s+)?(function)\s+([\w.:]+)", "shell": r"(?m)^([ \t]*)(function\s+|)(\w+)\s*\(\)"}[family]
        yield from _keyword_blocks(t, re.compile(rule), "--" if family == "lua" else "#")
    else:
        patterns = {"rust": RUST, "script": SCRIPT, "go": GO, "enforce": ENFORCE}.get(family, BRACE)
        yield from _rows_by_braces(t, patterns, "///" if family == "rust" else "//", "private" if family == "rust" else "public")


def items(files: DataFrame) -> DataFrame:
    """All items of files (path, text): see ITEM. A file that fails is a row with an error."""
    return parsed(files, read_items, ITEM)


FACT = "kind string, name string, line int, line_end int, module string, attributes array<string>, gate string"


def read_rust_facts(path: str, text: str):
    """Modules, items, imports and calls of a Rust file with the inline module they stand in, attributes and cfg gates.

    gate: the cfg conditions of the attributes right above and of the inline modules and items around, joined by ' & ';
    null: none. A call is gated as what it stands in; a module without a body is one, too (its file's name is the
    resolver's).
    """
    if family_of(path, text) != "rust":
        return
    t = Text(text, "rust")

    def above(at: int) -> list[str]:
        """Attributes that end right before the offset at, in order; their texts keep strings."""
        out, end = [], at
        while m := re.search(r"#\[[^\n]*\][ \t]*\n?\s*$|#\[(?:[^\]]|\n)*\]\s*$", t.code[:end][-2000:]):
            start = max(0, end - 2000) + m.start()
            out.append(" ".join(t.text[start:end].strip().removeprefix("#[").rstrip().removesuffix("]").split()))
            end = start
        return out[::-1]

    cfg = lambda attributes: [a for a in attributes if a.startswith("cfg(")]
    heads = [(m.start(), m, "mod") for m in re.finditer(r"(?:\bpub(?:\([^)]*\))?\s+)?\bmod\s+(?P<name>\w+)\s*(?P<open>[{;])", t.code)]
    heads += [(m.start(), m, kind) for kind, rule in RUST for m in rule.finditer(t.code)]
    heads += [(m.start(), m, "use") for m in re.finditer(r"(?:\bpub(?:\([^)]*\))?\s+)?\buse\s+(?P<name>[^;]+);", t.code)]
    stack: list[tuple[int, str, str, list[str]]] = []  # end, kind, name, conditions
    spans = []
    for at, m, kind in sorted(heads, key=lambda h: (h[0], -h[1].end())):
        while stack and stack[-1][0] < at:
            stack.pop()
        start = at + len(m.group()) - len(m.group().lstrip())
        attributes = above(start)
        conditions = [c for s in stack for c in s[3]] + cfg(attributes)
        module, gate = "::".join(s[2] for s in stack if s[1] == "mod"), " & ".join(conditions) or None
        if kind == "use":
            for leaf in use_leaves(m["name"]):
                yield kind, leaf, t.line(start), t.line(m.end()), module, attributes, gate
            continue
        brace, stop = t.code.find("{", m.end() - 1), t.code.find(";", m.end() - 1)
        end = t.close(brace) if brace >= 0 and (stop < 0 or brace < stop) else (stop if stop >= 0 else m.end())
        yield kind, m["name"], t.line(start), t.line(end), module, attributes, gate
        stack.append((end, kind, m["name"], cfg(attributes)))
        if kind == "fn":
            spans.append((m.end(), end, module, gate))
    for a, b, module, gate in spans:
        for m in re.finditer(r"([A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)\s*\(|\.([a-z_]\w*)\s*\(", t.code[a:b]):
            name = m[1] or "." + m[2]
            if name.split("::")[-1] not in NO_CALLS:
                yield "call", name, t.line(a + m.start()), t.line(a + m.start()), module, [], gate


def rust_facts(files: DataFrame) -> DataFrame:
    """Facts of all Rust files (path, text) for the resolver: see read_rust_facts and FACT."""
    return parsed(files, read_rust_facts, FACT)


def members(found: DataFrame) -> DataFrame:
    """(path, member_id, idx, kind, name, line, in_port, out_port): a file's items by line, with ids and ports that any run gives again."""
    from pyspark.sql import Window

    own = found.where("kind not in ('use') and error is null").withColumn("member_id", F.concat_ws(":", "kind", F.concat_ws(".", "owner", "name")))
    idx = F.row_number().over(Window.partitionBy("path").orderBy("line", "member_id")) - 1
    port = lambda side: F.xxhash64("path", "member_id", F.lit(side))
    return own.withColumn("idx", idx).select("path", "member_id", "idx", "kind", "name", "line", port("in").alias("in_port"), port("out").alias("out_port"))


def member_calls(found: DataFrame) -> DataFrame:
    """(path, member_id, callee)."""
    own = found.where("kind = 'fn'").withColumn("member_id", F.concat_ws(":", "kind", F.concat_ws(".", "owner", "name")))
    return own.select("path", "member_id", F.explode("calls").alias("callee"))


def test_counts(files: DataFrame) -> DataFrame:
    """(path, tests): test attributes in Rust, names in Python and Go, blocks in scripts."""
    n = lambda rule: F.regexp_count("text", F.lit(rule))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    count = F.when(kind == "rs", n(r"(?m)^\s*#\[(?:\w+::)*(?:test|rstest|test_case|bench)\b")).when(kind == "py", n(r"(?m)^\s*(?:async\s+)?def\s+test_?\w*\s*\(")).when(kind == "go", n(r"(?m)^func\s+(?:Test|Benchmark|Fuzz|Example)[A-Z_]?\w*\s*\(")).when(kind.isin("js", "ts", "jsx", "tsx", "mjs", "cjs"), n(r"(?m)^\s*(?:it|test)(?:\.\w+)*\s*\("))
    return files.select("path", F.coalesce(count, F.lit(0)).alias("tests"))


TAG = "tag string, line int, methods array<string>, templates array<string>, file_ref string, pointer string, partial boolean, malformed string, inner boolean, own_from int, own_to int"


def _comment_lines(text: str, family: str) -> tuple[list[str], list[str], list[bool], list[str]]:
    """(lines, their code, which hold a comment and nothing else, the comment's body of each) of a text."""
    opened = "#" if family in ("python", "ruby", "shell") else "--" if family == "lua" else "//"
    lines, code, alone, bodies, inside = text.split("\n"), blanked(text, family).split("\n"), [], [], False
    for line, bare in zip(lines, code, strict=True):
        s = line.strip()
        if bare.strip():  # code: only a comment after it can hold a tag
            s = line[len(bare.rstrip()) :].strip()
        starts = s.startswith("/*") and opened == "//"
        comment = s.startswith(opened) or starts or inside
        alone.append(bool(comment and s and not bare.strip()))
        bodies.append(s.lstrip("/#-*! ").strip() if comment else "")
        inside = (inside or starts) and "*/" not in s
    return lines, code, alone, [b.removesuffix("*/").strip() for b in bodies]


def _owner_lines(path: str, n: int, lines: list[str], code: list[str], alone: list[bool]) -> tuple[int | None, int | None]:
    """First and last line on which the item after the comment block of line n (from 0) may start; attributes in between are passed over."""
    if code[n].strip():
        return None, None
    end = n + 1
    while end < len(lines) and alone[end]:
        end += 1
    attributes, item = ("#[", "@", "[") if path.endswith(".cs") else ("#[", "#![", "@"), end
    while item < len(lines) and code[item].strip() and lines[item].strip().startswith(attributes):
        open_ = 0
        while item < len(lines) and code[item].strip():
            open_ += sum((c in "([{") - (c in ")]}") for c in lines[item])
            item += 1
            if open_ <= 0:
                break
    return end + 1, item + 1


def read_tags(path: str, text: str):
    """@route and @contract, where they are the first word of a comment line of a code file; what breaks their syntax is kept with its reason."""
    family = family_of(path, text)
    if family in (None, "markdown") or not ("@route" in text or "@contract" in text):
        return
    lines, code, alone, bodies = _comment_lines(text, family)
    for n, body in enumerate(bodies, 1):
        m = re.match(r"@(route|contract)(?:\s+(.*))?$", body)
        if not m:
            continue
        s = lines[n - 1][len(code[n - 1].rstrip()) :].strip() if code[n - 1].strip() else lines[n - 1].strip()
        words, inner, own = (m[2] or "").split(), s.startswith(("//!", "/*!")), _owner_lines(path, n - 1, lines, code, alone)
        if m[1] == "route":
            ok = lambda x: x.startswith("/") or re.match(r"[A-Za-z0-9+.-]+://", x)
            methods, templates = words[0].split("|") if words else [], words[1].split("|") if len(words) > 1 else []
            why = None
            if not words:
                why = "no method and template"
            elif ok(methods[0]):
                why = "no method"
            elif not all(re.fullmatch("[A-Za-z]+", x) for x in methods):
                why = "bad method list"
            elif not templates or not all(map(ok, templates)):
                why = "no template" if not templates else "bad template"
            yield ("malformed", n, None, None, None, None, None, why, inner, *own) if why else ("route", n, [x.upper() for x in methods], templates, None, None, None, None, inner, *own)
        elif not words:
            yield "malformed", n, None, None, None, None, None, "no file", inner, *own
        else:
            ref, mark, pointer = words[0].partition("#")
            bad = "no file" if not ref else "pointer doesn't start with /" if mark and pointer and not pointer.startswith("/") else None
            yield ("malformed", n, None, None, None, None, None, bad, inner, *own) if bad else ("contract", n, None, None, ref, pointer if mark else None, "partial" in words[1:], None, inner, *own)


def tags(files: DataFrame) -> DataFrame:
    """Tags of files (path, text); files without the words aren't read."""
    return parsed(files.where(F.contains("text", F.lit("@route")) | F.contains("text", F.lit("@contract"))), read_tags, TAG)


def _swept(batches):
    """(path, line, name) of rows (part, path, pos, kind, end, name) in order: spans open as they begin, points ask for the smallest one open."""
    at, spans = None, []
    for batch in batches:
        out = []
        for part, path, pos, kind, end, name in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "pos", "kind", "end", "name")), strict=True):
            if (part, path) != at:
                at, spans = (part, path), []
            if kind == 0:
                heappush(spans, (end - pos, name is not None, name, end))
                continue
            while spans and spans[0][3] < pos:  # over for all later points, too
                heappop(spans)
            if spans:
                out.append((path, pos, spans[0][2]))
        names = batch.schema.field("name").type
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), names))], ["path", "line", "name"])


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, name): the smallest span that holds each line, the earlier name of equals. points: path, line; spans: path, line, line_end, name.

    Spans and points are sorted together by ranges of (path, line) and swept once, the open spans in a heap, so a file
    with most rows lies in many ranges and no span meets a point outside its turn. Spans that are open at a range's end
    go to the ranges after it that they reach into: as many rows as spans are open at borders. Rows with a null path or
    line are left out; a null name is before all others; repeated points are one.
    """
    asked = points.where("path is not null and line is not null").select("path", F.col("line").cast("long").alias("pos"), F.lit(1).alias("kind")).distinct()
    opens = spans.where("path is not null and line <= line_end").select("path", F.col("line").cast("long").alias("pos"), F.lit(0).alias("kind"), F.col("line_end").cast("long").alias("end"), "name")
    order = ["path", "pos", "kind", "end", "name"]
    rows = settle(opens.unionByName(asked, allowMissingColumns=True).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    borders = settle(rows.groupBy("part").agg(F.min(F.struct("path", "pos")).alias("b")).select("part", F.col("b.path").alias("path"), F.col("b.pos").alias("first")))
    # A row a range: what the next one begins with.
    following = borders.select("part", *(F.lead(c).over(Window.orderBy("part")).alias(f"next_{c}") for c in ("path", "first")))
    crossing = settle(rows.where("kind = 0").join(following, "part").where("path = next_path and `end` >= next_first").select("part", *order))
    carried = crossing.join(borders.withColumnRenamed("part", "to"), "path").where("to > part and `end` >= first").select(F.col("to").alias("part"), *order)
    swept = rows.select("part", *order).unionByName(carried).repartition("part").sortWithinPartitions("part", "path", "pos", "kind")
    kind = spans.schema["name"].dataType.simpleString()
    return swept.mapInArrow(_swept, f"path string, line long, name {kind}").withColumn("line", F.col("line").cast(points.schema["line"].dataType))


def tag_owners(found: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, owner) of tags (see tags): null where the file itself owns one.

    An inner documentation comment belongs to the smallest item around it (its first line above the tag's); any other
    tag to the item that starts right after its comment block, attributes passed over, the longest of those on one
    line; a tag beside code to the file.
    """
    s = spans.select("path", F.col("line").alias("a"), F.col("line_end").alias("b"), "name")
    met = found.select("path", "line", "inner", "own_from", "own_to").distinct().join(s, "path")
    after = met.where("not inner and a between own_from and own_to").groupBy("path", "line").agg(F.min_by("name", F.struct("a", -F.col("b"), "name")).alias("owner"))
    around = met.where("inner and a < line and line <= b").groupBy("path", "line").agg(F.min_by("name", F.struct(F.expr("b - a"), "name", "a")).alias("owner"))
    return found.select("path", "line").distinct().join(after.unionByName(around), ["path", "line"], "left")
