"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """1024 steps with one decimal; plain bytes below."""
    d = n.cast("double")
    out = F.when(d < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        text = F.format_string(f"%.1f {unit}", F.bround(d / 1024.0**power, 1))
        out = out.when(d < 1024.0 ** (power + 1), text) if power < 4 else out.otherwise(text)
    return out


def thousands(n: Column) -> Column:
    """Groups of three digits between commas."""
    return F.format_number(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)), 0)


def kebab_case(ident: Column) -> Column:
    """camelCase and acronym boundaries, and underscores, become hyphens."""
    s = F.regexp_replace(ident, "([a-z0-9])([A-Z])", "$1-$2")
    s = F.regexp_replace(s, "([A-Z])([A-Z][a-z])", "$1-$2")
    return F.lower(F.regexp_replace(s, "_", "-"))


def shortened(text: Column, most: int) -> Column:
    """At most most characters, and an ellipsis where some are cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def shortened_start(text: Column, most: int) -> Column:
    """The last characters, with an ellipsis where some are cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(most - 1))))


def first_sentence(text: Column, most: int = 200) -> Column:
    """Of the first paragraph that is prose, up to a stop mark before white space; at most most characters; null if there is none."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n[ \t]*\n"), lambda b: F.trim(b) != "")
    prose = F.filter(blocks, lambda b: ~F.ltrim(b).rlike("^(#|<|```|\\||!\\[|\\[!)"))
    line = F.trim(F.regexp_replace(F.get(prose, F.lit(0)), r"\s+", " "))
    found = F.regexp_extract(line, r"^(.*?[.!?])(?=\s|$)", 1)
    sentence = F.when(found != "", found).otherwise(line)
    return F.when(F.length(line) > 0, F.when(F.length(sentence) > most, F.concat(F.substring(sentence, 1, most - 1), F.lit("…"))).otherwise(sentence))


def clean_comment(comment: Column) -> Column:
    """Without comment markers at either end of any line."""
    s = F.regexp_replace(comment, r"(?m)^\s*(?:///?!?|/\*\*?|\*/|\*|#+!?|--+|;+|\"\"\"|''')[ \t]?", "")
    return F.trim(F.regexp_replace(s, r"\s*(?:\*/|\"\"\"|''')\s*$", ""))


def clean_base(name: Column) -> Column:
    """A base type's own name: no generic arguments, no qualifier, no reference marks."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"<.*$|\(.*$|\[.*$", ""), r"^[&*\s]+", ""))
    return F.regexp_extract(bare, r"([^.:/\s]+)\s*$", 1)


def clean_import(target: Column) -> Column:
    """An import as a file name: quotes off, ./ off, then .js .ts .tsx .jsx .py off, in that order."""
    s = F.regexp_replace(F.trim(target), r"^[\"'<]|[\"'>]$", "")
    s = F.regexp_replace(s, r"^\./", "")
    for suffix in ("js", "ts", "tsx", "jsx", "py"):
        s = F.regexp_replace(s, rf"\.{suffix}$", "")
    return s


def parse_time(text: Column) -> Column:
    """RFC 3339 with an offset as Unix milliseconds; null if it isn't one."""
    shaped = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.upper(text))
    return F.unix_millis(F.try_to_timestamp(shaped))


def age_text(now_ms: Column, then_ms: Column) -> Column:
    """just now, minutes, hours, days, months, years: floors of the largest unit that fits."""
    s = F.floor(F.greatest(now_ms - then_ms, F.lit(0)) / 1000)
    out = F.when(s < 60, F.lit("just now"))
    for unit, size, below in (("min", 60, 3600), ("h", 3600, 86400), ("d", 86400, 86400 * 30), ("mo", 86400 * 30, 86400 * 365)):
        out = out.when(s < below, F.concat(F.floor(s / size).cast("string"), F.lit(f" {unit} ago")))
    return out.otherwise(F.concat(F.floor(s / (86400 * 365)).cast("string"), F.lit(" y ago")))


#: Milliseconds of 400 years, after which the calendar repeats.
SPAN_MS = 146_097 * 86_400_000


def clock_text(ms: Column, offset_minutes: int) -> Column:
    """Date and time at a fixed offset; a year past 9999 is a plain number. The calendar repeats every 400 years: one such span is formatted."""
    local = ms + offset_minutes * 60_000
    rest = F.pmod(local, F.lit(SPAN_MS))
    at = F.timestamp_millis(rest).cast("timestamp")
    year = F.year(at) + F.call_function("div", local - rest, F.lit(SPAN_MS)) * 400
    return F.concat(F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string")), F.date_format(at, "-MM-dd HH:mm"))


def fold_lower(text: Column) -> Column:
    """Lower case, one character for one: a character whose lower case is several stays."""
    plain = F.lower(text)
    kept = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c)), "")
    return F.when(F.length(plain) == F.length(text), plain).otherwise(kept)


def occurrences(text: Column, part: Column) -> Column:
    """How often part is in text, overlapping ones too."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(part) + 1, F.lit(1)))
    return F.when(F.length(part) > 0, F.size(F.filter(starts, lambda i: F.substr(text, i, F.length(part)) == part))).otherwise(0)


def apply_edit(text: Column, old: Column, new: Column) -> Column:
    """new in place of the one occurrence of old, in the text's own line endings; null if there is none or several."""
    crlf = F.instr(text, "\r\n") > 0
    ends = lambda c: F.when(crlf, F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\n", "\r\n")).otherwise(F.regexp_replace(c, "\r\n", "\n"))
    count = F.when(F.length(old) > 0, (F.length(text) - F.length(F.replace(text, ends(old), F.lit("")))) / F.length(ends(old)))
    return F.when(count == 1, F.replace(text, ends(old), ends(new)))


def content_hash(text: Column) -> Column:
    return F.xxhash64(text)


#: Labels of languages by extension.
LANGUAGES = {
    "rs": "Rust", "py": "Python", "pyi": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "TSX", "go": "Go", "c": "C", "h": "C", "cc": "C++", "cpp": "C++",
    "cxx": "C++", "hpp": "C++", "hh": "C++", "hxx": "C++", "cs": "C#", "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift",
    "rb": "Ruby", "php": "PHP", "lua": "Lua", "scala": "Scala", "sh": "Bash", "bash": "Bash", "html": "HTML", "css": "CSS", "md": "Markdown",
    "json": "JSON", "sql": "SQL", "dart": "Dart", "zig": "Zig",
}


def language(path: Column, content: Column | None = None) -> Column:
    """The language of a file by its extension; a .c file that holds Enforce Script's marks is that."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    found = F.try_element_at(names, extension)
    if content is not None:
        enforce = content.rlike(r"(?m)^\s*(modded\s+class|class\s+\w+\s*:\s*\w+|override\s+|protected\s+ref\s+|ref\s+array<)")
        found = F.when((extension == "c") & enforce, F.lit("Enforce Script")).otherwise(found)
    return found


def is_minified(text: Column) -> Column:
    """The first ten lines that aren't blank have over 400 bytes on average."""
    lines = F.slice(F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != ""), 1, 10)
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    return (F.size(lines) > 0) & (F.floor(total / F.size(lines)) > 400)
