"""Version control as tables: branches, work trees, commits, changes, attributes, ignored files and status.

Commands run on the driver (see commands.Runner); their bytes become a one-column table of records, and Spark parses
those.
"""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.sources.commands import HISTORY_TIMEOUT, Runner

#: Separators of records, fields and groups, the history's length, and attributes asked for.
RECORD, UNIT, GROUP, HISTORY_LIMIT = "\x1e", "\x1f", "\x1d", 5000
#: Fixed value: what is asked of each branch.
BRANCH_FORMAT = "%(refname:short)%1f%(objectname)%1f%(upstream:short)%1f%(upstream:track)%1f%(committerdate:unix)%1f%(subject)"
ATTRIBUTES = ("filter", "linguist-generated", "linguist-vendored", "linguist-documentation")


def _records(spark: SparkSession, text: str, separator: str, name: str = "record") -> DataFrame:
    """A row with its place for each part of a command's output."""
    return spark.createDataFrame([(i, r) for i, r in enumerate(text.split(separator)) if r.strip("\n")], f"pos long, {name} string")


def _text(runner: Runner, root: str, *words: str, stdin: bytes | None = None, timeout: float | None = None) -> str:
    return runner.run(["git", *words], root, stdin, timeout).decode("utf-8", "replace")


def read_branches(spark: SparkSession, runner: Runner, root: str) -> DataFrame:
    """(branch, head, upstream, ahead, behind, time, subject)."""
    f = F.split("record", UNIT)
    count = lambda word: F.coalesce(F.regexp_extract(f[3], rf"{word} (\d+)", 1).try_cast("long"), F.lit(0))
    rows = _records(spark, _text(runner, root, "for-each-ref", f"--format={BRANCH_FORMAT}", "refs/heads"), "\n")
    return rows.select(f[0].alias("branch"), f[1].alias("head"), F.nullif(f[2], F.lit("")).alias("upstream"), count("ahead").alias("ahead"), count("behind").alias("behind"), f[4].cast("long").alias("time"), f[5].alias("subject"))


def read_worktrees(spark: SparkSession, runner: Runner, root: str) -> DataFrame:
    """(path, head, branch, detached, bare)."""
    rows = _records(spark, _text(runner, root, "worktree", "list", "--porcelain"), "\n\n")
    get = lambda key: F.nullif(F.regexp_extract("record", rf"(?m)^{key} (.*)$", 1), F.lit(""))
    has = lambda key: F.col("record").rlike(rf"(?m)^{key}$")
    return rows.select(get("worktree").alias("path"), get("HEAD").alias("head"), F.regexp_replace(get("branch"), "^refs/heads/", "").alias("branch"), has("detached").alias("detached"), has("bare").alias("bare"))


def read_commits(spark: SparkSession, runner: Runner, root: str, limit: int = HISTORY_LIMIT) -> DataFrame:
    """(pos, commit, short, parents, time, author, subject, co_authors), newest first."""
    form = "%x1e%H%x1f%ct%x1f%an%x1f%s%x1f%(trailers:key=Co-authored-by,valueonly,separator=%x1d)%x1f%h%x1f%P"
    rows = _records(spark, _text(runner, root, "log", f"-n{limit}", f"--format={form}"), RECORD)
    f = F.split(F.regexp_replace("record", r"\n+$", ""), UNIT)
    names = F.filter(F.transform(F.split(f[4], GROUP), lambda n: F.trim(F.regexp_replace(n, "<.*$", ""))), lambda n: n != "")
    parents = F.filter(F.split(f[6], " "), lambda p: p != "")
    return rows.select(F.col("pos"), f[0].alias("commit"), f[5].alias("short"), parents.alias("parents"), f[1].cast("long").alias("time"), f[2].alias("author"), f[3].alias("subject"), names.alias("co_authors"))


def co_author_counts(commits: DataFrame) -> DataFrame:
    """(name, commits)."""
    return commits.select("commit", F.explode(F.array_distinct("co_authors")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("commits"))


def fields_of(output: Column) -> Column:
    """NUL-separated fields of a command's output."""
    return F.split(output, "\x00")


def parse_numstat(outputs: DataFrame) -> DataFrame:
    """(commit, path, old_path, added, deleted) of outputs (commit, output) of numstat with NULs; a rename takes two more fields; binary: null.

    A field with an empty third part is a rename's head: what follows it are its names, which hold no tabs of their own
    in that place, so every head finds them by position.
    """
    f = outputs.select("commit", F.posexplode(fields_of(F.col("output"))).alias("at", "field"))
    w = Window.partitionBy("commit").orderBy("at")
    head = F.regexp_replace("field", "^\n+", "").rlike("^(\\d+|-)\t(\\d+|-)\t")
    near = f.withColumns({"bare": F.regexp_replace("field", "^\n+", ""), "next1": F.lead("field", 1).over(w), "next2": F.lead("field", 2).over(w), "head": head})
    part = F.split("bare", "\t", 3)
    moved = part[2] == ""
    return near.where("head").select("commit", F.when(moved, F.col("next2")).otherwise(part[2]).alias("path"), F.when(moved, F.col("next1")).alias("old_path"), part[0].try_cast("long").alias("added"), part[1].try_cast("long").alias("deleted"))


def read_commit_files(spark: SparkSession, runner: Runner, root: str, commit: str) -> DataFrame:
    """What a commit changed; a merge against its first parent."""
    if not commit or any(c not in "0123456789abcdefABCDEF" for c in commit):
        raise ValueError("not a commit id")
    out = _text(runner, root, "show", "--numstat", "-z", "-M", "-C", "--diff-merges=first-parent", "--no-show-signature", "--format=", commit)
    return parse_numstat(spark.createDataFrame([(commit, out)], "commit string, output string"))


def read_touched(spark: SparkSession, runner: Runner, root: str) -> DataFrame:
    """(commit, time, pos, path) of the whole history, newest first: what last_commits takes."""
    out = _text(runner, root, "log", "--name-only", "-z", "--format=%x1e%H%x1f%ct%x1f", timeout=HISTORY_TIMEOUT)
    f = F.split("record", UNIT)
    rows = _records(spark, out, RECORD).select("pos", f[0].alias("commit"), f[1].cast("long").alias("time"), F.explode(F.split(F.regexp_replace(f[2], "^[\x00\n]+", ""), "\x00")).alias("path"))
    return rows.where("path <> ''")


def parse_attributes(output: DataFrame) -> DataFrame:
    """(path, attribute, value) of check-attr's NUL-separated triples (pos, field)."""
    at = output.withColumns({"n": F.expr("pos div 3"), "k": F.expr("pos % 3")})
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("field")))
    return at.groupBy("n").agg(pick(0).alias("path"), pick(1).alias("attribute"), pick(2).alias("value")).drop("n")


def read_attributes(spark: SparkSession, runner: Runner, root: str) -> DataFrame:
    """(path, attribute) that are set on tracked files."""
    listed = runner.run(["git", "ls-files", "-z"], root)
    out = runner.run(["git", "check-attr", "--stdin", "-z", *ATTRIBUTES], root, listed).decode("utf-8", "replace")
    fields = spark.createDataFrame([(i, x) for i, x in enumerate(out.split("\0")[:-1])], "pos long, field string")
    return parse_attributes(fields).where("value not in ('unspecified', 'unset', 'false') and (attribute <> 'filter' or value = 'lfs')").select("path", F.when(F.col("attribute") == "filter", "lfs").otherwise(F.col("attribute")).alias("attribute"))


def read_ignored(spark: SparkSession, runner: Runner, root: str) -> DataFrame:
    """(path, source, line, pattern): ignored folders (with a trailing /) and files, with the rule that says so where there is one."""
    paths = [p for p in _text(runner, root, "ls-files", "--others", "--ignored", "--exclude-standard", "--directory", "-z").split("\0") if p]
    rules: list[tuple] = []
    if paths:
        try:
            fields = _text(runner, root, "check-ignore", "-v", "-z", "--stdin", "--no-index", stdin="\0".join([*paths, ""]).encode()).split("\0")[:-1]
        except subprocess.CalledProcessError:
            fields = []
        rules = [(p, s, int(n) if n.isdigit() else 0, pattern) for s, n, pattern, p in zip(*[iter(fields)] * 4, strict=False)]
    return with_rules(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(rules, "path string, source string, line int, pattern string"))


def with_rules(listed: DataFrame, rules: DataFrame) -> DataFrame:
    """listed (path) with the source, line and pattern of the rule that says so, where there is one."""
    return listed.join(rules.select("path", "source", "line", "pattern"), "path", "left")


def status_counts(outputs: DataFrame) -> DataFrame:
    """(added, modified, deleted, renamed, conflicted, untracked) of porcelain v2 outputs (output) with NULs. The name a rename came from is no entry."""
    alone = F.regexp_replace("output", "((?:^|\\x00)2 [^\\x00]*)\\x00[^\\x00]*", "$1")
    own = outputs.select(F.explode(fields_of(alone)).alias("field")).where("field <> ''")
    kind, xy = F.substring_index("field", " ", 1), F.split("field", " ", 3)[1]
    x, y = F.substring(xy, 1, 1), F.substring(xy, 2, 1)
    deleted = (x == "D") | (y == "D")
    n = lambda e: F.count_if(F.coalesce(e, F.lit(False)))
    return own.agg(n((kind == "1") & (x == "A")).alias("added"), n((kind == "1") & (x != "A") & ~deleted).alias("modified"), n((kind == "1") & (x != "A") & deleted).alias("deleted"), n(kind == "2").alias("renamed"), n(kind == "u").alias("conflicted"), n(kind == "?").alias("untracked"))


def status_files(outputs: DataFrame) -> DataFrame:
    """(worktree, kind, path) of porcelain v2 outputs (worktree, output) with NULs: kinds as in status_counts; a rename's new name."""
    alone = F.regexp_replace("output", "((?:^|\\x00)2 [^\\x00]*)\\x00[^\\x00]*", "$1")
    own = outputs.select("worktree", F.explode(fields_of(alone)).alias("field")).where("field rlike '^[12u?] '")
    letter, xy = F.substring("field", 1, 1), F.split("field", " ", 3)[1]
    x, y = F.substring(xy, 1, 1), F.substring(xy, 2, 1)
    kind = F.when(letter == "?", "untracked").when(letter == "u", "conflicted").when(letter == "2", "renamed").when(x == "A", "added").when((x == "D") | (y == "D"), "deleted").otherwise("modified")
    before = F.when(letter == "?", 2).when(letter == "1", 9).when(letter == "2", 10).otherwise(11)  # words before the path, and one
    path = F.array_join(F.slice(F.split("field", " "), before, F.greatest(F.size(F.split("field", " ")) - before + 1, F.lit(0))), " ")
    return own.select("worktree", kind.alias("kind"), path.alias("path"))


def read_worktree_files(spark: SparkSession, runner: Runner, worktrees: list[str]) -> DataFrame:
    """(worktree, kind, path): what is changed in each work tree; one that can't be read has no rows. Work trees are few: one command each."""
    rows = []
    for path in worktrees:
        try:
            rows.append((path, _text(runner, path, "status", "--porcelain=v2", "-z", "--untracked-files=normal")))
        except (OSError, subprocess.SubprocessError):
            continue
    return status_files(spark.createDataFrame(rows, "worktree string, output string"))


def read_status(spark: SparkSession, runner: Runner, root: str) -> DataFrame:
    out = _text(runner, root, "status", "--porcelain=v2", "-z", "--untracked-files=normal")
    return status_counts(spark.createDataFrame([(out,)], "output string"))


def read_head(start: str) -> tuple[str | None, str | None]:
    """(branch, commit) at or above a folder, without running anything: work trees, loose and packed references."""
    at = os.path.abspath(start)
    while not os.path.exists(os.path.join(at, ".git")):
        if os.path.dirname(at) == at:
            return None, None
        at = os.path.dirname(at)
    folder = os.path.join(at, ".git")
    if os.path.isfile(folder):
        with open(folder) as f:
            folder = os.path.join(at, f.read().partition("gitdir:")[2].strip())
    with open(os.path.join(folder, "HEAD")) as f:
        head = f.read().strip()
    if not head.startswith("ref:"):
        return None, head
    ref, common = head[4:].strip(), folder
    if os.path.exists(os.path.join(folder, "commondir")):
        with open(os.path.join(folder, "commondir")) as f:
            common = os.path.normpath(os.path.join(folder, f.read().strip()))
    branch = ref.removeprefix("refs/heads/")
    for base in (folder, common):
        if os.path.isfile(os.path.join(base, ref)):
            with open(os.path.join(base, ref)) as f:
                return branch, f.read().strip()
    packed = os.path.join(common, "packed-refs")
    if os.path.isfile(packed):
        with open(packed) as f:
            for line in f:
                if line.rstrip("\n").endswith(" " + ref):
                    return branch, line.split(" ", 1)[0]
    return branch, None
