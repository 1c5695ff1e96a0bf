"""Session logs: which project a log belongs to, calls and their results, tasks at a time, and who owns a copied line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.paths import ancestors
from graphweft.storage import settle


def longest_root(logs: DataFrame, roots: DataFrame) -> DataFrame:
    """(log, root): the longest root that is the log's folder or above it. logs: log, cwd; roots: root. Ancestors make it an equi-join."""
    above = logs.select("log", F.explode(F.array_distinct(F.array_append(ancestors(F.col("cwd")), F.col("cwd")))).alias("root"))
    return above.join(roots.select("root").distinct(), "root").groupBy("log").agg(F.max_by("root", F.length("root")).alias("root"))


def follow_main(logs: DataFrame, own: DataFrame) -> DataFrame:
    """(log, root): a subagent's log goes where its main log goes; one without a main log decides alone.

    logs: log, main (null for main logs); own: log, root.
    """
    known = logs.select(F.col("log").alias("main"), F.lit(True).alias("there"))
    mains = own.select(F.col("log").alias("main"), F.col("root").alias("main_root"))
    out = logs.join(own, "log", "left").join(known, "main", "left").join(mains, "main", "left")
    return out.select("log", F.when(F.col("there"), F.col("main_root")).otherwise(F.col("root")).alias("root")).where("root is not null")


def answered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their later result in the same log. calls: log, call_id, at, kind; results: log, call_id, at, is_error.

    Failed reads, edits, writes and task calls go; a plan call is kept regardless. A call without a result isn't one yet.
    """
    later = results.groupBy("log", "call_id").agg(F.min_by("is_error", "at").alias("is_error"), F.max("at").alias("answered_at"))
    met = calls.join(later, ["log", "call_id"]).where("answered_at >= at")
    return met.where("kind = 'plan' or not coalesce(is_error, false)")


def task_at(touches: DataFrame, states: DataFrame) -> DataFrame:
    """(touch, task): at a touch's time, of the tasks whose last state is in progress the one set last.

    touches: touch, session, time; states: session, task (ordered), time, seq, state; times are whole numbers. States
    become intervals by lead. An interval lies in two cells at most of its length's level, a touch in one cell of each
    level that occurs (64 at most), so they meet by equality on session, level and cell, a busy session's too; the
    greatest (time, task) wins.
    """
    last = touches.agg(F.max("time")).first()[0]
    w = Window.partitionBy("session", "task").orderBy("time", "seq")
    spans = states.withColumn("until", F.lead("time").over(w)).where("state = 'in_progress' and (until is null or until > time)")
    spans = spans.select("session", "task", F.col("time").alias("since"), F.coalesce("until", F.lit(last) + 1).alias("until")).where("since < until")
    usual = spans.agg(F.percentile_approx(F.col("until") - F.col("since"), 0.5)).first()[0]
    if last is None or usual is None:
        return touches.join(states.select("session", "task"), "session").select("touch", "task").where("false")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("until") - F.col("since")) / F.lit(usual)))).cast("int")
    spans = settle(spans.withColumn("level", level))
    levels = [r[0] for r in spans.select("level").distinct().collect()]
    cell = lambda time: F.expr(f"({time}) div shiftleft(cast({usual} as bigint), level)")
    held = spans.select("*", F.explode(F.sequence(cell("since"), cell("until - 1"))).alias("cell"))
    asked = touches.select("touch", "session", "time", F.explode(F.array(*map(F.lit, sorted(levels)))).alias("level"))
    met = asked.withColumn("cell", cell("time")).join(held, ["session", "level", "cell"]).where("since <= time and time < until")
    return met.groupBy("touch").agg(F.max_by("task", F.struct("since", "task")).alias("task"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """left with the value of the last right row at or before its time, per keys: one union, one window, no range join.

    Rows of a key are sorted together; right rows come before left rows of the same time.
    """
    l_ = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    r_ = right.select(*keys, time, F.col(value).alias("_value"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r_, allowMissingColumns=True).withColumn(value, F.last("_value", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_side", "_value")


def updated_tasks(updates: DataFrame, tasks: DataFrame) -> DataFrame:
    """(update, task): the newest task of the session with the update's id created at or before it; others vanish.

    updates: update, session, id, time; tasks: task, session, id, created.
    """
    out = as_of(updates, tasks.select("session", "id", F.col("created").alias("time"), "task"), ["session", "id"], "time", "task")
    return out.where("task is not null").select("update", "task")


def first_owner(rows: DataFrame, key: str) -> DataFrame:
    """rows of which the first log (by started, then path, then place) owns each key; rows without one all stay."""
    order = Window.partitionBy(key).orderBy("started", "log", "pos")
    keyed = rows.where(F.col(key).isNotNull())
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").unionByName(rows.where(F.col(key).isNull()))


def duplicate_lines(rows: DataFrame, key: str) -> DataFrame:
    """(lines, duplicates): copies are counted, not removed."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("lines"), F.sum(F.when(F.col(key).isNull(), 0).otherwise(F.col("n") - 1)).alias("duplicates"))


def session_summary(lines: DataFrame) -> DataFrame:
    """(session, first_time, last_time, n_lines, branches, slug): branches in the order they are first seen; the last slug, a main log's before a subagent's.

    lines: session, log, pos, time, branch, slug, subagent.
    """
    firsts = lines.where("branch is not null").groupBy("session", "branch").agg(F.min(F.struct("time", "log", "pos")).alias("at"))
    branches = firsts.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "branch"))), lambda x: x["branch"]).alias("branches"))
    base = lines.groupBy("session").agg(
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count(F.lit(1)).alias("n_lines"),
        F.max_by("slug", F.when(F.col("slug").isNotNull(), F.struct((~F.col("subagent")).alias("main"), "time", "log", "pos"))).alias("slug"),
    )
    return base.join(branches, "session", "left")


def latest_plan(plans: DataFrame) -> DataFrame:
    """(session, plan): of the latest time; on equal times the later line. plans: session, plan, time, log, pos."""
    return plans.groupBy("session").agg(F.max_by("plan", F.struct("time", "log", "pos")).alias("plan"))


def out_of_scope(touches: DataFrame, roots: DataFrame, k: int = 5, names: int = 2) -> DataFrame:
    """(folder, n): the k folders outside all roots that are touched most, cut to their first names, then by path. touches: path."""
    above = touches.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    inside = above.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct()
    folder = F.array_join(F.slice(F.split("path", "/"), 1, names), "/")
    return above.join(inside, "path", "left_anti").groupBy(folder.alias("folder")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "folder").limit(k)


def touches_by_kind(touches: DataFrame) -> DataFrame:
    """(kind, main, subagent): touches of each kind by who made them."""
    return touches.groupBy("kind").agg(F.count_if(~F.col("subagent")).alias("main"), F.count_if(F.col("subagent")).alias("subagent"))


def _hunk_count(lines: Column, hunk: Column) -> Column:
    """In how many places a hunk's new side stands: at its own lines, else its added block of whole lines anywhere."""
    new, added = F.transform(hunk["lines"], lambda x: x["text"]), F.transform(hunk["lines"], lambda x: x["added"])
    here = F.slice(lines, F.greatest(hunk["start"], F.lit(1)), F.size(new)) == new
    first = F.array_position(added, True)
    last = F.size(added) - F.array_position(F.reverse(added), True) + 1
    block = F.slice(new, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    at = F.sequence(F.lit(1), F.greatest(F.size(lines) - F.size(block) + 1, F.lit(1)))
    found = F.size(F.filter(at, lambda i: F.slice(lines, i, F.size(block)) == block))
    return F.when(F.size(new) == 0, 1).when(here, 1).when(first == 0, 0).otherwise(found)


def match_touch(touches: DataFrame, files: DataFrame) -> DataFrame:
    """(touch, state, count): whether what a touch wrote is in the file's text now.

    touches: touch, path, parts array<string>, and where there are such columns every array<boolean> (a part that was put
    in every place), hunks array<struct<start, lines array<struct<added, text>>>> (the lines a patch left; they count
    before parts), deleted boolean; files: path, text, line ends as in the parts. A missing part is stale, and so is a
    file that was deleted; else a part found several times (overlapping ones count, those of every place don't) leaves
    candidates; else the touch is lit.
    """
    from graphweft.functions.text import occurrences

    has = lambda c, kind: F.col(c) if c in touches.columns else F.lit(None).cast(kind)
    hunks, every = has("hunks", "array<struct<start:int,lines:array<struct<added:boolean,text:string>>>>"), has("every", "array<boolean>")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n")
    met = touches.select("touch", "path", "parts", hunks.alias("hunks"), every.alias("every"), has("deleted", "boolean").alias("deleted")).join(files, "path", "left")
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    by_part = F.transform("parts", lambda p, i: F.struct(occurrences(text, F.regexp_replace(p, "\r\n", "\n")).alias("n"), F.coalesce(F.get("every", i), F.lit(False)).alias("every")))
    by_hunk = F.transform("hunks", lambda h: F.struct(_hunk_count(lines, h).alias("n"), F.lit(False).alias("every")))
    met = met.withColumn("counts", F.when(F.size("hunks") > 0, by_hunk).otherwise(by_part))
    stale = F.col("text").isNull() | F.coalesce("deleted", F.lit(False)) | F.exists("counts", lambda c: c["n"] == 0)
    many = F.exists("counts", lambda c: (c["n"] > 1) & ~c["every"])
    return met.select("touch", F.when(stale, "stale").when(many, "candidates").otherwise("lit").alias("state"), F.aggregate("counts", F.lit(0), lambda a, c: a + c["n"]).alias("count"))


def log_changes(found: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change, resume): same, grown, new or replaced, and the byte to read on from.

    found: path, length, mtime, head; known: path, length, mtime, head, consumed. Equal length and time: same; at least
    as long as what was read and the same head: grown; otherwise replaced.
    """
    k = known.select("path", F.col("length").alias("k_length"), F.col("mtime").alias("k_mtime"), F.col("head").alias("k_head"), "consumed")
    met = found.join(k, "path", "left")
    change = F.when(F.col("k_length").isNull(), "new").when((F.col("length") == F.col("k_length")) & (F.col("mtime") == F.col("k_mtime")), "same").when((F.col("length") >= F.col("consumed")) & (F.col("head") == F.col("k_head")), "grown").otherwise("replaced")
    return met.select("path", change.alias("change"), F.when(change.isin("grown", "same"), F.col("consumed")).otherwise(0).cast("long").alias("resume"))


def late_membership(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(log, cwd, pos): the first line of each log whose folder lies in a root, however late. lines: log, pos, cwd."""
    above = lines.select("log", "pos", "cwd", F.explode(F.array_distinct(F.array_append(ancestors(F.col("cwd")), F.col("cwd")))).alias("root"))
    inside = above.join(roots.select("root").distinct(), "root", "left_semi")
    return inside.groupBy("log").agg(F.min_by("cwd", "pos").alias("cwd"), F.min("pos").alias("pos"))


def minimal_prefixes(needles: DataFrame) -> DataFrame:
    """Needles (needle) that no other one is a proper start of."""
    n = needles.select("needle").distinct()
    starts = n.select("needle", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("needle") - 1, F.lit(1))), lambda i: F.when(i < F.length("needle"), F.substring("needle", F.lit(1), i)))).alias("start"))
    inner = starts.join(n.select(F.col("needle").alias("start")), "start", "left_semi").select("needle").distinct()
    return n.join(inner, "needle", "left_anti")


def group_by_heading(lines: DataFrame, keys: list[str], order: str, heading: Column) -> DataFrame:
    """lines with the number and text of the last heading at or above each; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_h", heading)
    return marked.withColumns({"section": F.sum(F.col("_h").isNotNull().cast("int")).over(w).cast("int"), "heading": F.last("_h", ignorenulls=True).over(w)}).drop("_h")


def fenced(lines: DataFrame, keys: list[str], order: str, text: str = "line") -> DataFrame:
    """lines with whether each lies inside a fenced block (the fences included)."""
    fence = F.col(text).rlike(r"^\s*(```|~~~)")
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("fenced", fence | (before % 2 == 1))
