"""Tickets: tokens in branch names, numeric order of ids, what comes next, and the commits that shipped them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.operators.order import running


def id_key(ticket: Column) -> Column:
    """Sort key of an id: numeric by segment, text after numbers."""
    bare = F.regexp_replace(ticket, "^T-", "")
    one = lambda s: F.struct((~s.rlike("^[0-9]{1,18}$")).alias("text_last"), F.coalesce(s.try_cast("long"), F.lit(0)).alias("n"), F.when(s.rlike("^[0-9]{1,18}$"), "").otherwise(s).alias("text"))
    return F.struct(F.transform(F.split(bare, r"\."), one).alias("segments"), ticket.alias("id"))


def ids_in(branch: Column) -> Column:
    """The exact ids T-n(.n)* in a name, each once, in order."""
    found = F.regexp_extract_all(branch, F.lit(r"(?<![A-Za-z0-9])(T-[0-9]+(?:\.[0-9]+)*+)(?![A-Za-z0-9])(?![.-][0-9])"), F.lit(1))
    return F.array_distinct(found)


def branch_tickets(branches: DataFrame, tickets: DataFrame) -> DataFrame:
    """(branch, ticket) that a branch names and that exist: a guess by name, never proven."""
    return branches.select("branch", F.explode(ids_in(F.col("branch"))).alias("ticket")).join(tickets.select(F.col("id").alias("ticket")), "ticket", "left_semi")


def next_tickets(tickets: DataFrame, n: int) -> DataFrame:
    """The n to work on next: ready, then queued; by priority and order (none last), then id."""
    due = tickets.where("status in ('ready', 'queued')")
    return due.orderBy(F.col("status") == "queued", F.asc_nulls_last("priority"), F.asc_nulls_last("order"), id_key(F.col("id"))).limit(n)


def status_counts(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def is_commit_id(sha: Column) -> Column:
    """4 to 40 or 64 hexadecimal digits."""
    return sha.rlike("^[0-9A-Fa-f]{4,40}$|^[0-9A-Fa-f]{64}$")


def is_full_id(sha: Column) -> Column:
    return sha.rlike("^[0-9a-f]{40}$|^[0-9a-f]{64}$")


def confirm_shipped(tickets: DataFrame, commits: DataFrame) -> DataFrame:
    """(id, shipped_at, commit): the one commit whose id starts with shipped_at; null if none or several do.

    Commits are cut to the lengths that are asked for (61 at most), so that prefixes meet them by equality alone.
    """
    asked = tickets.where(is_commit_id(F.col("shipped_at"))).select("id", "shipped_at")
    lengths = [r[0] for r in asked.select(F.length("shipped_at")).distinct().collect()]
    cut = commits.select("commit", F.explode(F.array(*(F.when(F.length("commit") >= n, F.substring("commit", 1, n)) for n in sorted(lengths)))).alias("shipped_at")) if lengths else commits.selectExpr("commit", "commit shipped_at")
    met = asked.join(cut, "shipped_at")
    one = met.groupBy("id").agg(F.count_distinct("commit").alias("n"), F.min("commit").alias("commit")).where("n = 1").select("id", "commit")
    return tickets.where("shipped_at is not null").select("id", "shipped_at").join(one, "id", "left")


def position(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with a dense index from 0 in a total order, numbered by ranges of it."""
    keys = {f"_key{i}": c for i, c in enumerate(order)}
    return running(rows.withColumns(keys), *keys).withColumn("idx", F.col("before").cast("int")).drop("before", *keys)


def worktree_rows(worktrees: DataFrame, branches: DataFrame, commits: DataFrame, changes: DataFrame, sessions: DataFrame, tickets: DataFrame) -> DataFrame:
    """(path, label, is_main, ahead, behind, commits, changes, sessions, tickets) of each work tree.

    worktrees: path, head, branch (null: detached), is_main; branches: branch, upstream, ahead, behind; commits: pos,
    commit of the history, newest first; changes: worktree, kind, path; sessions: session, root; tickets: id. A work
    tree at the history's head has its commits, any other with a head has that one; tickets are those its branch
    names, a guess by name. Sides are counted before they are joined.
    """
    head = commits.where("pos = 0").select(F.col("commit").alias("head"), F.lit(True).alias("whole")).limit(1)
    number = commits.agg(F.count(F.lit(1))).first()[0]
    kinds = changes.groupBy(F.col("worktree").alias("path"), "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("kind", "n"))).alias("changes"))
    held = sessions.groupBy(F.col("root").alias("path")).agg(F.count(F.lit(1)).alias("sessions"))
    named = branch_tickets(worktrees.where("branch is not null").select("branch").distinct(), tickets).groupBy("branch").agg(F.sort_array(F.collect_set("ticket")).alias("tickets"))
    met = worktrees.join(branches.select("branch", "upstream", "ahead", "behind"), "branch", "left").join(head, "head", "left").join(kinds, "path", "left").join(held, "path", "left").join(named, "branch", "left")
    label = F.coalesce("branch", F.concat(F.lit("detached at "), F.substring(F.coalesce("head", F.lit("")), 1, 7)))
    of = lambda c: F.when(F.col("upstream").isNotNull(), F.col(c))
    count = F.when(F.col("whole"), F.lit(number)).when(F.coalesce("head", F.lit("")) != "", 1).otherwise(0).cast("long")
    return met.select("path", label.alias("label"), "is_main", of("ahead").alias("ahead"), of("behind").alias("behind"), count.alias("commits"), "changes", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("tickets", F.array().cast("array<string>")).alias("tickets"))
