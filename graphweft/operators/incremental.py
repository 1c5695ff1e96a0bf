"""A tree of folders that knows by hashes what changed: one changed file costs its ancestors, not a whole run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.paths import depth as _level
from graphweft.storage import settle

#: A node's row: files are nodes without children, the root's path is empty and its parent null.
NODE = ("path", "parent", "level", "is_file", "files", "bytes", "hash")


def _parent(path: Column) -> Column:
    return F.when(path == "", F.lit(None)).when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _leaves(files: DataFrame) -> DataFrame:
    path = F.col("path")
    one = files.where("path is not null and path <> ''").groupBy("path").agg(F.max(F.struct("bytes", "hash")).alias("f"))
    return one.select("path", _parent(path).alias("parent"), _level(path).cast("int").alias("level"), F.lit(True).alias("is_file"), F.lit(1).cast("long").alias("files"), F.coalesce("f.bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("f.hash", F.lit(0)).cast("long").alias("hash"))


def _rolled(children: DataFrame, level: int) -> DataFrame:
    """Rows of the folders of a level from those of all their children: sums and a hash that no order changes, combined before the shuffle."""
    of = lambda seed: F.xxhash64("path", "is_file", "hash", F.lit(seed))
    met = children.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("path")).agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.bit_xor(of(1)).alias("x"), F.sum(of(2).cast("decimal(38,0)")).alias("s")
    )
    return met.select("path", _parent(F.col("path")).alias("parent"), F.lit(level).alias("level"), F.lit(False).alias("is_file"), "files", "bytes", F.xxhash64("n", "x", "s").alias("hash"))


def tree(files: DataFrame) -> DataFrame:
    """A row for each file (path, bytes, hash) and each folder above one, with files, bytes and hash of what lies below.

    Level by level from the deepest, as many rounds as folders stand in each other. A folder's hash tells the names and
    hashes of its children, so equal hashes are equal subtrees. Of rows of one path the greatest counts; null and empty
    paths are left out; null bytes and hashes are 0.
    """
    leaves = settle(_leaves(files))
    depth = leaves.agg(F.max("level")).first()[0] or 0
    out, upper = leaves, leaves.where("false")
    for level in reversed(range(depth)):
        upper = settle(_rolled(leaves.where(F.col("level") == level + 1).unionByName(upper), level))
        out = out.unionByName(upper)
    return out


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, is_file, change) of all nodes of two trees that differ: added, removed or changed. Only subtrees that differ are entered.

    From the root down: a level's nodes are compared only if their parent differs, so work and rounds follow what changed.
    """
    side = lambda t, p: t.select(*(F.col(c).alias(p + c) for c in ("path", "parent", "level", "is_file", "hash")))
    out, open_folders, level = None, None, 0
    while True:
        a, b = side(old.where(F.col("level") == level), "o_"), side(new.where(F.col("level") == level), "n_")
        if open_folders is not None:
            a = a.join(open_folders.select(F.col("path").alias("o_parent")), "o_parent", "left_semi")
            b = b.join(open_folders.select(F.col("path").alias("n_parent")), "n_parent", "left_semi")
        met = a.join(b, (F.col("o_path") == F.col("n_path")) & (F.col("o_is_file") == F.col("n_is_file")), "full").where("not (o_hash <=> n_hash)")
        change = F.when(F.col("o_path").isNull(), "added").when(F.col("n_path").isNull(), "removed").otherwise("changed")
        found = settle(met.select(F.coalesce("n_path", "o_path").alias("path"), F.coalesce("n_is_file", "o_is_file").alias("is_file"), change.alias("change")))
        out = found if out is None else out.unionByName(found)
        open_folders = found.where("not is_file").select("path").distinct()
        if open_folders.isEmpty():
            return out
        level += 1


def refreshed_rows(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the nodes that changed files (path, bytes, hash, gone) touch: these files and their ancestors; of nodes that are no more, with files 0.

    Level by level upwards: a folder is made anew from its children's rows, the touched ones and the old ones, so what is
    read are the children of ancestors of changed files, and what is made are these ancestors.
    """
    changes = settle(changes.where("path is not null and path <> ''"))
    depth = changes.select(_level(F.col("path")).alias("l")).agg(F.max("l")).first()[0] or 0
    gone = changes.where("gone").select("path").distinct()
    empty = [F.lit(0).cast("long").alias(c) for c in ("files", "bytes", "hash")]
    lost = gone.select("path", _parent(F.col("path")).alias("parent"), _level(F.col("path")).cast("int").alias("level"), F.lit(True).alias("is_file"), *empty)
    fresh = settle(_leaves(changes.where("not gone").select("path", "bytes", "hash")).unionByName(lost))
    out, upper = fresh, fresh.where("false")
    for level in reversed(range(depth)):
        below = fresh.where(F.col("level") == level + 1).unionByName(upper)
        touched = below.select("parent").distinct()
        kept = old.where(F.col("level") == level + 1).join(touched, "parent", "left_semi").join(below.select("path", "is_file"), ["path", "is_file"], "left_anti")
        made = _rolled(kept.select(*NODE).unionByName(below.where("files > 0").select(*NODE)), level)
        ended = touched.select(F.col("parent").alias("path")).join(made.select("path"), "path", "left_anti").select("path", _parent(F.col("path")).alias("parent"), F.lit(level).alias("level"), F.lit(False).alias("is_file"), *empty)
        upper = settle(made.unionByName(ended))
        out = out.unionByName(upper)
    return out


def refreshed_tree(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree after changes, equal to tree() of all files: old rows but for those that refreshed_rows made anew."""
    fresh = settle(refreshed_rows(old, changes))
    return old.join(fresh.select("path", "is_file"), ["path", "is_file"], "left_anti").select(*NODE).unionByName(fresh.where("files > 0").select(*NODE))

