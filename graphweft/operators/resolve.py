"""Path resolution: unique or nothing, segment by segment, over tables of modules, items and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.storage import settle


def resolve(paths: DataFrame, modules: DataFrame, names: DataFrame, imports: DataFrame, externs: DataFrame) -> DataFrame:
    """(ref, tag, target, candidates): what each path (ref, module, segments array<string>) names.

    modules: module, parent, crate, root (its crate's root module); names: module, name, target, is_module, public;
    imports: module, name ('*' for a glob), segments, public; externs: crate, name, root (null: outside the project).
    tag: item, external, ambiguous, or unresolved. Each round takes one segment of all open paths: crate, self and super
    move, externs change crate, names of the module are joined, imports put their own path in the segment's place. A
    segment with several different targets is ambiguous and gives no answer. An import that a path went through already
    is a cycle and no answer; with that rounds end, however many imports lead on.
    """
    m = modules.select("module", "parent", "crate", "root")
    open_ = settle(paths.select("ref", "module", "segments", F.col("module").alias("home"), F.lit(0).alias("taken"), F.array().cast("array<string>").alias("trail")))
    done = None
    while not open_.isEmpty():
        at = open_.join(m, "module", "left").withColumn("head", F.get("segments", F.lit(0))).withColumn("rest", F.expr("slice(segments, 2, greatest(size(segments) - 1, 0))"))
        jump = F.when(F.col("head") == "crate", F.col("root")).when(F.col("head") == "self", F.col("module")).when(F.col("head") == "super", F.col("parent"))
        moved = at.where(F.col("head").isin("crate", "self", "super") & jump.isNotNull())
        moved = moved.select("ref", jump.alias("module"), F.col("rest").alias("segments"), "home", F.col("taken") + 1, "trail")
        named = at.where(~F.col("head").isin("crate", "self", "super"))
        seen = (F.col("public") == True) | (F.col("module") == F.col("home"))  # noqa: E712
        own = named.join(names.withColumnRenamed("name", "head"), ["module", "head"]).where(seen).select("ref", "rest", "home", "taken", "trail", "target", "is_module", F.lit(0).alias("rank"), F.lit(None).cast("array<string>").alias("via"), F.lit(None).cast("string").alias("via_module"))
        aliased = named.join(imports.where("name <> '*'").select("module", F.col("name").alias("head"), F.col("segments").alias("via"), "public"), ["module", "head"]).where(seen).select("ref", "rest", "home", "taken", "trail", F.lit(None).cast("string").alias("target"), F.lit(False).alias("is_module"), F.lit(0).alias("rank"), "via", F.col("module").alias("via_module"))
        globbed = named.join(imports.where("name = '*'").select("module", F.col("segments").alias("glob"), "public"), "module").where(seen).select("ref", "rest", "home", "taken", "trail", F.lit(None).cast("string").alias("target"), F.lit(False).alias("is_module"), F.lit(1).alias("rank"), F.concat("glob", F.array("head")).alias("via"), F.col("module").alias("via_module"))
        outside = named.where("taken = 0").join(externs.select("crate", F.col("name").alias("head"), F.col("root").alias("to")), ["crate", "head"]).select("ref", "rest", "home", "taken", "trail", F.coalesce("to", F.lit("external")).alias("target"), F.col("to").isNotNull().alias("is_module"), F.lit(2).alias("rank"), F.lit(None).cast("array<string>").alias("via"), F.lit(None).cast("string").alias("via_module"))
        found = own.unionByName(aliased).unionByName(globbed).unionByName(outside).withColumn("step", F.concat_ws("\n", "via_module", F.array_join("via", "::"))).where("via is null or not array_contains(trail, step)")
        best = found.groupBy("ref").agg(F.min("rank").alias("best"))
        kept = settle(found.join(best, "ref").where("rank = best").dropDuplicates(["ref", "target", "via", "via_module"]))
        counts = kept.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
        one = kept.join(counts, "ref")
        several = one.where("n > 1").groupBy("ref").agg(F.count(F.lit(1)).cast("int").alias("candidates")).select("ref", F.lit("ambiguous").alias("tag"), F.lit(None).cast("string").alias("target"), "candidates")
        single = one.where("n = 1")
        external = (F.col("rank") == 2) & (F.col("target") == "external")
        ends = single.where("via is null and (size(rest) = 0 or not is_module)").select("ref", F.when(external, "external").otherwise("item").alias("tag"), "target", F.lit(1).alias("candidates"))
        lost = at.where("head is not null").select("ref").distinct().join(kept.select("ref"), "ref", "left_anti").join(moved.select("ref"), "ref", "left_anti").select("ref", F.lit("unresolved").alias("tag"), F.lit(None).cast("string").alias("target"), F.lit(0).alias("candidates"))
        emptied = moved.where("size(segments) = 0").select("ref", F.lit("item").alias("tag"), F.col("module").alias("target"), F.lit(1).alias("candidates"))
        closed = settle(several.unionByName(ends).unionByName(lost).unionByName(emptied))
        done = closed if done is None else done.unionByName(closed)
        deeper = single.where("via is null and is_module and size(rest) > 0").select("ref", F.col("target").alias("module"), F.col("rest").alias("segments"), "home", (F.col("taken") + 1).alias("taken"), "trail")
        followed = single.where("via is not null").select("ref", F.col("via_module").alias("module"), F.concat("via", "rest").alias("segments"), F.col("via_module").alias("home"), F.lit(0).alias("taken"), F.array_append("trail", F.col("step")).alias("trail"))
        open_ = settle(moved.where("size(segments) > 0").toDF("ref", "module", "segments", "home", "taken", "trail").unionByName(deeper).unionByName(followed))
    left = open_.select("ref", F.lit("unresolved").alias("tag"), F.lit(None).cast("string").alias("target"), F.lit(0).alias("candidates"))
    return left if done is None else done.unionByName(left)
