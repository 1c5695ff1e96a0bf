"""Queries over search entries."""

from pyspark.sql import functions as F

from graphweft.model import ENTRY_KINDS, rank
from graphweft.operators import search as S
from graphweft.plans.adapters import adapted
from graphweft.plans.registry import query

QUERY = "sup 1"


def _entries(spark, sf):
    return S.prepared(adapted(spark, sf, "entries"))


MASK = " | ".join(f"(CASE WHEN contains(lower(name), '{c}') THEN {1 << i}::BIGINT ELSE 0 END)" for i, c in enumerate(S.MASK_CHARS))
KIND = "list_position(['" + "','".join(ENTRY_KINDS) + "'], kind)"


@query(f"SELECT kind, name, {MASK} AS mask FROM entries", "entries")
def char_mask(spark, sf):
    return _entries(spark, sf).select("kind", "name", F.col("name_mask").alias("mask"))


@query("SELECT kind, name, key FROM entries WHERE contains(lower(name), 's') AND contains(lower(name), 'u') AND contains(lower(name), 'p') AND contains(lower(name), '1')", "entries")
def char_mask_filter(spark, sf):
    bits = S.mask_of("sup1")
    return _entries(spark, sf).where(F.col("name_mask").bitwiseAND(F.lit(bits)) == bits).select("kind", "name", "key")


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM entries WHERE kind IN ('Command', 'Tool') GROUP BY kind", "entries")
def search_scope(spark, sf):
    return adapted(spark, sf, "entries").where(S.in_scope(F.col("kind"), S.scope(" >x")[0])).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def search_topk(spark, sf):
    """The fuzzy score has no counterpart in SQL: tested against a brute-force version."""
    return S.search(_entries(spark, sf), QUERY).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


#: every subsequence match by name alone; paths add File, Folder and Symbol rows
SUBSEQUENCE = "(lower(name) LIKE '%s%u%p%1%' OR (kind IN ('File', 'Folder', 'Symbol') AND lower(path) LIKE '%s%u%p%1%'))"


@query(f"SELECT CAST(greatest(0, {KIND} - 2) AS INT) AS grp, CAST(count(*) AS BIGINT) AS total FROM entries WHERE {SUBSEQUENCE} GROUP BY 1", "entries")
def search_by_index(spark, sf):
    held, index = S.pair_index(adapted(spark, sf, "entries"))
    return S.matches(S.candidates(held, index, QUERY), QUERY).groupBy(S.group_of(F.col("kind")).alias("grp")).agg(F.count(F.lit(1)).alias("total"))


@query(f"SELECT CAST(greatest(0, {KIND} - 2) AS INT) AS grp, CAST(count(*) AS BIGINT) AS total FROM entries WHERE {SUBSEQUENCE} GROUP BY 1", "entries")
def search_totals(spark, sf):
    return S.matches(_entries(spark, sf), QUERY).groupBy(S.group_of(F.col("kind")).alias("grp")).agg(F.count(F.lit(1)).alias("total"))


@query(
    f"""SELECT kind, name, key, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY greatest(0, {KIND} - 2) ORDER BY len(name) DESC, {KIND}, name, path NULLS FIRST, line NULLS FIRST, key, detail) AS pos FROM entries) r
    WHERE pos <= CASE WHEN kind IN ('File', 'Folder', 'Symbol') THEN 8 ELSE 5 END""",
    "entries",
)
def result_order_caps(spark, sf):
    e = adapted(spark, sf, "entries").withColumns({"score": F.length("name"), "grp": S.group_of(F.col("kind"))})
    ranked = e.withColumn("pos", F.row_number().over(S.ordered(["grp"])))
    return ranked.where(F.col("pos") <= S.caps(False)).select("kind", "name", "key", "pos")


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'File' AS kind FROM sources UNION ALL SELECT 'Tool' FROM supplier UNION ALL SELECT 'Command' FROM customer UNION ALL SELECT 'Symbol' FROM part WHERE p_size % 3 > 0) u GROUP BY kind", "sources")
def segment_union(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    tools = S.other_entries(t("supplier"), "Tool", F.col("s_name"), F.lit("supplier"), F.col("s_suppkey"))
    commands = S.other_entries(t("customer"), "Command", F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey"))
    members = t("part").selectExpr("p_type path", "p_name name", "if(p_size % 3 = 0, 'link', 'fn') kind", "p_size line", "p_partkey idx")
    every = S.segments(S.file_entries(adapted(spark, sf, "sources")), tools, commands, S.symbol_entries(members))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT DISTINCT regexp_extract(f, '([^/]*)$', 1) AS name, f AS path FROM (SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[:i], '/'))) AS f FROM sources) u""",
    "sources",
)
def folder_entries(spark, sf):
    return S.folder_entries(adapted(spark, sf, "sources")).select("name", "path")


@query(f"SELECT kind, CAST({KIND} - 1 AS INT) AS rank, CAST(greatest(0, {KIND} - 2) AS INT) AS grp, CAST(count(*) AS BIGINT) AS n FROM entries GROUP BY kind", "entries")
def entry_groups(spark, sf):
    return adapted(spark, sf, "entries").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", rank("kind", ENTRY_KINDS).alias("rank"), S.group_of(F.col("kind")).alias("grp"), "n")
