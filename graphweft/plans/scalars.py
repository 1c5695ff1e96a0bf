"""Queries over scalar functions."""

from pyspark.sql import functions as F

from graphweft.functions import paths as P
from graphweft.functions import text as X
from graphweft.operators import search as S
from graphweft.plans.adapters import adapted
from graphweft.plans.registry import query


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    """SELECT l_orderkey, l_linenumber, n, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0)
    WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0) ELSE printf('%.1f TB', n / 1099511627776.0) END AS size, format('{:,}', n) AS grouped
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * l_partkey * l_suppkey * l_linenumber * 1000 AS BIGINT) AS n FROM lineitem) l"""
)
def human_bytes_fmt(spark, sf):
    """Sizes are exact; n is null where it is past the longs."""
    part, supplier = "cast(l_partkey as decimal(19))", "cast(l_suppkey as decimal(19))"
    rows = _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"cast({part} * {part} as decimal(38)) * cast({supplier} * l_linenumber * 1000 as decimal(38)) n")
    return rows.select("l_orderkey", "l_linenumber", F.expr("try_cast(n as long)").alias("n"), X.human_bytes(F.col("n")).alias("size"), X.thousands(F.col("n")).alias("grouped"))


@query(
    r"""SELECT p_partkey, ident, lower(replace(regexp_replace(regexp_replace(ident, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '([A-Z])([A-Z][a-z])', '\1-\2', 'g'), '_', '-')) AS kebab
    FROM (SELECT p_partkey, concat('HTTP', replace(p_name, ' ', '_'), 'RegistryGet', p_size, 'URLOf') AS ident FROM part) p"""
)
def kebab_case_fmt(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat('HTTP', replace(p_name, ' ', '_'), 'RegistryGet', p_size, 'URLOf') ident")
    return rows.withColumn("kebab", X.kebab_case(F.col("ident")))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('a/b/', p_partkey) WHEN 1 THEN concat('a/c', p_partkey) WHEN 2 THEN NULL ELSE '' END AS folded FROM part"""
)
def path_normalise(spark, sf):
    raw = F.expr("case p_partkey % 4 when 0 then concat('./a//b/x/../', p_partkey) when 1 then concat('a/b/.././c', p_partkey) when 2 then '../x' else 'a/..' end")
    return _t(spark, sf, "part").select("p_partkey", P.normalised(raw).alias("folded"))


@query(
    """WITH p AS (SELECT path, string_split(path, '/') AS s FROM paths)
    SELECT path, CASE len(path) % 3 WHEN 0 THEN CASE WHEN len(s) = 2 THEN 'readme.md' WHEN len(s) > 2 THEN array_to_string(s[:len(s) - 2], '/') || '/readme.md' END WHEN 1 THEN 'docs/a.md' END AS target FROM p""",
    "paths",
)
def link_targets(spark, sf):
    p = adapted(spark, sf, "paths")
    link = F.expr("case length(path) % 3 when 0 then '../readme.md#top' when 1 then '/docs/./a.md?x' else 'https://x.org/a' end")
    return p.select("path", P.joined(P.parent(F.col("path")), link).alias("target"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(epoch_us(ts) // 1000 + CASE event_id % 3 WHEN 1 THEN -7200000 ELSE 0 END AS BIGINT) END AS ms FROM events")
def rfc3339_parse(spark, sf):
    e = _t(spark, sf, "events")
    text = F.expr("concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\"), case event_id % 3 when 0 then 'Z' when 1 then '+02:00' else '' end)")
    return e.select("event_id", X.parse_time(text).alias("ms"))


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, ' min ago') WHEN s < 86400 THEN concat(s // 3600, ' h ago') WHEN s < 2592000 THEN concat(s // 86400, ' d ago')
    WHEN s < 31536000 THEN concat(s // 2592000, ' mo ago') ELSE concat(s // 31536000, ' y ago') END AS age FROM (SELECT event_id, CAST(event_id * event_id * 17 AS BIGINT) AS s FROM events) e"""
)
def age_ladder(spark, sf):
    return _t(spark, sf, "events").select("event_id", X.age_text(F.col("event_id") * F.col("event_id") * 17_000, F.lit(0).cast("long")).alias("age"))


@query("SELECT event_id, strftime(make_timestamp(event_id * 1234567000000 + 5400000000), '%Y-%m-%d %H:%M') AS clock FROM events")
def local_clock(spark, sf):
    return _t(spark, sf, "events").select("event_id", X.clock_text(F.col("event_id") * 1_234_567_000, 90).alias("clock"))


@query("SELECT doc_id, CASE WHEN len(text) <= 30 THEN text ELSE substr(text, 1, 30) || '…' END AS short, CASE WHEN len(text) <= 30 THEN text ELSE '…' || right(text, 29) END AS tail FROM documents")
def text_trimming(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.shortened(F.col("text"), 30).alias("short"), X.shortened_start(F.col("text"), 30).alias("tail"))


@query(
    r"""SELECT doc_id, CASE WHEN len(s) > 200 THEN substr(s, 1, 199) || '…' ELSE s END AS sentence FROM (
      SELECT doc_id, CASE WHEN regexp_matches(line, '[.!?] ') THEN regexp_extract(line, '^(.*?[.!?]) ', 1) ELSE line END AS s FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')) AS line FROM documents) l) m WHERE s <> ''"""
)
def first_sentences(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence")).where("sentence is not null")


@query("SELECT p_partkey, concat('note ', p_name) AS note FROM part")
def comment_cleaning(spark, sf):
    raw = F.expr("case p_partkey % 4 when 0 then concat('/// note ', p_name) when 1 then concat('# note ', p_name) when 2 then concat('/** note ', p_name, ' */') else concat('-- note ', p_name) end")
    return _t(spark, sf, "part").select("p_partkey", X.clean_comment(raw).alias("note"))


@query("SELECT p_partkey, concat('B', p_size) AS base, concat('m', p_size) AS module FROM part")
def name_cleaning(spark, sf):
    base = F.expr("case p_partkey % 3 when 0 then concat('a::b::B', p_size, '<T, U>') when 1 then concat('&pkg.B', p_size, '(x)') else concat('B', p_size) end")
    module = F.expr("case p_partkey % 3 when 0 then concat('\"./m', p_size, '.js\"') when 1 then concat('m', p_size, '.py') else concat('./m', p_size) end")
    return _t(spark, sf, "part").select("p_partkey", X.clean_base(base).alias("base"), X.clean_import(module).alias("module"))


@query("SELECT CASE p_partkey % 5 WHEN 0 THEN 'Rust' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'C' WHEN 3 THEN 'Enforce Script' END AS language, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def language_names(spark, sf):
    path = F.expr("case p_partkey % 5 when 0 then 'a/b.RS' when 1 then 'x.mts' when 2 then 'c.c' when 3 then 'e.c' else 'none' end")
    content = F.expr("if(p_partkey % 5 = 3, 'modded class A {}', 'int x;')")
    return _t(spark, sf, "part").select(X.language(path, content).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT page_id, list_filter(string_split(replace(html, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x) <> '')[:10] AS lines FROM pages)
    SELECT page_id, len(lines) > 0 AND floor(list_sum(list_transform(lines, lambda x: strlen(x))) / len(lines)) > 400 AS one_line FROM l"""
)
def minified_test(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.is_minified(F.col("html")).alias("one_line"))


@query(
    """SELECT p_partkey, CASE WHEN (len(p_name) - len(replace(p_name, substr(p_name, 1, 4), ''))) // 4 = 1 THEN replace(p_name, substr(p_name, 1, 4), 'NEW') END AS edited FROM part"""
)
def snippet_edit(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", X.apply_edit(F.col("p_name"), F.substring("p_name", 1, 4), F.lit("NEW")).alias("edited"))


@query("SELECT doc_id, lower(text) AS folded FROM documents")
def fold_lower(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.fold_lower(F.col("text")).alias("folded"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT text) AS BIGINT) AS distinct_texts FROM documents")
def content_hashes(spark, sf):
    hashed = _t(spark, sf, "documents").select(X.content_hash(F.col("text")).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("h").alias("distinct_texts"))


@query("SELECT CAST(floor(3 * (CAST(event_id AS BIGINT) - 500) / 4.0) AS BIGINT) AS weighted, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def path_weighting(spark, sf):
    return _t(spark, sf, "events").select(S.path_points(F.col("event_id") - 500).alias("weighted")).groupBy("weighted").agg(F.count(F.lit(1)).alias("n"))
