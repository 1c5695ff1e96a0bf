"""Mixing sources to target weights: capped water-filling and seeded repetitions. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import settle, word_count
from graphweft.operators.order import running

#: Weights of the sources in their order, repeating. Fixed by the contract.
WEIGHTS = (1, 2, 3)
#: A source is taken so many times at most.
MAX_EPOCHS = 3
#: Rows of the plan (a source and part each) that go along with the documents by broadcast at most.
BROADCAST_ROWS = 1 << 18
#: Parts of a source by a seeded hash (three hex digits). All of a part but one per source is taken or left as a whole.
PARTS = 4096


def source_key(source: Column) -> Column:
    """Null-safe key of a source; null is a source of its own, after all others."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def seeded_part(doc_id: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 3), 16, 10).cast("int")


def water_filled(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (key, source_size) with target: shares of all sizes by weight, clamped at epochs * size.

    Clamping the sources that exceed their cap and sharing the excess by weight until none does ends at one level:
    target = min(cap, level * weight). With sources in order of cap / weight, the clamped ones come first, and the level
    is that of the first source whose share fits. Sources may be many: their order and running sums are made by ranges.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int")).cast("long")
    capped = running(sources, "key").select("key", "source_size", w.alias("w"), (F.col("source_size") * epochs).alias("cap")).withColumn("filled", F.col("cap") / F.col("w"))
    shared = settle(running(capped, "filled", "key", sums=("cap", "w")))
    size, weight = shared.agg(F.sum("source_size"), F.sum("w")).first()
    left, rest = F.lit(size) - F.col("before_cap"), F.lit(weight) - F.col("before_w")
    fits = shared.where(left * F.col("w") <= F.col("cap") * rest)
    level = fits.agg(F.min_by(left.cast("double") / rest, F.struct("filled", "key"))).first()[0]
    return shared.select("key", "source_size", F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("w")).alias("target"))


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """For sized (key, size, part): per source and part how often its documents are taken.

    (key, part, source_size, target, whole, some, of): a document is taken whole times, and of its size a share of
    some / of once more. The extra share is 1 for the parts that fit under the target, 0 beyond it, and the exact
    remainder for the part in which the target falls. A row for each source and part that has documents.
    """
    parts = settle(sized.groupBy("key", "part").agg(F.sum("size").alias("part_size")))
    targets = water_filled(parts.groupBy("key").agg(F.sum("part_size").alias("source_size")), weights, epochs)
    upto = F.sum("part_size").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    planned = parts.withColumn("upto", upto).join(targets, "key").withColumn("wanted", F.floor("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(0)
    planned = planned.withColumn("whole", whole).withColumn("extra", F.col("wanted") - F.col("whole") * F.col("source_size"))
    some = F.greatest(F.lit(0), F.least(F.col("part_size"), F.col("extra") - F.col("upto") + F.col("part_size")))
    return planned.select("key", "part", "source_size", "target", "whole", some.alias("some"), F.greatest("part_size", F.lit(1)).alias("of"))


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size"), seeded_part(F.col(id_col), seed).alias("part"))


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    taken is what the mix takes of the row's words: whole repetitions and a seeded fractional one. A source's sum comes
    within a word a document of one part of its target. Null texts have size 0, a null source sorts last, null ids share
    a part; repeated rows are rows of their own; further columns are ignored. No rows, or no words: nothing is taken.
    """
    sized = settle(_sized(docs, seed, id_col, text_col, source_col))
    taken = F.col("whole") * F.col("size") + F.expr("size * some div of")
    return sized.join(plan_mix(sized), ["key", "part"]).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """docs as the mix takes them: a row for each whole repetition, and one with the first words of a fractional one.

    Columns are those of docs; chars_col, where there is one, is counted anew on cut texts. Documents of which nothing
    is taken go. Texts stay where they are: the plan comes to them where it is BROADCAST_ROWS rows at most (PARTS a
    source), and by a join beyond.
    """
    sized = settle(_sized(docs, seed, id_col, text_col, source_col).groupBy("key", "part").agg(F.sum("size").alias("size")))
    plan = plan_mix(sized).select(F.col("key").alias("_mix_key"), F.col("part").alias("_mix_part"), F.col("whole").alias("_mix_whole"), F.col("some").alias("_mix_some"), F.col("of").alias("_mix_of"))
    plan = settle(plan)
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    keyed = docs.withColumn("_mix_size", word_count(F.col(text_col))).withColumn("_mix_part_of", seeded_part(F.col(id_col), seed)).withColumn("_mix_key_of", source_key(F.col(source_col)))
    met = keyed.join(plan, (F.col("_mix_key_of") == F.col("_mix_key")) & (F.col("_mix_part_of") == F.col("_mix_part")))
    met = met.withColumn("_mix_words", F.expr("int(_mix_size * _mix_some div _mix_of)"))
    cut = (F.col("_mix_words") > 0) & (F.col("_mix_words") < F.col("_mix_size"))
    copies = F.col("_mix_whole") + F.when(F.col("_mix_words") > 0, 1).otherwise(0)
    many = met.where(copies > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    words = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_mix_words")))
    out = many.withColumn("_mix_cut", cut & (F.col("_mix_copy") > F.col("_mix_whole"))).withColumn(text_col, F.when(F.col("_mix_cut"), words).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col("_mix_cut"), F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.select(*docs.columns)


#: The same in SQL.
SQL = r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce('0' || source, '1') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 3) AS INTEGER) AS part
  FROM documents),
parts AS (SELECT k, part, CAST(sum(size) AS BIGINT) AS part_size FROM sized GROUP BY k, part),
sources AS (SELECT k, CAST(sum(part_size) AS BIGINT) AS source_size FROM parts GROUP BY k),
weighted AS (
  SELECT k, source_size, 3 * source_size AS cap, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM sources),
shared AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS l,
         CAST(sum(w) OVER () AS BIGINT) - CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS rest
  FROM weighted WINDOW o AS (ORDER BY cap / CAST(w AS DOUBLE), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT CAST(l AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM shared WHERE l * w <= cap * rest
  ORDER BY cap / CAST(w AS DOUBLE), k LIMIT 1),
targets AS (
  SELECT k, source_size, least(CAST(cap AS DOUBLE), level * CAST(w AS DOUBLE)) AS target FROM shared, level),
planned AS (
  SELECT p.k, p.part, part_size, source_size, target, CAST(floor(target) AS BIGINT) AS wanted,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole,
         CAST(sum(part_size) OVER (PARTITION BY p.k ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM parts p JOIN targets t ON p.k = t.k),
shares AS (
  SELECT k, part, source_size, target, whole, greatest(part_size, 1) AS of,
         greatest(0, least(part_size, wanted - whole * source_size - upto + part_size)) AS some
  FROM planned)
SELECT s.doc_id, s.size, h.source_size, h.target, CAST(h.whole * s.size + (s.size * h.some) // h.of AS BIGINT) AS taken
FROM sized s JOIN shares h ON s.k = h.k AND s.part = h.part
"""
