"""Exact top-k by inner product: histograms of all scores are refined until each kth value is known."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import settle
from graphweft.llm.vectors import rows_by_length, stacked

#: Bins of a histogram, and rows of a block of queries and of candidates.
BINS, QUERY_ROWS, CANDIDATE_ROWS, TILE = 128, 4096, 8192, 256
#: Scores are 64-bit; larger ones count as the largest.
LIMIT = 2**63 - 1


#: Stands for a null id among numbers: after all ids, and told from a real one by the flag beside it.
NO_ID = LIMIT


def _quantised(scale: float):
    """Rows with a number of their own: (task, place in it)."""

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            blobs, dims, squares = [None] * len(batch), np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for rows, x in rows_by_length(batch.column(1)):
                good = np.isfinite(x).all(axis=1)
                with np.errstate(over="ignore"):
                    v = np.floor(scale * x[good]) + 0.0
                    squares[rows[good]] = np.minimum((v * v).sum(axis=1), 1e300)
                v = np.clip(v, -1e300, 1e300)
                for row, blob in zip(rows[good].tolist(), v, strict=True):
                    blobs[row], dims[row] = blob.tobytes(), len(blob)
            ids = batch.column(0).cast(pa.int64())
            columns = [pa.array(np.arange(at, at + len(batch))), pc.fill_null(ids, NO_ID), ids.is_null(), pa.array(dims), pa.array(squares), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "no_id", "dim", "square", "v"])
            at += len(batch)

    return run


def _scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products: sums below the mantissa's reach stay exact in floating point."""
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(q) @ whole(c).T, -LIMIT, LIMIT).astype(np.int64)


def _tiles(queries: pd.DataFrame, candidates: pd.DataFrame, bound: float):
    """(queries' places, candidates' places, scores, which are the query's own row) in tiles; callers leave own rows out."""
    lengths = candidates.groupby("dim").indices
    for dim, rows in queries.groupby("dim").indices.items():
        if dim not in lengths:
            continue
        own = lengths[dim]
        c = stacked(candidates["v"].to_numpy()[own])
        numbers = candidates["row"].to_numpy()[own]
        for at in range(0, len(rows), TILE):
            part = rows[at : at + TILE]
            s = _scores(stacked(queries["v"].to_numpy()[part]), c, bound)
            yield part, own, s, numbers[None, :] == queries["row"].to_numpy()[part][:, None]


def _histogram(k: int, bound: float, span: int, width: int):
    """Counts by bin of the scores in the span above each query's low end; bins below the block's own kth score can't hold the kth of all."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            for part, _, s, own in _tiles(queries, candidates, bound):
                low = queries["low"].to_numpy()[part][:, None]
                above = s.astype(object) - low.astype(object) if bound >= 2**61 else s - low
                b, inside = above // width, ((above >= 0) & (above < span) & ~own).astype(bool)
                r, c = np.nonzero(inside)
                counts = np.bincount(r * BINS + b[r, c].astype(np.int64), minlength=len(part) * BINS).reshape(len(part), BINS)
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # in higher bins
                r, c = np.nonzero((counts > 0) & (above < k))
                out.append(pd.DataFrame({"row": queries["row"].to_numpy()[part][r], "bin": c, "n": counts[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "bin": [], "n": []}, dtype=np.int64)

    return run


def _selected(bound: float):
    """Scores above each query's kth value, and of the scores equal to it the smallest ids, as many as may be needed."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values(["no_id", "vec_id", "row"], ignore_index=True)
            ids, no_ids = candidates["vec_id"].to_numpy(), candidates["no_id"].to_numpy()
            for part, places, s, own in _tiles(queries, candidates, bound):
                low, need = queries["low"].to_numpy()[part], queries["need"].to_numpy()[part]
                r, c = np.nonzero((s > low[:, None]) & ~own)
                tr, tc = np.nonzero((s == low[:, None]) & ~own)
                few = np.arange(len(tr)) - np.searchsorted(tr, tr) < need[tr]
                r, c = np.concatenate((r, tr[few])), np.concatenate((c, tc[few]))
                out.append(pd.DataFrame({"row": queries["row"].to_numpy()[part][r], "vec_id": ids[places[c]], "no_id": no_ids[places[c]], "score": s[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "vec_id": [], "no_id": [], "score": []}, dtype=np.int64).astype({"no_id": bool})

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by every.

    Components become floor(scale * x); the score is the integer inner product; ties go to the smaller vec_id. Blocks of
    queries meet blocks of candidates. Each round counts scores by bin, keeps the bin with the kth value and divides
    it further until a bin is one score; then only scores at or above that value are emitted.

    Queries and candidates are rows, not ids: each row whose id is divisible asks, and all rows but itself answer, those
    that repeat an id or a vector too. Rows with a null id ask nothing and answer with a null vec_id, last among ties.
    Null vectors and those that hold null or non-finite components take no part; vectors of different length don't meet.
    Scores beyond 64 bits count as the largest. Further columns are ignored. No rows: no result.
    """
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    rows = settle(picked.mapInArrow(_quantised(scale), "row long, vec_id long, no_id boolean, dim int, square double, v binary").where("v is not null"))
    asking = (F.col("vec_id") % every == 0) & ~F.col("no_id")
    size, largest, asked = rows.agg(F.count(F.lit(1)), F.max("square"), F.count_if(asking)).first()
    bound = min(int(largest or 0), LIMIT)
    # (blocks of queries) x candidates and (blocks of candidates) x queries are dealt, never row by row.
    nq, nc = max(1, -(-asked // QUERY_ROWS)), max(1, -(-size // CANDIDATE_ROWS))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    candidates = rows.select("row", "vec_id", "no_id", "dim", "v", deal(nc, 1).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb")).groupBy("qb", "cb")
    queries = settle(rows.where(asking).select("row", F.col("vec_id").alias("query_id"), "dim", "v", deal(nq, 2).alias("qb")))
    span = 2 * bound + 1
    width = -(-span // BINS)
    state = queries.select("row", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    dealt = lambda state: queries.drop("query_id").join(state, "row").select("row", "dim", "v", "qb", "low", "need", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb")).groupBy("qb", "cb")
    while True:
        counts = dealt(state).cogroup(candidates).applyInPandas(_histogram(k, float(bound), span, width), "row long, bin int, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("row").orderBy(F.desc("bin"))
        upto = counts.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        kth = upto.join(state, "row").where("upto >= need and upto - n < need").select("row", F.expr(f"cast(cast(low as decimal(20)) + cast(bin as decimal(10)) * cast({width} as decimal(20)) as long)").alias("low"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
        # Fewer rows than k: all are taken. A query that no row of its length meets has none.
        state = settle(state.select("row", F.col("need").alias("want")).join(kth, "row", "left").select("row", F.coalesce("low", F.lit(-bound - 1)).cast("long").alias("low"), F.coalesce("need", "want").alias("need")))
        if width == 1:
            break
        span, width = width, -(-width // BINS)
    best = dealt(state).cogroup(candidates).applyInPandas(_selected(float(bound)), "row long, vec_id long, no_id boolean, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "no_id", "vec_id"))).where(F.col("rank") <= k)
    return ranked.join(queries.select("row", "query_id"), "row").select("query_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score")


#: The same in SQL. Sums of integers below 2**53 are exact in double precision.
SQL = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (
  SELECT a.k, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.k <> b.k
  WHERE a.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) AS place, vec_id, score FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""
