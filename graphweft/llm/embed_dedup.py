"""Embedding near-duplicates: an epsilon grid order join over sequence intervals of sorted vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import drop_settled, join_spread, settle
from graphweft.llm.components import connected_components
from graphweft.llm.simhash import _labels
from graphweft.llm.vectors import rows_by_length, stacked

#: Cells per epsilon along a principal dimension, and the leading dimensions that order the grid.
CELLS_PER_EPS, LEAD = 4, 6
#: The principal dimensions are fitted on so many vectors at most. They only order the sequence; links don't depend on them.
FIT_ROWS = 2048
#: Bytes of a block's vectors, the most rows and the least of it, and into how many blocks a table large enough is cut at least.
BLOCK_BYTES, BLOCK_ROWS, LEAST_ROWS, LEAST_BLOCKS = 1 << 24, 1 << 15, 2048, 8
#: The driver sees boxes of so many intervals of the sequence at most for a vector length, and their pairs; the blocks inside
#: are paired by a join.
INTERVALS = 512


def _cleaned(batches):
    for batch in batches:
        n = len(batch)
        keys, blobs, dims = [None] * n, [None] * n, np.zeros(n, np.int32)
        for rows, x in rows_by_length(batch.column(1)):
            peak = np.abs(x).max(axis=1)
            good = np.isfinite(x).all(axis=1) & (peak > 0)
            x = x[good] + 0.0  # no negative zeros
            for row, v in zip(rows[good].tolist(), x, strict=True):
                blobs[row] = v.tobytes()
                keys[row] = hashlib.blake2b(blobs[row], digest_size=16).digest()
                dims[row] = len(v)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(dims), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], ["vec_id", "dim", "key", "x"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projector(bases: dict, cell: float):
    def project(batches):
        for batch in batches:
            dims, x = batch.column("dim").to_numpy(), batch.column("x").to_pylist()
            cells = np.zeros((len(dims), LEAD), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                basis = bases.get(dim, np.eye(dim)[:, :LEAD])
                cells[at, : basis.shape[1]] = np.floor(_unit(stacked([x[i] for i in at.tolist()])) @ basis / cell)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in cells.T)], [*batch.schema.names, *(f"c{i}" for i in range(LEAD))])

    return project


def _numbered(batches):
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = np.arange(n, n + len(batch), dtype=np.int64)
        n += len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int64)), pa.array(at)], [*batch.schema.names, "part", "at"])


def interval_pairs(boxes: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """Pairs (i <= j) of blocks that may hold close vectors: intervals of the sequence are joined recursively, far ones skipped.

    boxes: dim, then the least and greatest cell of each leading dimension, in sequence order.
    """
    n = len(boxes)
    if not n:
        return []
    low, high = np.array([b[: 1 + LEAD] for b in boxes]).reshape(n, -1), np.array([(b[0], *b[1 + LEAD :]) for b in boxes]).reshape(n, -1)
    cache: dict[tuple[int, int], tuple] = {}

    def box(a, b):
        if (a, b) not in cache:
            cache[a, b] = low[a:b].min(axis=0), high[a:b].max(axis=0)
        return cache[a, b]

    pairs, todo = [], [(0, n, 0, n)]
    while todo:
        a, b, c, d = todo.pop()
        (l1, h1), (l2, h2) = box(a, b), box(c, d)
        gap = np.maximum(0, np.maximum(l2 - h1, l1 - h2))
        # Cells g apart hold vectors over g - 1 cell widths apart.
        if gap[0] or (np.maximum(0, gap[1:] - 1) ** 2).sum() > CELLS_PER_EPS**2:
            continue
        if b - a == 1 and d - c == 1:
            pairs.append((a, c))
        elif (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return sorted(pairs)


def _joiner(threshold: float, leaf: int):
    """Joins two blocks of vectors of one length: for each vector the rows it links to, and a spanning forest of the links."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)  # the sequence: by cells
        nodes, copies, blocks = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        cells = pdf[[f"c{i}" for i in range(LEAD)]].to_numpy()
        number, left, right = np.zeros(len(pdf), np.int64), [], []
        x = stacked(pdf["x"].to_numpy())
        del pdf
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.linalg.norm(scaled, axis=1)
        single = (scaled / norm[:, None]).astype(np.float32)
        slack = np.float32(threshold - 1e-5 - x.shape[1] * 2e-7)
        n = int((blocks == blocks[0]).sum())
        todo = [(0, n, n, len(blocks))] if n < len(blocks) else [(0, n, 0, n)]
        while todo:
            a, b, c, d = todo.pop()
            gap = np.maximum(0, np.maximum(cells[c:d].min(axis=0) - cells[a:b].max(axis=0), cells[a:b].min(axis=0) - cells[c:d].max(axis=0)))
            if (np.maximum(0, gap - 1) ** 2).sum() > CELLS_PER_EPS**2:
                continue
            if b - a > leaf or d - c > leaf:
                if (a, b) == (c, d):
                    m = (a + b) // 2
                    todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
                elif b - a >= d - c:
                    m = (a + b) // 2
                    todo += [(a, m, c, d), (m, b, c, d)]
                else:
                    m = (c + d) // 2
                    todo += [(a, b, c, m), (a, b, m, d)]
                continue
            i, j = np.nonzero(single[a:b] @ single[c:d].T >= slack)  # float32 never misses: slack covers its error
            if (a, b) == (c, d):
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 15):
                p, q = i[at : at + (1 << 15)] + a, j[at : at + (1 << 15)] + c
                cosine = np.einsum("ij,ij->i", scaled[p], scaled[q]) / (norm[p] * norm[q])
                p, q = p[cosine >= threshold], q[cosine >= threshold]
                np.add.at(number, p, copies[q])
                np.add.at(number, q, copies[p])
                left.append(p)
                right.append(q)
            if sum(map(len, left)) > 1 << 20:  # a forest stands for the links so far
                label = _labels(len(nodes), np.concatenate(left), np.concatenate(right))
                left, right = [np.arange(len(nodes))], [label]
        if not left:
            return pd.DataFrame({"node": [], "n": [], "root": []}, dtype=np.int64)
        label = _labels(len(nodes), np.concatenate(left), np.concatenate(right))
        hit = number > 0
        return pd.DataFrame({"node": nodes[hit], "n": number[hit], "root": nodes[label[hit]]})

    return join


def near_pairs(boxes: DataFrame) -> DataFrame:
    """(dim, i, j), i <= j: blocks of one vector length that may hold close vectors. boxes: dim, block, lo0.., hi0.. in sequence order.

    Intervals of many blocks are joined recursively on the driver, INTERVALS a length; the blocks inside the near ones
    meet in a join.
    """
    spark, cells = boxes.sparkSession, range(LEAD)
    counts = boxes.groupBy("dim").agg(F.max("block").alias("last"))
    held = boxes.join(counts, "dim").withColumn("part", F.expr(f"block div (last div {INTERVALS} + 1)"))
    wide = held.groupBy("dim", "part").agg(*(F.min(f"lo{c}") for c in cells), *(F.max(f"hi{c}") for c in cells)).orderBy("dim", "part").collect()
    by_dim: dict[int, list] = {}
    for row in wide:
        by_dim.setdefault(row[0], []).append(row)
    pairs = [(dim, rows[a][1], rows[b][1]) for dim, rows in by_dim.items() for a, b in interval_pairs([(dim, *r[2:]) for r in rows])]
    near = spark.createDataFrame(pairs, "dim int, p long, q long")
    end = lambda name, part: held.select("dim", F.col("part").alias(part), F.col("block").alias(name), *(F.col(f"{s}{c}").alias(f"{name}_{s}{c}") for c in cells for s in ("lo", "hi")))
    apart = " + ".join(f"pow(greatest(0, greatest(j_lo{c} - i_hi{c}, i_lo{c} - j_hi{c}) - 1), 2)" for c in cells)
    return near.join(end("i", "p"), ["dim", "p"]).join(end("j", "q"), ["dim", "q"]).where(f"i <= j and {apart} <= {CELLS_PER_EPS**2}").select("dim", "i", "j")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, block_rows: int = BLOCK_ROWS, leaf_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, links being cosine >= threshold in double precision.

    Equal vectors collapse to one with a number of copies first, so a vector that a third of all rows share is one row.
    The others are sorted by length and by grid cells on the leading principal dimensions and cut into blocks of one
    length, of block_rows rows and BLOCK_BYTES bytes at most, whatever the table's size; pairs of blocks that aren't
    provably distant are joined by further recursion down to leaf_rows, with one matrix product at a leaf. A pair of
    blocks returns counts and a spanning forest, never all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    length don't link. Repeated rows, different vectors under one id and rows with a null id count as vectors of their
    own. A null id names no component: component_id is the least id reachable, null if there is none; kept is null for
    a null id. Further columns are ignored.
    """
    raw = settle(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).mapInArrow(_cleaned, "vec_id long, dim int, key binary, x binary"))
    reps = settle(raw.where("key is not null").groupBy("key", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x")))
    n, size = reps.agg(F.count(F.lit(1)), F.sum(F.length("x"))).first()
    eps = math.sqrt(max(2 - 2 * threshold, 1e-9)) + 1e-6
    bases = {}
    sample: dict[int, list[bytes]] = {}
    for row in reps.select("dim", "x").orderBy(F.xxhash64("key")).limit(FIT_ROWS).collect():
        sample.setdefault(row.dim, []).append(bytes(row.x))
    for dim, blobs in sample.items():
        u = _unit(stacked(blobs))
        _, axes = np.linalg.eigh(np.cov(u.T, bias=True).reshape(dim, dim))
        bases[dim] = axes[:, ::-1][:, :LEAD].copy()
    cells = [f"c{i}" for i in range(LEAD)]
    projected = reps.select("dim", "rep", "copies", "key", "x").mapInArrow(_projector(bases, eps / CELLS_PER_EPS), "dim int, rep long, copies long, key binary, x binary, " + ", ".join(f"{c} int" for c in cells))
    order = ["dim", *cells, "rep", "key"]
    ranged = projected.repartitionByRange(max(8, -(-(size or 0) // (1 << 27))), *order).sortWithinPartitions(*order)
    ego = settle(ranged.mapInArrow(_numbered, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in projected.schema) + ", part long, at long"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    offsets = ego.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    whole = ego.join(offsets, "part").withColumn("node", F.col("before") + F.col("at")).drop("part", "at", "before")
    rows_of = F.least(F.lit(block_rows), F.greatest(F.lit(256), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))), F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("n") / LEAST_BLOCKS)))
    lengths = whole.groupBy("dim").agg(F.min("node").alias("start"), F.count(F.lit(1)).alias("n")).withColumn("rows", rows_of).drop("n")
    placed = settle(whole.join(lengths, "dim").withColumn("block", F.expr("(node - start) div rows")).drop("start", "rows"))
    boxes = settle(placed.groupBy("dim", "block").agg(*(F.min(c).alias(f"lo{i}") for i, c in enumerate(cells)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(cells))))
    pairs = settle(near_pairs(boxes))
    members = pairs.select("dim", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    both = placed.drop("rep", "key").join(members, ["dim", "block"])
    linked = settle(both.groupBy("dim", "i", "j").applyInPandas(_joiner(threshold, leaf_rows), "node long, n long, root long"))
    numbers = linked.groupBy("node").agg(F.sum("n").alias("n"))
    # Nodes are places in the sequence: vectors that repeat an id stay apart. A component's id is its least vec_id.
    groups = settle(connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = settle(groups.join(placed.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")))
    told = join_spread(groups, named, "component").drop("component")
    known = placed.select("key", "node", "rep", "copies").join(numbers, "node", "left").join(told, "node", "left")
    known = settle(known.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "rep").alias("component")))
    drop_settled(reps, ego, placed, boxes, pairs, linked, groups)
    out = raw.select("vec_id", "key").join(known, "key", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same in SQL, by all pairs: for tables of some ten thousand vectors at most.
SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings),
good AS MATERIALIZED (
  SELECT * FROM v
  WHERE len(list_filter(x, lambda c: coalesce(isfinite(c), false))) = len(x) AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.k AS a, a.vec_id AS va, b.k AS b, b.vec_id AS vb
  FROM good a JOIN good b ON len(a.x) = len(b.x) AND a.k <> b.k
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reached AS (
  SELECT a AS node, va AS root FROM links WHERE va IS NOT NULL
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON r.node = l.a WHERE l.vb IS NULL OR r.root < l.vb),
least AS (SELECT node, min(root) AS root FROM reached GROUP BY node),
numbers AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, CAST(coalesce(root, v.vec_id) AS BIGINT) AS component_id, v.vec_id = coalesce(root, v.vec_id) AS kept
FROM v LEFT JOIN numbers ON numbers.a = v.k LEFT JOIN least ON least.node = v.k
"""
