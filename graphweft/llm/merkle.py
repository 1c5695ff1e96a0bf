"""A Merkle manifest of a dataset: a tree of hashes a source, one over the sources, and a proof for every row."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import drop_settled, settle
from graphweft.operators.order import running

#: Nodes that become one.
ARITY = 16
#: Rows of one range, about: what a task holds at a time.
RANGE_ROWS = 1 << 16
#: Rows of a batch that a task returns.
BATCH_ROWS = 4096
#: One of so many rows, by a hash of its id, is tampered with to see that its proof fails.
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def node_hash(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered) of every row: hashes of its columns, tampered for one of TAMPERED rows, else null."""
    own = {c: F.col(c).cast("long").cast("string") for c in ("doc_id", "n_chars")} | {c: F.col(c).cast("string") for c in ("source", "lang", "text")}
    rows = docs.select(*(v.alias(c) for c, v in own.items()))
    head = F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")))
    chosen = F.crc32("doc_id") % TAMPERED == 0
    hashed = lambda text: F.sha2(F.concat(head, _field(text)), 256)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", hashed(F.col("text")).alias("leaf"), F.when(chosen, hashed(F.translate("text", _UPPER, _LOWER))).alias("tampered"))


def _levels(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _build(hashes: list[str], offset: int, total: int) -> list[tuple[int, list[str]]]:
    """For each level of a tree of total leaves (index of the first, hashes) of the nodes that these leaves, from number offset on, determine."""
    out = [(offset, hashes)]
    size = total
    for _ in range(_levels(total)):
        first, nodes = out[-1]
        size = -(-size // ARITY)
        begin = -(-first // ARITY)
        end = first + len(nodes)
        last = size if end == -(-total // ARITY ** (len(out) - 1)) else end // ARITY
        out.append((begin, [node_hash("".join(nodes[g * ARITY - first : min((g + 1) * ARITY, end) - first])) for g in range(begin, max(begin, last))]))
    return out


def _ragged(built: list[tuple[int, list[str]]]):
    """(level, index, hash) of the nodes whose parent isn't among those built; the top stands for the whole tree."""
    for level, (first, nodes) in enumerate(built):
        if level + 1 == len(built):
            parents = range(0)
        else:
            above, made = built[level + 1]
            parents = range(above, above + len(made))
        for i, node in enumerate(nodes):
            if (first + i) // ARITY not in parents:
                yield level, first + i, node


def _segments(batches, columns: list[str]):
    """Rows (part, source, kind, ...) in order, as segments: the rows of one source in one range, behind what is known of them."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[:2] != key:
                if held:
                    yield held
                held, key = [], row[:2]
            held.append(row)
    if held:
        yield held


def _batches(rows, **kinds: pa.DataType):
    """Rows as batches: segments may be many and short."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


def _boundary(batches):
    """Nodes (source, level, idx, hash, total) of each segment whose parents other ranges have a part in."""
    rows = (
        (segment[0][1], *node, segment[0][4])
        for segment in _segments(batches, ["part", "source", "kind", "first", "total", "leaf"])
        for node in _ragged(_build([r[5] for r in segment[1:]], *segment[0][3:5]))
    )
    return _batches(rows, source=pa.string(), level=pa.int32(), idx=pa.int64(), hash=pa.string(), total=pa.int64())


def _joined(groups: list[str], own: int, leaf: str) -> tuple[str, str]:
    """(siblings in a row, hash that leaf leads to) along groups of children, leaf being number own among the first."""
    siblings, node = [], leaf
    for children in groups:
        at = own % ARITY * 64
        siblings.append(children[:at] + children[at + 64 :])
        node = node_hash(children[:at] + node + children[at + 64 :])
        own //= ARITY
    return "".join(siblings), node


def _proven(batches):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of each leaf. A segment's first row has its place, subroot, root and what lies above its source; rows of kind 1 the groups above its borders."""
    text = pa.string()
    return _batches(_proofs(batches), doc_id=pa.int64(), leaf=text, subroot=text, root=text, proof_sha256=text, folded_root=text)


def _proofs(batches):
    names = ["part", "source", "kind", "first", "total", "leaf", "tampered", "doc_id", "level", "groups", "subroot", "root", "number", "above"]
    for segment in _segments(batches, names):
        _, _, _, first, total, *_ = segment[0]
        subroot, root, number, above = segment[0][10:]
        ends = {(r[8], r[3]): r[9] for r in segment if r[2] == 1}  # (level of the children, number of their parent) -> groups upwards
        rows = [r for r in segment if r[2] == 2]
        built = _build([r[5] for r in rows], first, total)
        ways: dict[int, list[str]] = {}
        for i, row in enumerate(rows):
            place = first + i
            if place // ARITY not in ways:
                groups, at, level = [], place, 0
                while level + 1 < len(built):
                    parent = at // ARITY
                    begin, made = built[level + 1]
                    if not begin <= parent < begin + len(made):
                        groups += ends[level, parent]
                        break
                    below, nodes = built[level]
                    groups.append("".join(nodes[max(parent * ARITY - below, 0) : (parent + 1) * ARITY - below]))
                    at, level = parent, level + 1
                ways = {place // ARITY: groups}
            siblings, node = _joined(ways[place // ARITY], place, row[6] or row[5])
            more, folded = _joined(above, number, node)
            yield row[7], row[5], subroot, root, node_hash(siblings + more), folded


def _finished(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(groups: source, level, parent, children; tops: source, hash) of trees some of whose nodes (source, level, idx, hash, total) are given.

    Level by level, what is there meets by the coordinate of its parent: at most ARITY rows a group.
    """
    nodes = settle(nodes)
    here, tops = nodes.where("level = 0"), nodes.where("level = 0 and total = 1").select("source", "hash")
    groups = nodes.selectExpr("source", "level", "idx parent", "hash children").where("false")
    for level in range(levels):
        met = here.where(F.col("total") > ARITY**level).groupBy("source", F.expr(f"idx div {ARITY}").alias("parent"), "total").agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("c"))
        held = settle(met.select("source", F.lit(level).alias("level"), "parent", F.concat_ws("", F.transform("c", lambda x: x["hash"])).alias("children"), "total"))
        groups = groups.unionByName(held.drop("total"))
        made = held.select("source", F.lit(level + 1).alias("level"), F.col("parent").alias("idx"), F.sha2("children", 256).alias("hash"), "total")
        here = made.unionByName(nodes.where(F.col("level") == level + 1))
        tops = tops.unionByName(here.where(F.col("total") <= ARITY ** (level + 1)).select("source", "hash"))
    return groups, tops


def _ways(groups: DataFrame, levels: int) -> DataFrame:
    """(source, level, parent, groups): the children of each group and of the groups above it, upwards. From the top down, a join a level."""
    out = groups.select("source", "level", "parent", F.array("children").alias("groups")).where("false")
    above = out
    for level in reversed(range(levels)):
        upper = above.select(F.col("source").alias("s"), F.col("parent").alias("p"), F.col("groups").alias("g"))
        met = groups.where(F.col("level") == level).join(upper, F.col("source").eqNullSafe(F.col("s")) & (F.expr(f"parent div {ARITY}") == F.col("p")), "left")
        above = settle(met.select("source", "level", "parent", F.concat(F.array("children"), F.coalesce("g", F.array().cast("array<string>"))).alias("groups")))
        out = out.unionByName(above)
    return out


def _borders(segments: DataFrame, levels: int) -> DataFrame:
    """(part, source, level, at): the parents, at each level, of the nodes at both ends of each segment."""
    ends = segments.select("part", "source", F.explode(F.array("first", F.expr("first + n - 1"))).alias("end"))
    parents = F.array(*(F.expr(f"`end` div {ARITY ** (level + 1)}L") for level in range(max(levels, 1))))
    return ends.select("part", "source", F.posexplode(parents).alias("level", "at")).distinct()


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs (doc_id, source, lang, n_chars, text).

    Leaves are hashed where texts are read; only ids, sources and hashes move. They are sorted by ranges of (source,
    doc_id); the numbers of each source's rows in each range give every range its places. A range builds the complete
    subtrees of its rows; nodes on its borders meet the others by the coordinates of their parents, level by level, until
    one is left. Then each border gets the groups above it, and every row its siblings up to the root over all sources.

    A null source is a source, before all others; rows with a null id come first in theirs and aren't tampered with; rows
    of one id are ordered by leaf, and repeated rows are leaves of their own; null columns count as '-', empty texts as
    '0:'; an empty table gives an empty table; further columns, whatever their names, are ignored. A proof has
    ARITY - 1 hashes a level, so what lies above a source is stored once for each of its ranges.
    """
    rows = settle(leaves(docs).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]
    ranged = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)).drop("row"))
    drop_settled(rows)
    counts = settle(ranged.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    segments = settle(counts.select("part", "source", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.sum("n").over(whole).alias("total"), F.min("part").over(whole).alias("begin")))
    most = segments.agg(F.max("total"), F.count_if(F.col("part") == F.col("begin"))).first()
    levels, upper = _levels(most[0] or 0), _levels(most[1] or 0)
    own = ranged.select("part", "source", F.lit(2).alias("kind"), "leaf", "tampered", "doc_id", "place")
    # A range's rows come to one task, in order, behind what else it needs.
    by_range = lambda df: df.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.asc_nulls_first("source"), "kind", "place")
    known = segments.select("part", "source", F.lit(0).alias("kind"), "first", "total")
    nodes = by_range(own.unionByName(known, allowMissingColumns=True)).mapInArrow(_boundary, "source string, level int, idx long, hash string, total long")
    groups, tops = _finished(nodes, levels)
    # The tree over the sources: their subroots in order are its leaves.
    subroots = settle(running(tops.select("source", F.col("hash").alias("subroot")), F.asc_nulls_first("source")).withColumnRenamed("before", "number"))
    over = subroots.select(F.lit("").alias("source"), F.lit(0).alias("level"), F.col("number").alias("idx"), F.col("subroot").alias("hash"), F.lit(most[1]).cast("long").alias("total"))
    groups_above, roots = _finished(over, upper)
    root = roots.first()
    above = _ways(groups_above, upper).where("level = 0").select("parent", F.col("groups").alias("above"))
    named = subroots.join(above, F.expr(f"number div {ARITY}") == F.col("parent"), "left")
    named = named.select(F.col("source").alias("s"), "subroot", F.lit(root and root["hash"]).cast("string").alias("root"), "number", F.coalesce("above", F.array().cast("array<string>")).alias("above"))
    told = known.join(settle(named), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ways = _ways(groups, levels).select(F.col("source").alias("s"), F.col("level").alias("l"), F.col("parent").alias("first"), "groups")
    met = F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")) & (F.col("at") == F.col("first"))
    needed = _borders(segments, levels).join(ways, met).select("part", "source", F.lit(1).alias("kind"), "first", "level", "groups")
    every = own.unionByName(told, allowMissingColumns=True).unionByName(needed, allowMissingColumns=True)
    out = by_range(every).mapInArrow(_proven, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a string of ASCII digits, a bit at a time.
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: list_transform(range(8), lambda i: ((unicode(c) >> i::INT) & 1)::BIGINT)))),"
    " lambda a, b: xor(a >> 1, 3988292384::BIGINT * (xor(a, b) & 1))))"
)
_TEXT = "coalesce(strlen({0}) || ':' || {0}, '-')"
SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, sha256(head || {_TEXT.format("text")}) AS leaf, CASE WHEN chosen THEN sha256(head || {_TEXT.format("small")}) ELSE sha256(head || {_TEXT.format("text")}) END AS start
  FROM (SELECT doc_id, source, text, translate(text, '{_UPPER}', '{_LOWER}') AS small, coalesce({_CRC.format("doc_id::BIGINT::VARCHAR")} % {TAMPERED} = 0, false) AS chosen,
    {" || ".join(_TEXT.format(c) for c in ("doc_id::BIGINT::VARCHAR", "source", "lang", "n_chars::BIGINT::VARCHAR"))} AS head FROM documents) d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size FROM hashed),
nodes AS (
  SELECT source, 0 AS level, idx, leaf AS hash, size FROM leaves
  UNION ALL SELECT source, level + 1, idx // {ARITY}, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(size) + {ARITY - 1}) // {ARITY} FROM nodes WHERE size > 1 GROUP BY source, level, idx // {ARITY}),
subroots AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS number, count(*) OVER () AS size FROM nodes WHERE size = 1),
upper AS (
  SELECT 0 AS level, number AS idx, subroot AS hash, size FROM subroots
  UNION ALL SELECT level + 1, idx // {ARITY}, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(size) + {ARITY - 1}) // {ARITY} FROM upper WHERE size > 1 GROUP BY level, idx // {ARITY}),
children AS (SELECT source, level, idx // {ARITY} AS parent, string_agg(hash, '' ORDER BY idx) AS hashes FROM nodes WHERE size > 1 GROUP BY ALL),
children_above AS (SELECT level, idx // {ARITY} AS parent, string_agg(hash, '' ORDER BY idx) AS hashes FROM upper WHERE size > 1 GROUP BY ALL),
steps AS (
  SELECT l.source, l.idx, level, hashes, l.idx // CAST(power({ARITY}, level) AS BIGINT) % {ARITY} AS own FROM leaves l JOIN children c ON c.source IS NOT DISTINCT FROM l.source AND c.parent = l.idx // CAST(power({ARITY}, level + 1) AS BIGINT)
  UNION ALL SELECT l.source, l.idx, 100 + level, hashes, number // CAST(power({ARITY}, level) AS BIGINT) % {ARITY} FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN children_above c ON c.parent = number // CAST(power({ARITY}, level + 1) AS BIGINT)),
sides AS (SELECT source, idx, level, left(hashes, CAST(own * 64 AS INT)) AS l, substr(hashes, CAST(own * 64 + 65 AS INT)) AS r FROM steps),
ways AS (SELECT source, idx, list(l || ',' || r ORDER BY level) AS way, string_agg(l || r, '' ORDER BY level) AS proof FROM sides GROUP BY ALL)
SELECT doc_id, leaf, subroot, (SELECT hash FROM upper WHERE size = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT hash FROM upper WHERE size = 1) AS verified
FROM (SELECT l.*, subroot, proof, list_reduce(list_prepend(start, coalesce(way, [])), lambda x, y: sha256(split_part(y, ',', 1) || x || split_part(y, ',', 2))) AS folded_root
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN ways w ON w.source IS NOT DISTINCT FROM l.source AND w.idx = l.idx) f"""
