"""SimHash near-duplicates found by Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import drop_settled, frequent, join_spread, settle, whole_runs
from graphweft.llm.components import connected_components
from graphweft.llm.near_copies import apart

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Bits of the three segments. Of three segments with 4 errors together, two have 2 errors at most each.
SEGMENTS = (22, 21, 21)
#: Larger buckets are compared in parts first; what that doesn't connect gets longer keys (see fingerprint_links).
BUCKET_ROWS = 2048
#: Links that a task holds before it reduces them to a forest.
HELD_LINKS = 1 << 20
#: The most fingerprints that are kept out of a join by broadcast; beyond it the join moves texts.
BROADCAST_ROWS = 1 << 19


def fingerprint(text: bytes) -> int:
    """64 bits of a text: bit set where over half of the shingles' XXH64 have it set. No words: 0."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters only
    if not words:
        return 0
    if len(words) <= SHINGLE_WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - SHINGLE_WORDS + 1].tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE_WORDS + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        fps = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def _kept_fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        fps = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(fps.view(np.int64))], ["_own_id", "_own_hash", "fp"])


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The perfect [23,12,7] code by its generator polynomial: syndrome -> error; syndrome -> offsets of keys; their number.

    A word 3 bits from its codeword also has the five codewords 4 bits away; any other word has none. Two words that
    differ in 2 bits or fewer have a codeword of these in common.
    """
    poly = 0b101011100011
    rest = lambda w: _mod(np.asarray(w, np.int64), poly)
    info = np.arange(4096, dtype=np.int64) << 11
    code = info | rest(info)
    heptads = code[np.bitwise_count(code) == 7]
    error, offsets, number = np.zeros(2048, np.int64), np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(rest([e])[0])
            error[s] = e
            if weight == 3:
                offsets[s, 1:] = heptads[(heptads & e) == e] >> 11
                number[s] = 6
    return error, offsets, number


def _mod(words: np.ndarray, poly: int) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where((words >> bit) & 1, poly << (bit - 11), 0)
    return words


def golay_keys(words: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (n x 6) of 23-bit words, and which of them hold."""
    error, offsets, number = tables
    syndrome = _mod(words, 0b101011100011)
    nearest = (words ^ error[syndrome]) >> 11
    return nearest[:, None] ^ offsets[syndrome], np.arange(6)[None, :] < number[syndrome][:, None]


def bucket_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): each key holds two segments' codeword indices."""
    shift, found = 0, []
    for bits in SEGMENTS:
        found.append(golay_keys(((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64), tables))
        shift += bits
    rows, keys = [], []
    for p, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (ki, oi), (kj, oj) = found[i], found[j]
        both = oi[:, :, None] & oj[:, None, :]
        key = (p << 24) | (ki[:, :, None] << 12) | kj[:, None, :]
        rows.append(np.nonzero(both)[0])
        keys.append(key[both])
    return np.concatenate(rows), np.concatenate(keys)


def finer_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys of all three segments for members of hot buckets, 182 a fingerprint on average.

    Of 4 errors either no segment has over 2, and the three share a codeword index each; or one has 3 or 4 and the other
    two 1 at most together: one of them is equal and the other shares an index.
    """
    shift, words, found = 0, [], []
    for bits in SEGMENTS:
        words.append(((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        found.append(golay_keys(words[-1], tables))
        shift += bits
    (k0, o0), (k1, o1), (k2, o2) = found
    every = o0[:, :, None, None] & o1[:, None, :, None] & o2[:, None, None, :]
    key = (k0[:, :, None, None] << 24) | (k1[:, None, :, None] << 12) | k2[:, None, None, :]
    rows, keys = [np.nonzero(every)[0]], [key[every]]
    for p, (same, near) in enumerate(permutations(range(len(SEGMENTS)), 2), 1):
        k, holds = found[near]
        rows.append(np.nonzero(holds)[0])
        keys.append(((p << 36) | (words[same][:, None] << 12) | k)[holds])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(keys_of):
    """(key, fp, c) of fingerprints (fp, c), a row a key."""

    def run(batches):
        tables = golay_tables()
        for batch in batches:
            fps, groups = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, keys = keys_of(part, tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64)), pa.array(groups[at : at + 4096][rows])], ["key", "fp", "c"])

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable of each of n positions."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links inside runs of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    left, right = [], []
    near = np.repeat(sizes <= 64, sizes)
    at = np.flatnonzero(near)
    for step in range(1, 64):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        close = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= MAX_BITS]
        left.append(close)
        right.append(close + step)
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        own, a, b = fps[start : start + size], [], []
        for i in range(0, size, 256):
            x, y = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None, :]) <= MAX_BITS)
            a.append(x + i)
            b.append(y)
        label = _labels(size, np.concatenate(a), np.concatenate(b))
        left.append(np.arange(start, start + size))
        right.append(label + start)
    if not left:
        return fps[:0], fps[:0]
    label = _labels(len(keys), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return fps[moved], fps[label[moved]]


def _runs(batches, limit):
    """(key, fp, c) arrays in key order, cut so that no run is divided; a run beyond limit comes in pieces, marked."""
    held, hot = None, None
    for batch in batches:
        own = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
        if not len(own[0]):
            continue
        if hot is not None:
            n = int(np.searchsorted(own[0], hot, "right"))
            for at in range(0, n, limit):
                yield [x[at : min(at + limit, n)] for x in own], True
            own = [x[n:] for x in own]
            if not len(own[0]):
                continue
            hot = None
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own, strict=True)]
        last = int(np.searchsorted(own[0], own[0][-1], "left"))
        if last:
            yield [x[:last] for x in own], False
        held = [x[last:] for x in own]
        if len(held[0]) > limit:
            for at in range(0, len(held[0]), limit):
                yield [x[at : at + limit] for x in held], True
            hot, held = int(held[0][0]), None
    if held is not None:
        yield held, False


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of each node to the least place of what it is connected with: what several buckets say counts once."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = _labels(len(nodes), places[: len(a)], places[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


class _Links:
    """Links of a task, reduced to a forest now and then."""

    def __init__(self) -> None:
        self.a, self.b, self.size = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray):
        self.a.append(a)
        self.b.append(b)
        self.size += len(a)
        if self.size > HELD_LINKS:
            a, b = _forest(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.size = [a], [b], len(a)
            if self.size > HELD_LINKS // 2:
                yield from self.rest()

    def rest(self):
        if self.a:
            a, b = _forest(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])


def _verified(limit: int):
    """Links (a, b) inside buckets, and inside the pieces of larger ones; members of these come with a null b and their key, too."""

    def run(batches):
        links = _Links()
        for (keys, fps, groups), hot in _runs(batches, limit):
            full = np.ones(len(keys), bool)
            if not hot:
                sizes = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)])))
                full = np.repeat(sizes > limit, sizes)
            if full.any():
                yield pa.RecordBatch.from_arrays([pa.array(fps[full].view(np.int64)), pa.nulls(int(full.sum()), pa.int64()), pa.array(keys[full])], ["a", "b", "key"])
            left, right = _linked(keys, fps)
            if (groups != 0).any():  # what is in one component already needs no link
                of = dict(zip(fps.tolist(), groups.tolist(), strict=True))
                new = np.array([of[x] == 0 or of[x] != of[y] for x, y in zip(left.tolist(), right.tolist(), strict=True)], bool)
                left, right = left[new], right[new]
            yield from links.add(left, right)
        yield from links.rest()

    return run


def _crossed(batches):
    """Links inside each block, or between the two blocks of each pair, of rows (key, i, j, side, fp) in order."""
    links = _Links()
    for table in whole_runs(batches, 3):
        key, i, j, side, fps = (table[c].to_numpy() for c in ("key", "i", "j", "side", "grp"))
        fps = fps.view(np.uint64)
        new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(key)]))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own, of = fps[start:end], side[start:end]
            left, right = (own, own) if i[start] == j[start] else (own[of == i[start]], own[of == j[start]])
            for at in range(0, len(left), 256):
                x, y = np.nonzero(np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= MAX_BITS)
                differ = left[at + x] != right[y]
                yield from links.add(*_forest(left[at + x[differ]], right[y[differ]]))
    yield from links.rest()


def _bucketed(fps: DataFrame, keys_of) -> DataFrame:
    """Links and members of full buckets (see _verified) of fingerprints (fp, c).

    A key that is frequent is dealt to tasks by a hash of its fingerprints; each compares its part in pieces.
    """
    keyed = settle(fps.select("fp", "c").mapInArrow(_keyed(keys_of), "key long, fp long, c long"))
    hot = frequent(keyed, "key")
    part = F.when(F.col("n") > BUCKET_ROWS, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BUCKET_ROWS))).otherwise(0)
    dealt = keyed.join(F.broadcast(hot.where(F.col("n") > BUCKET_ROWS)), "key", "left").select("key", "fp", "c", F.coalesce(part, F.lit(0)).alias("part"))
    named = hot.where(F.col("n") > BUCKET_ROWS)
    by_key = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp").select("key", "fp", "c")
    found = settle(by_key.mapInArrow(_verified(BUCKET_ROWS), "a long, b long, key long"))
    if not named.isEmpty():  # parts of a divided bucket may be under the limit on their own
        more = keyed.join(F.broadcast(named.select("key")), "key").select(F.col("fp").alias("a"), F.lit(None).cast("long").alias("b"), "key")
        found = settle(found.unionByName(more))
    drop_settled(keyed)
    return found


def _full(found: DataFrame) -> DataFrame:
    """(key, fp) of the members of full buckets."""
    return settle(found.where("b is null").select("key", F.col("a").alias("fp")).distinct())


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints fps (fp long) that differ in MAX_BITS bits or fewer.

    Keys of two Golay-decoded segments each put candidates into buckets (85 keys a fingerprint); a bucket gives a
    spanning forest of its verified links, never all pairs, and a task a forest of what its buckets give. A bucket of
    over BUCKET_ROWS is compared in pieces of that size. Thousands of fingerprints close to each other are connected by
    that; only if a full bucket's members are in different components then, they get keys of all three segments (182 of 33
    bits and more, so that full buckets stay the exception at any number of fingerprints), and links are looked for
    between components. What of a full bucket of these is outside its largest component is compared with the rest of it,
    block by block (see near_copies.apart): exact, and quadratic only in those.
    """
    found = _bucketed(fps.select("fp", F.lit(0).cast("long").alias("c")), bucket_keys)
    links = found.where("b is not null").select("a", "b")
    for keys_of in (finer_keys, None):
        full = _full(found)
        if full.isEmpty():
            return links
        groups = settle(connected_components(links))
        named = settle(full.join(groups.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left").select("key", "fp", F.coalesce("c", "fp").alias("c")))
        several = named.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
        left = settle(named.join(several, "key", "left_semi"))
        drop_settled(full, named)
        if left.isEmpty():
            return links
        if keys_of is None:
            rest = settle(apart(left.select("key", F.col("fp").alias("grp")), groups))
            met = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_crossed, "a long, b long, key long")
            return links.unionAll(settle(met).select("a", "b"))
        found = _bucketed(left.select("fp", "c").distinct(), keys_of)
        links = links.unionAll(found.where("b is not null").select("a", "b"))
        drop_settled(left, groups)
    return links


def _components(fps: DataFrame) -> DataFrame:
    """(fp, component) of the distinct fingerprints in fps that are linked to another."""
    return connected_components(fingerprint_links(fps)).select(F.col("node").alias("fp"), "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows come back repeatedly; a null id
    comes back null and never names a component (null if a component has no other id). Further columns are ignored.
    """
    fps = settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"))
    first = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    linked = settle(first.join(_components(first.select("fp")), "fp").select("fp", "first_id", "component"))
    least = settle(linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = settle(join_spread(linked, least, "component").select("fp", "component_id"))
    ids = settle(first.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")))
    return join_spread(fps, ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id. Rows with a null id all stay.

    Documents are rows, not ids: rows that share an id but have texts that are no copies of each other all stay. Of
    rows of one group with the smallest id the one with the least hash of its columns stays, equal rows once. Decisions
    are made on ids and hashes; texts are only filtered, by a broadcast of the rows to leave out where these are
    BROADCAST_ROWS at most, else by a join.
    """
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    own = docs.withColumn("_own_id", F.col(id_col).cast("long")).withColumn("_own_hash", F.xxhash64(*hashable))
    fps = settle(own.where("_own_id is not null").select(F.struct("_own_id", "_own_hash").alias("own"), F.col(text_col).cast("string").alias("text")).mapInArrow(_kept_fingerprints, "_own_id long, _own_hash long, fp long"))
    distinct = settle(fps.groupBy("fp").agg(F.min(F.struct("_own_id", "_own_hash")).alias("own")))
    groups = _components(distinct.select("fp"))
    stay = distinct.join(groups, "fp", "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("own").alias("own")).select("own.*")
    rows = fps.groupBy("_own_id", "_own_hash").agg(F.count(F.lit(1)).alias("n"))
    judged = rows.join(stay.withColumn("stays", F.lit(True)), ["_own_id", "_own_hash"], "left")
    odd = settle(judged.where("stays is null or n > 1").select(F.col("_own_id").alias("_odd_id"), F.col("_own_hash").alias("_odd_hash"), F.col("stays").isNotNull().alias("_odd_stays")))
    drop_settled(fps, distinct)
    told = F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd
    met = own.join(told, (F.col("_own_id") == F.col("_odd_id")) & (F.col("_own_hash") == F.col("_odd_hash")), "left")
    once = met.where("_odd_stays").dropDuplicates(["_own_id", "_own_hash"]).select(*docs.columns) if not odd.where("_odd_stays").isEmpty() else None
    left = met.where("_odd_id is null").select(*docs.columns)
    return left if once is None else left.unionByName(once)
