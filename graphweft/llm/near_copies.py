"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what these connect."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import drop_settled, frequent, join_spread, settle, whole_runs
from graphweft.llm.components import connected_components

SHINGLE_WORDS, LEAST = 5, 0.8
#: A pair at 0.8 shares none of the bands with probability (1 - 0.8**4)**27, under one in a million.
BANDS, BAND_ROWS = 27, 4
#: Signatures hold a byte a MinHash value. A pair at 0.8 has fewer equal bytes with probability under one in ten million.
EQUAL_BYTES = 61
#: A bitmap of the texts whose shingles are asked for goes to the tasks: two to the so many bits, by the number of texts,
#: so that at most an eighth of the others pass it. For more texts than FILTER_TEXTS there is none: texts are joined.
LEAST_BITS, MOST_BITS = 20, 27
FILTER_TEXTS = 1 << 24
#: Texts that a task remembers to have made the shingle set of.
SEEN_TEXTS = 1 << 16
#: Texts of one band compared in one task: a larger band is dealt to blocks of about so many.
BLOCK_ROWS = 4096
#: Runs up to this long are compared together, place by place.
SHORT_RUN = 48
_ROWS = np.random.default_rng(42).integers(0, 2**32, (2, BANDS * BAND_ROWS), np.uint32)
_FACTORS, _TERMS = _ROWS[0] | np.uint32(1), _ROWS[1]
_PLACES = np.random.default_rng(44).integers(0, 2**63, SHINGLE_WORDS, np.uint64) | np.uint64(1)
_FOLD = np.random.default_rng(43).integers(0, 2**63, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, split at ASCII white space."""
    return (text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()).split()


def text_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words)) - 2**63


def all_grams(words: list[bytes]) -> np.ndarray:
    """The shingles' hashes, repeats included; fewer words than a shingle has are one shingle."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE_WORDS, len(words))
    out = np.zeros(len(words) - size + 1 if words else 0, np.uint64)
    for i in range(size):
        out += hashes[i : i + len(out)] * _PLACES[i]
    out ^= out >> np.uint64(32)
    out *= _PLACES[0]
    return out ^ (out >> np.uint64(29))


def grams(words: list[bytes]) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    return np.unique(all_grams(words))


def bands_of(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of MinHash values, of which no two bands share any, and the signature."""
    low = np.full(BANDS * BAND_ROWS, 2**32 - 1, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        low = np.minimum(low, (short[at : at + 256, None] * _FACTORS + _TERMS).min(axis=0))
    folded = ((low.reshape(BANDS, BAND_ROWS).astype(np.uint64) + np.uint64(1)) * _FOLD).sum(axis=1, dtype=np.uint64)
    return ((folded ^ (folded >> np.uint64(29))) & ~np.uint64(31) | np.arange(BANDS, dtype=np.uint64)).view(np.int64), ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def hashed(batches):
    """(doc_id, source, xh, text) as (doc_id, source, xh, text_hash, size in words, bands, signature)."""
    for batch in batches:
        grp, size, bands, marks = [], [], [], []
        for text in batch.column(3).cast(pa.large_binary()):
            words = words_of(text.as_py() or b"")
            band, mark = bands_of(all_grams(words)) if words else (np.zeros(0, np.int64), b"")
            grp.append(text_hash(words))
            size.append(len(words))
            bands.append(band)
            marks.append(mark)
        offsets = pa.array(np.cumsum([0, *map(len, bands)]).astype(np.int32))
        keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grp, pa.int64()), pa.array(size, pa.int64()), keys, pa.array(marks, pa.binary())], ["doc_id", "source", "xh", "text_hash", "size", "bands", "mark"])


def _packed_bits(batches):
    """(chunk, its 65536 bits) of rows (chunk, places in it)."""
    for batch in batches:
        blobs = []
        for places in batch.column(1):
            bits = np.zeros(1 << 16, np.uint8)
            bits[places.values.to_numpy()] = 1
            blobs.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["chunk", "bits"])


def _bitmap(asked: DataFrame, number: int) -> tuple[np.ndarray, int]:
    """(bits, how many as a power of two) of the number of texts asked for; the tasks make its chunks of 8 KB, 2048 at most."""
    power = min(MOST_BITS, max(LEAST_BITS, (8 * number).bit_length()))
    place = F.shiftrightunsigned("xh", 64 - power)
    chunks = asked.groupBy(F.shiftrightunsigned(place, 16).alias("chunk")).agg(F.collect_set(place.bitwiseAND(F.lit(65535)).cast("int")).alias("at"))
    out = np.zeros(1 << (power - 3), np.uint8)
    for chunk, bits in chunks.mapInArrow(_packed_bits, "chunk long, bits binary").collect():
        out[chunk << 13 : (chunk + 1) << 13] = np.frombuffer(bits, np.uint8)
    return out, power


def _gram_sets(asked: np.ndarray | None, power: int):
    """(xh, grams) of the texts that are in the bitmap, if there is one, and of few others; mostly each once a task."""

    def run(batches):
        seen = set()
        for batch in batches:
            xh = batch.column(0).to_numpy()
            rows = np.arange(len(xh))
            if asked is not None:
                place = xh.view(np.uint64) >> np.uint64(64 - power)
                rows = np.flatnonzero((asked[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
            ids, sets = [], []
            for row in rows.tolist():
                if int(xh[row]) not in seen:
                    if len(seen) >= SEEN_TEXTS:
                        seen.clear()
                    seen.add(int(xh[row]))
                    ids.append(int(xh[row]))
                    sets.append(grams(words_of(batch.column(1)[row].cast(pa.large_binary()).as_py() or b"")).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["xh", "grams"])

    return run


def _sets(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(grp, grams) of the texts (xh, text) that names (xh, grp: a written table) asks for. Texts move only if there are over FILTER_TEXTS names."""
    number = names.count()
    if number > FILTER_TEXTS:
        kinds = texts.join(names.select("xh").distinct(), "xh", "left_semi").mapInArrow(_gram_sets(None, 0), "xh long, grams binary")
    else:
        kinds = texts.mapInArrow(_gram_sets(*_bitmap(names, number)), "xh long, grams binary")
    return kinds.join(names, "xh").dropDuplicates(["grp"]).select("grp", "grams")


class _Rows:
    """A table of bucket rows (key, i, j, side, bands, mark, ...) in order, and the pairs in it that may be alike."""

    def __init__(self, table: pa.Table) -> None:
        whole = table.combine_chunks()
        self.table, self.n = whole, len(whole)
        self.keys, i, j, self.side = (whole[c].to_numpy() for c in ("key", "i", "j", "side"))
        new = (self.keys[1:] != self.keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        self.starts = np.flatnonzero(np.concatenate(([True], new)))
        self.sizes = np.diff(np.concatenate((self.starts, [self.n])))
        self.two = i != j  # the rows of two blocks, each of which is compared with itself elsewhere
        lists = whole["bands"].chunk(0)
        self.bands = lists.flatten().to_numpy().reshape(self.n, BANDS)
        self.marks = np.frombuffer(b"".join(whole["mark"].to_pylist()), np.uint8).reshape(self.n, -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, equal bytes) with enough of them, at the first band that two texts share: a pair is seen in one bucket."""
        found = [self._kept(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        run = np.repeat(np.arange(len(self.starts)), self.sizes)
        at = np.flatnonzero(self.sizes[run] <= SHORT_RUN)
        for step in range(1, SHORT_RUN):
            at = at[at + step < self.n]
            at = at[run[at] == run[at + step]]
            if not len(at):
                break
            for part in np.array_split(at, 1 + len(at) // (1 << 16)):
                found.append(self._kept(part, part + step, (self.marks[part] == self.marks[part + step]).sum(axis=1)))
        for start, size in zip(self.starts[self.sizes > SHORT_RUN].tolist(), self.sizes[self.sizes > SHORT_RUN].tolist(), strict=True):
            columns = np.ascontiguousarray(self.marks[start : start + size].T)
            for a in range(0, size, 512):
                equal = np.zeros((min(512, size - a), size - a), np.uint8)
                for column in columns:
                    equal += column[a : a + 512, None] == column[None, a:]
                x, y = np.nonzero(equal >= EQUAL_BYTES)
                ahead = x < y
                found.append(self._kept(x[ahead] + start + a, y[ahead] + start + a, equal[x[ahead], y[ahead]]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _kept(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = np.flatnonzero((equal >= EQUAL_BYTES) & (~self.two[a] | (self.side[a] != self.side[b])))
        a, b, equal = a[keep], b[keep], equal[keep].astype(np.int64)
        first = [(self.bands[p] == self.bands[q]).argmax(axis=1) == (self.keys[p] & 31) for p, q in zip(np.array_split(a, 1 + len(a) // (1 << 16)), np.array_split(b, 1 + len(a) // (1 << 16)), strict=True)]
        first = np.concatenate(first)
        return a[first], b[first], equal[first]


def _asked(batches):
    """Of a bucket's rows those that may be alike to another: named, not paired."""
    for table in whole_runs(batches, 3):
        rows = _Rows(table)
        a, b, _ = rows.pairs()
        keep = np.zeros(rows.n, bool)
        keep[a] = keep[b] = True
        yield from rows.table.filter(pa.array(keep)).to_batches()


def _linked(batches):
    """A spanning forest of the links inside each bucket, the likeliest pairs first: what is connected isn't compared again."""
    for table in whole_runs(batches, 3):
        rows = _Rows(table)
        a, b, equal = rows.pairs()
        order = np.argsort(-equal, kind="stable")
        grp, blobs, root, left, right = rows.table["grp"].to_numpy(), rows.table["grams"], list(range(rows.n)), [], []

        def find(x, root=root):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        sets: dict[int, np.ndarray] = {}
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            p, q = find(x), find(y)
            if p == q:
                continue
            for z in (x, y):
                if z not in sets:
                    sets[z] = np.frombuffer(blobs[z].as_py(), np.uint64)
            least, most = sorted((len(sets[x]), len(sets[y])))
            if 10 * least < 8 * most:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 10 * both >= 8 * (least + most - both):
                root[max(p, q)] = min(p, q)
                left.append(grp[x])
                right.append(grp[y])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _links(dealt: DataFrame, single: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) inside each block or pair of blocks. dealt: key, i, j, side, grp."""
    by_run = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    named, marked = "key long, i int, j int, side int, grp long", ", xh long, bands array<long>, mark binary"
    asked = settle(by_run(dealt.join(single, "grp").select("key", "i", "j", "side", "grp", "xh", "bands", "mark")).mapInArrow(_asked, named + marked))
    names = settle(asked.select("grp", "xh").distinct())
    links = settle(by_run(asked.drop("xh").join(_sets(texts, names), "grp").select("key", "i", "j", "side", "grp", "bands", "mark", "grams")).mapInArrow(_linked, "a long, b long"))
    drop_settled(asked, names)
    return links


def apart(full: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, i, j, side, grp) for what is still to be compared of bands of several blocks. full: key, grp; groups: node, component.

    Texts that are connected already need no comparison. So the texts outside a band's largest component, in blocks of
    their own, meet each other and the blocks of that component; its own blocks don't meet.
    """
    known = settle(full.join(groups.withColumnRenamed("node", "grp"), "grp", "left").select("key", "grp", F.coalesce("component", "grp").alias("c")))
    counts = known.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("most")).where("n > most")
    blocks = lambda rows: F.ceil(rows / BLOCK_ROWS).cast("int")
    main = settle(main.select("key", "main", "n", blocks(F.col("n") - F.col("most")).alias("few"), blocks(F.col("most")).alias("many")))
    met = join_spread(known, main, "key")
    place = lambda n: F.pmod(F.xxhash64("grp", F.lit(7)), F.col(n)).cast("int")
    outside = met.where("c <> main").select("key", "grp", place("few").alias("side"), F.explode(F.expr("sequence(0, few + many - 1)")).alias("other"))
    inside = met.where("c = main").select("key", "grp", (F.col("few") + place("many")).alias("side"), F.explode(F.expr("sequence(0, few - 1)")).alias("other"))
    rest = settle(outside.unionByName(inside).select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "grp"))
    drop_settled(known, main)
    return rest


def near_copy_groups(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(grp, cluster) of each text that has a near copy; cluster: the least grp connected.

    rows: (grp, xh, size, bands, mark), texts: (xh, text); xh names a text as written, grp its words.

    Texts that share a band and most of their signatures' bytes are candidates. First they are only named (a row a text
    and band, however many it is like), then their shingle sets come to the bands and a link counts by the exact
    similarity; a band gives a spanning forest, never its pairs. A pair is looked at in the first band it shares.

    A band of over BLOCK_ROWS different texts is dealt to blocks, which are compared inside first. What that leaves
    unconnected is then compared to the rest of the band: exact, linear in a large group of near copies, and quadratic
    only in the texts of one band that aren't connected to its largest group.
    """
    single = settle(rows.where("size > 0").groupBy("grp").agg(F.first(F.struct("xh", "bands", "mark")).alias("s")).select("grp", "s.*"))
    keyed = single.select("grp", F.explode("bands").alias("key"))
    hot = frequent(keyed, "key")
    seldom = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").repartition("key")
    sizes = seldom.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = seldom.join(sizes, "key").unionByName(keyed.join(F.broadcast(hot.where("n > 1")), "key"))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    dealt = settle(sized.select("key", "grp", (blocks > 1).alias("full"), F.pmod(F.xxhash64("grp", F.lit(7)), blocks).cast("int").alias("side")))
    links = [_links(dealt.select("key", F.col("side").alias("i"), F.col("side").alias("j"), "side", "grp"), single, texts)]
    full = dealt.where("full").select("key", "grp")
    if not full.isEmpty():
        rest = apart(full, connected_components(links[0]))
        links.append(_links(rest, single, texts))
        drop_settled(rest)
    groups = connected_components(reduce(DataFrame.unionAll, links)).select(F.col("node").alias("grp"), F.col("component").alias("cluster"))
    drop_settled(single, dealt, *links)
    return groups
