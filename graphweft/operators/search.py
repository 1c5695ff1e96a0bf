"""Search over entries (kind, name, detail, path, line, key): prefilter, fuzzy score, groups in a total order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.text import fold_lower
from graphweft.model import ENTRY_KINDS, PATH_KINDS, rank
from graphweft.operators.order import running
from graphweft.storage import settle

#: Points of the fuzzy score.
MATCH, CONTIGUOUS, WORD_START, CAMEL_HUMP, BASENAME, PREFIX, EXACT = 16, 12, 20, 16, 6, 40, 100
GAP_OPEN, GAP_EXTEND, GAP_MAX, LATE_START, LATE_START_MAX, MAX_STARTS = -3, -1, -12, -1, -15, 6
WORD_BREAKS = "/_-.: "
MASK_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789_/.-:"
#: Words of 64 entries that an index's step makes at once, which bounds its memory.
WORDS = 32
#: How many of a group are shown.
CAPS, CAP, SCOPED_CAP = {"File": 8, "Folder": 8, "Symbol": 8}, 5, 50


def scope(raw: str) -> tuple[str, str]:
    """(scope, folded text): > asks for commands and tools, @ for symbols, anything else for all."""
    raw = raw.lstrip()
    mark = {">": "commands", "@": "symbols"}.get(raw[:1])
    text = (raw[1:] if mark else raw).strip()
    return mark or "all", "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def in_scope(kind: Column, which: str) -> Column:
    return {"commands": kind.isin("Command", "Tool"), "symbols": kind == "Symbol"}.get(which, F.lit(True))


def group_of(kind: Column) -> Column:
    """A kind's group, from 0; folders are among the files."""
    return F.greatest(F.lit(0), rank(kind, ENTRY_KINDS) - 1).cast("int")


def char_mask(lower: Column) -> Column:
    """One bit for each letter, digit and separator that a text has."""
    return reduce(Column.bitwiseOR, [F.shiftleft(lower.contains(c).cast("long"), i) for i, c in enumerate(MASK_CHARS)])


def mask_of(text: str) -> int:
    return sum(1 << i for i, c in enumerate(MASK_CHARS) if c in text)


def fuzzy(needle: str, candidate: str, lower: str) -> tuple[int, tuple[int, ...]] | None:
    """(score, positions) of needle as a subsequence of candidate, greedily from the best of up to six starts; None if it isn't one."""
    if not needle or len(lower) < len(needle):
        return None
    base = candidate.rfind("/") + 1

    def word(i: int) -> bool:
        return i == 0 or candidate[i - 1] in WORD_BREAKS

    def hump(i: int) -> bool:
        return i > 0 and candidate[i].isupper() and (candidate[i - 1].islower() or candidate[i - 1].isdigit())

    starts, in_base = [], False
    for i, c in enumerate(lower):
        if c == needle[0] and (not starts or word(i) or hump(i) or (i >= base and not in_base)):
            starts.append(i)
            in_base = in_base or i >= base
            if len(starts) == MAX_STARTS:
                break
    best = None
    for start in starts:
        at, places = start, [start]
        for c in needle[1:]:
            at = lower.find(c, at + 1)
            if at < 0:
                break
            places.append(at)
        if at < 0:
            break
        score = max(LATE_START * start, LATE_START_MAX)
        for n, i in enumerate(places):
            score += MATCH + (WORD_START if word(i) else CAMEL_HUMP if hump(i) else 0) + (BASENAME if i >= base else 0)
            if n:
                gap = i - places[n - 1]
                score += CONTIGUOUS if gap == 1 else max(GAP_OPEN + GAP_EXTEND * (gap - 2), GAP_MAX)
        if places[-1] - start == len(places) - 1:
            score += (PREFIX if start == base else 0) + (EXACT if len(places) == len(lower) else 0)
        if best is None or score > best[0]:
            best = (score, tuple(places))
    return best


def _fold(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def path_points(score: Column | int) -> Column | int:
    """What a path's score counts: three quarters, floored."""
    return F.floor(3 * score / 4) if isinstance(score, Column) else 3 * score // 4


def prepared(entries: DataFrame) -> DataFrame:
    """entries with their masks; to be written once and searched often."""
    folded = entries.withColumns({"_name": fold_lower(F.col("name")), "_path": fold_lower(F.coalesce("path", F.lit("")))})
    return folded.withColumns({"name_mask": char_mask(F.col("_name")), "path_mask": char_mask(F.col("_path"))}).drop("_name", "_path")


def _pair_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, pair, word, bits) of entries (id, name, path, folded): a pair is in a text if its first character stands before the second one's last."""
    chars = np.full(256, -1, np.int64)
    chars[np.frombuffer(MASK_CHARS.encode(), np.uint8)] = np.arange(len(MASK_CHARS))
    n = len(MASK_CHARS)
    pairs = pa.array([a + b for a in MASK_CHARS for b in MASK_CHARS])
    for batch in batches:
        ids = batch.column("id").to_numpy()
        words, order = ids >> 6, np.argsort(ids)
        for field, name in enumerate(("name", "path")):
            texts = batch.column(name).cast(pa.large_binary())
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            codes = chars[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
            cells, places = np.repeat(np.arange(len(ids)), np.diff(at))[codes >= 0] * n + codes[codes >= 0], np.flatnonzero(codes >= 0)
            first, last = np.full(len(ids) * n, len(codes)), np.full(len(ids) * n, -1)
            first[cells[::-1]], last[cells] = places[::-1], places
            first, last = first.reshape(-1, n), last.reshape(-1, n)
            own = np.unique(words)
            for some in (own[i : i + WORDS] for i in range(0, len(own), WORDS)):
                rows = order[np.searchsorted(words, some[0], "left", order) : np.searchsorted(words, some[-1], "right", order)]
                held = np.zeros((len(some), 64, n * n), bool)
                held[np.searchsorted(some, words[rows]), ids[rows] & 63] = (first[rows, :, None] < last[rows, None, :]).reshape(-1, n * n)
                bits = np.packbits(np.ascontiguousarray(held.swapaxes(1, 2)), axis=2, bitorder="little").view("<i8")[..., 0]
                pair, word = np.nonzero(bits.T)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), field, np.int32)), pairs.take(pa.array(pair)), pa.array(some[word]), pa.array(bits[word, pair])], ["field", "pair", "word", "bits"])


def pair_index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prepared entries with id; index: field, pair, word, bits), both written: for each ordered pair of characters, bitmaps of the entries that have it.

    A bitmap's word holds 64 entries by their numbers; names and paths are fields of their own. Entries lie in files by
    their numbers, so a word is made where they are read, without a shuffle; one whose entries are read by two tasks has
    a row of each. To be made once and searched often (see candidates).
    """
    held = settle(running(prepared(entries), "kind", "name", "key").withColumnRenamed("before", "id"))
    text = lambda c: fold_lower(F.coalesce(c, F.lit("")))
    texts = held.select("id", text("name").alias("name"), F.when(F.col("kind").isin(*PATH_KINDS), text("path")).otherwise("").alias("path"))
    return held, settle(texts.mapInArrow(_pair_words, "field int, pair string, word long, bits long"))


def candidates(entries: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """The entries (of pair_index) that have all of the query's neighbouring characters in order, in the name or in the path.

    Only the index's rows of these pairs are read, and words are intersected before any entry is. A query without two
    neighbours of MASK_CHARS has no pair: the masks filter alone then, as in matches.
    """
    needle = "".join(scope(query)[1].split())
    asked = sorted({a + b for a, b in zip(needle, needle[1:], strict=False) if a in MASK_CHARS and b in MASK_CHARS})
    if not asked:
        return entries
    rows = index.where(F.col("pair").isin(*asked)).groupBy("field", "word", "pair").agg(F.bit_or("bits").alias("bits"))
    met = rows.groupBy("field", "word").agg(F.count(F.lit(1)).alias("n"), F.bit_and("bits").alias("bits")).where((F.col("n") == len(asked)) & (F.col("bits") != 0))
    words = met.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ids = words.select(F.explode(F.expr("filter(transform(sequence(0, 63), i -> if((shiftright(bits, i) & 1) = 1, word * 64 + i, null)), x -> x is not null)")).alias("id"))
    return entries.join(ids, "id", "left_semi")


def matches(entries: DataFrame, query: str) -> DataFrame:
    """Entries that match, with score, positions and whether the path matched.

    The scope and the masks filter in the JVM; what is left is scored in Arrow batches. A path's score counts three
    quarters, floored, and 50 more if it is the query; it wins only if it is greater than the name's.
    """
    which, text = scope(query)
    needle = "".join(text.split())
    bits = mask_of(needle)
    wide = entries.where(in_scope(F.col("kind"), which)) if needle else entries.where("false")
    paths = F.col("kind").isin(*PATH_KINDS)
    wide = wide.where((F.col("name_mask").bitwiseAND(F.lit(bits)) == bits) | (paths & (F.col("path_mask").bitwiseAND(F.lit(bits)) == bits)))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for kind, name, path in zip(pdf["kind"], pdf["name"], pdf["path"], strict=True):
                own = fuzzy(needle, name, _fold(name))
                best = None if own is None else [own[0], list(own[1]), False]
                if kind in PATH_KINDS and path:
                    folded = _fold(path)
                    far, whole = fuzzy(needle, path, folded), folded == needle
                    if far is not None:
                        points = path_points(far[0]) + (50 if whole else 0)
                        if best is None or points > best[0]:
                            best = [points, list(far[1]), True]
                        elif whole:
                            best[0] += 50
                out.append(best or [None, None, None])
            scored = pdf.assign(score=[x[0] for x in out], positions=[x[1] for x in out], in_path=[x[2] for x in out])
            kept = scored[scored["score"].notna()]
            yield kept.assign(score=kept["score"].astype("int32"), in_path=kept["in_path"].astype(bool))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema)
    return wide.mapInPandas(score, f"{schema}, score int, positions array<int>, in_path boolean")


def ordered(group: list[str]) -> Window:
    """The total order inside a group: best score, then kind, name, path (none first), line, key and detail by bytes."""
    return Window.partitionBy(*group).orderBy(F.desc("score"), rank("kind", ENTRY_KINDS), "name", F.asc_nulls_first("path"), F.asc_nulls_first("line"), "key", "detail")


def caps(scoped: bool) -> Column:
    if scoped:
        return F.lit(SCOPED_CAP)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CAPS.items() for x in p]), F.col("kind")), F.lit(CAP))


def search_indexed(entries: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """search() over a pair_index: only entries that the index leaves are scored."""
    return search(candidates(entries, index, query).drop("id"), query)


def search(entries: DataFrame, query: str) -> DataFrame:
    """The shown hits of each group: grp, pos, total, and the entry. Totals count all matches, whatever the caps.

    Ranks are cut per group before they are shuffled; totals are a separate count of partial sums.
    """
    found = matches(entries, query).withColumn("grp", group_of(F.col("kind")))
    totals = found.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    ranked = found.withColumn("pos", F.row_number().over(ordered(["grp"]))).where(F.col("pos") <= SCOPED_CAP)
    shown = ranked.where(F.col("pos") <= caps(scope(query)[0] != "all"))
    return shown.join(totals, "grp").select("grp", "pos", "total", "kind", "name", "path", "line", "key", "score", "in_path", "positions")


def file_entries(files: DataFrame) -> DataFrame:
    """Search entries of files (path)."""
    from graphweft.functions.paths import name

    return files.select(F.lit("File").alias("kind"), name(F.col("path")).alias("name"), F.col("path").alias("detail"), "path", F.lit(None).cast("int").alias("line"), F.xxhash64("path").alias("key"))


def folder_entries(files: DataFrame) -> DataFrame:
    """Search entries of all folders above files (path)."""
    from graphweft.functions.paths import ancestors, name

    folders = files.select(F.explode(ancestors(F.col("path"), top=False)).alias("path")).distinct()
    return folders.select(F.lit("Folder").alias("kind"), name(F.col("path")).alias("name"), F.col("path").alias("detail"), "path", F.lit(None).cast("int").alias("line"), F.xxhash64("path").alias("key"))


def symbol_entries(members: DataFrame) -> DataFrame:
    """Search entries of members (path, name, kind, line, idx): link rows, code blocks and blanks aren't symbols. The key is the path's hash over the index."""
    named = members.where("kind not in ('link', 'block') and trim(name) <> ''")
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64("path"), 32), 32).bitwiseOR(F.col("idx").cast("long"))
    return named.select(F.lit("Symbol").alias("kind"), "name", F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("detail"), "path", F.col("line").cast("int").alias("line"), key.alias("key"))


def other_entries(rows: DataFrame, kind: str, name: Column, detail: Column, key: Column, path: Column | None = None) -> DataFrame:
    """Search entries of commands, tools, settings, routes, flows, branches, worktrees, tickets or sessions."""
    return rows.select(F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"), (F.lit(None).cast("string") if path is None else path).alias("path"), F.lit(None).cast("int").alias("line"), key.cast("long").alias("key"))


def segments(*parts: DataFrame) -> DataFrame:
    """One table of all segments; a search spans them all."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
