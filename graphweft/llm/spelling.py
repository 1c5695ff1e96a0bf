"""Spelling variants of frequent words, found by Aho-Corasick automata of the words' halves."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import drop_settled, join_spread, settle

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form occurs so many times as often as the word.
RATIO = 10
#: One of so many runs, by a hash, loses a code point.
DROPPED = 31
#: Words that one automaton holds, about.
SHARD_WORDS = 1 << 15
#: A segment of more words than this is looked for together with more of the word (see near_words).
SEGMENT_WORDS = 512
#: And one that more words than this are to be looked up for.
SEGMENT_ROWS = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters as the texts spell them, counted; without the short and the single ones."""
    run = F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = rows.select("doc_id", run.alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run")).alias("h"), F.length("run").alias("length"))
    short = F.concat(F.expr("substring(run, 1, cast(h % length as int))"), F.expr("substring(run, cast(h % length as int) + 2)"))
    spelled = hashed.select(F.when(F.col("h") % DROPPED == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return spelled.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _halves(length: str) -> str:
    """The two patterns of a word of that length, as SQL: p code points at its beginning and q at its end are intact."""
    return f"array(struct({length} div 2 as p, 0L as q), struct(0L as p, {length} - {length} div 2 as q))"


def _finer(length: str, of: str) -> str:
    """The two patterns into which one is divided: what lies between is halved."""
    middle = f"({length} - {of}.p - {of}.q)"
    return f"array(struct({of}.p + {middle} div 2 as p, {of}.q as q), struct({of}.p as p, {of}.q + {middle} - {middle} div 2 as q))"


def _patterns(length: str, level: int) -> str:
    return _halves(length) if level == 0 else f"flatten(transform({_patterns(length, level - 1)}, x{level} -> {_finer(length, f'x{level}')}))"


def _key() -> Column:
    """The intact parts of word by (p, q), as one number. Different parts with one number only share an automaton."""
    return F.xxhash64("p", "q", F.expr("substring(word, 1, cast(p as int))"), F.expr("if(q = 0, '', right(word, cast(q as int)))"))


def _lengths() -> str:
    return f"filter(array(length - 1, length, length + 1), l -> l >= {LEAST_LENGTH})"


def _routes(known: DataFrame) -> DataFrame:
    """(word, n, length, p, q, key, held): the patterns that each word holds, and those of the words that it may be near to."""
    sized = known.select("word", "n", F.length("word").cast("long").alias("length"))
    held = sized.select("*", F.inline(F.expr(_halves("length"))), F.lit(True).alias("held"))
    asks = sized.select("*", F.inline(F.expr(f"array_distinct(flatten(transform({_lengths()}, l -> {_halves('l')})))")), F.lit(False).alias("held"))
    return held.unionByName(asks).withColumn("key", _key())


def _refined(rows: DataFrame, level: int) -> DataFrame:
    """Rows of patterns of that level, with the two finer ones of each in its place."""
    own = F.expr(_finer("length", "struct(p, q)"))
    others = F.expr(f"array_distinct(flatten(transform(filter({_lengths()}, l -> array_contains({_patterns('l', level)}, struct(p, q))), l -> {_finer('l', 'struct(p, q)')})))")
    finer = rows.select("word", "n", "length", "held", F.when(F.col("held"), own).otherwise(others).alias("finer"))
    # A pattern that can't be divided comes back as itself beside one that nothing between is left of.
    return finer.select("word", "n", "length", "held", F.inline("finer")).where("not held or p + q < length").withColumn("key", _key())


class Shard:
    """An automaton of segments, and the words that hold each, by length, pattern and the quarters of what the segment leaves open."""

    def __init__(self) -> None:
        self.segments: dict[str, tuple[int, dict, dict]] = {}
        self.automaton = None

    def hold(self, word: str, n: int, p: int, q: int) -> None:
        """word is looked for where its first p and last q code points are intact; the longer of the two is its segment."""
        length, half = len(word), (len(word) - p - q) // 2
        segment = word[:p] if p >= q else word[length - q :]
        _, heads, tails = self.segments.setdefault(segment, (len(segment), {}, {}))
        begins, ends = (heads if p >= q else tails).setdefault((length, p, q), ({}, {}))
        begins.setdefault(word[p : p + half], []).append((word, n))
        ends.setdefault(word[p + half : length - q], []).append((word, n))

    def near(self, word: str):
        """(word, n) of the held words at distance 1, each at the one of its patterns between whose parts the difference lies."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for segment, held in self.segments.items():
                self.automaton.add_word(segment, held)
            self.automaton.make_automaton()
        if not self.segments:
            return
        size = len(word)
        for end, (width, heads, tails) in self.automaton.iter(word):
            for fits, groups in ((end + 1 == width, heads), (end + 1 == size, tails)):
                if not fits:
                    continue
                for (length, p, q), (begins, ends) in groups.items():
                    if abs(length - size) > 1:
                        continue
                    middle = p + (length - p - q) // 2
                    # Either the first half of what is open is intact as well, and the difference behind it, or the second.
                    for found, least, most in ((begins.get(word[p:middle]), middle, length - q), (ends.get(word[size - length + middle : size - q]), p, middle)):
                        for held, n in found or ():
                            place = difference(held, word)
                            if place is not None and least <= place < most:
                                yield held, n


def difference(a: str, b: str) -> int | None:
    """The place in a at which one code point inserted, deleted or replaced makes b of it; None where none does."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return None
    at, most = 0, min(len(a), len(b))
    while at < most and a[at] == b[at]:
        at += 1
    rest = a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]
    return min(at, len(a) - 1) if rest else None


def _scanned(batches):
    """Words that are held, then words to scan, each in order; a row for each scanned word that has near words here."""
    shard, last = Shard(), None
    for batch in batches:
        out = []
        for held, word, n, p, q in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held:
                shard.hold(word, n, p, q)
            elif word != last:
                last = word
                found = list(shard.near(word))
                if found:
                    most = max(n for _, n in found)
                    out.append((word, len(found), most, min(w for w, n in found if n == most)))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])


def near_words(known: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n: a written table) near to another; some rows a word, from several shards.

    One edit leaves a word's first half at the beginning or its second half at the end of the other word. Each word holds
    its halves in the automata of two shards and is scanned in those of at most four, by a hash of the halves that words
    of compatible length would have; a match counts if its offset and length fit and the distance is one. The difference
    lies between the parts of exactly one pattern of a word, so no pair is found twice.

    A segment of over SEGMENT_WORDS words, or for which over SEGMENT_ROWS ask, is looked for with a quarter more of the
    word at its beginning or its end, and so on: in the end only one code point is left open, so that a pattern has few
    words, however many share a half.
    """
    rows, level, parts = settle(_routes(known)), 0, []
    while True:
        sizes = settle(rows.groupBy("key").agg(F.count_if("held").alias("words"), F.count_if(F.col("held") & (F.col("length") - F.col("p") - F.col("q") > 1)).alias("open"), F.count(F.lit(1)).alias("n_rows")))
        full = ((F.col("words") > SEGMENT_WORDS) | (F.col("n_rows") > SEGMENT_ROWS)) & (F.col("open") > 0)
        if sizes.where(full).isEmpty():
            parts.append(rows)
            break
        marked = settle(join_spread(rows, sizes.select("key", full.alias("full"), "n_rows"), "key", "n_rows"))
        drop_settled(rows, sizes)
        parts.append(marked.where("not full").drop("full"))
        rows, level = settle(_refined(marked.where("full"), level)), level + 1
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    spark = known.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // SHARD_WORDS))
    dealt = every.select(F.col("held"), "word", "n", "p", "q", "key").repartition(shards, "key").sortWithinPartitions(F.desc("held"), "word")
    return dealt.mapInArrow(_scanned, "word string, n_near long, best_n long, best string")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts, and the more frequent spelling that each may stand for.

    A word's form is the most frequent word at distance 1, the least of equals, if it occurs RATIO times as often; root is
    where forms lead to. Forms grow by RATIO, so a way has some twenty at most, and doubling finds its end in five rounds.
    A word has no more near words than code points to edit with, so no word is a hot key.

    Null and empty texts have no words; a null id counts as an empty string before the colon; repeated rows count again;
    a text of one run is one word; without words the result is empty; further columns, whatever their names, are ignored.
    """
    known = settle(words(docs, id_col, text_col))
    found = near_words(known)
    every = known.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = every.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    met = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    formed = -F.col("b.less") >= RATIO * F.col("n")
    told = settle(met.select("word", "n", "n_near", F.when(formed, F.col("b.best")).alias("form"), F.when(formed, -F.col("b.less")).alias("form_n")))
    ways = settle(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = settle(ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_settled(ways)
        ways = met.select("word", "root")
        if met.where("moved").isEmpty():
            break
    return told.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 of a string of code points below 2048, a bit at a time.
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(flatten(list_transform(string_split({0}, ''),"
    " lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)), lambda u: list_transform(range(8), lambda i: ((u >> i::INT) & 1)::BIGINT)))),"
    " lambda a, b: xor(a >> 1, 3988292384::BIGINT * (xor(a, b) & 1))))"
)
SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')) AS r FROM documents),
hashed AS (SELECT r, {_CRC.format("d || ':' || r")} AS h FROM (SELECT d, translate(r, '{_UPPER}', '{_LOWER}') AS r FROM runs) l),
spelled AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN left(r, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM spelled WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, i, left(word, CAST(i AS INT)) AS a, substr(word, CAST(i AS INT) + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM words) w),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.a || c.b UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.a || c.b),
best AS (SELECT near.word, count(*) AS n_near, max(n) AS best_n FROM near JOIN words o ON o.word = other GROUP BY near.word),
least AS (SELECT near.word, min(other) AS other FROM near JOIN words o ON o.word = other JOIN best b ON b.word = near.word AND b.best_n = o.n GROUP BY near.word),
told AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * w.n THEN l.other END AS form, CASE WHEN best_n >= {RATIO} * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best b USING (word) LEFT JOIN least l USING (word)),
ways AS (SELECT word, form AS root, 1 AS step FROM told WHERE form IS NOT NULL UNION ALL SELECT y.word, t.form, step + 1 FROM ways y JOIN told t ON t.word = y.root WHERE t.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM ways GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM told LEFT JOIN ends USING (word)"""
