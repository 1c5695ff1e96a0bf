"""Token counts of a SentencePiece BPE model by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A document with more tokens than this is over the limit.
LIMIT = 4096
#: Code points merged at a time. A longer text goes through in several windows, each of which ends where no piece runs on.
WINDOW = 1 << 20
SPACE = 0x2581
_NEVER = np.int32(2**31 - 1)


class Merges:
    """Arrays of a BPE vocabulary: which symbols merge to which, in what order, and where no merge can ever happen.

    Symbols are the code points that occur in pieces, then the pieces of several code points. A merge has the rank of
    the piece that it makes: pieces by falling score, equal scores share a rank and the leftmost merge goes first.
    """

    def __init__(self, pieces: dict[str, float], byte_fallback: bool) -> None:
        chars = sorted({c for p in pieces for c in p})
        number = {c: i for i, c in enumerate(chars)}
        number |= {p: len(chars) + i for i, p in enumerate(sorted(p for p in pieces if len(p) > 1))}
        self.size = len(number)
        self.chars = np.array([ord(c) for c in chars], np.int32)
        self.cost = np.array([1 if c in pieces or not byte_fallback else len(c.encode()) for c in chars] + [1] * (self.size - len(chars)), np.int64)
        ranks = {s: r for r, s in enumerate(sorted({s for p, s in pieces.items() if len(p) > 1}, reverse=True))}
        makers = np.zeros(len(ranks), np.int64)
        touching: set[tuple[int, int]] = set()
        found: list[tuple[int, int, int]] = []
        #: Ranks whose merges go one at a time: of several pieces, or of one that makes merges possible that come before it.
        self.single = np.zeros(len(ranks), bool)
        for piece, score in pieces.items():
            if len(piece) < 2:
                continue
            makers[ranks[score]] += 1
            for at in range(1, len(piece)):
                a, b = piece[:at], piece[at:]
                touching.add((number[piece[at - 1]], number[piece[at]]))
                if a in number and b in number:
                    found.append((number[a] * self.size + number[b], number[piece], ranks[score]))
                    for half in (a, b):
                        if len(half) > 1 and score >= pieces[half]:
                            self.single[ranks[pieces[half]]] = True
        self.single |= makers > 1
        found.sort()
        self.pairs, self.made, self.rank = (np.array([f[i] for f in found], t) for i, t in enumerate((np.int64, np.int32, np.int32)))
        self.touching = np.array(sorted(a * len(chars) + b for a, b in touching), np.int64)
        self.block = self._block(pieces)

    def _block(self, pieces: dict[str, float]) -> int:
        """m, where a run of spaces ends in pieces of m spaces from its left, but for what its last space takes part in; 0: not known to.

        So it is if all pieces of spaces only share a score below that of all others with a space, which have one only, at
        their beginning, and if m, the length of the longest, become one: leftmost merges go first, so a run's first m
        spaces become one whatever follows.
        """
        space = chr(SPACE)
        runs = {len(p): s for p, s in pieces.items() if len(p) > 1 and not p.strip(space)}
        others = [(p, s) for p, s in pieces.items() if space in p and p.strip(space)]
        if len(set(runs.values())) != 1 or any(p.rfind(space) or s <= min(runs.values()) for p, s in others):
            return 0
        most = max(runs)
        symbol = int(np.searchsorted(self.chars, SPACE))
        return most if self.counts(np.full(most, symbol, np.int32), np.array([0]))[0] == 1 else 0

    def number(self) -> np.ndarray:
        """Symbol of every code point; -1 for those that occur in no piece."""
        out = np.full(0x110000, -1, np.int32)
        out[self.chars] = np.arange(len(self.chars), dtype=np.int32)
        return out

    def cuts(self, symbols: np.ndarray, spaces: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether no piece can hold a code point and the one before it. begins: places where a text or a rest of one begins."""
        out = np.ones(len(symbols), bool)
        if len(symbols) > 1:
            code = symbols[:-1].astype(np.int64) * len(self.chars) + symbols[1:]
            at = np.minimum(np.searchsorted(self.touching, code), max(len(self.touching) - 1, 0))
            apart = self.touching[at] != code if len(self.touching) else np.ones(len(code), bool)
            out[1:] = apart | (symbols[:-1] < 0) | (symbols[1:] < 0)
            if self.block:
                place = np.arange(len(symbols))
                first = spaces & ~np.concatenate(([False], spaces[:-1]))
                first[begins] = True
                offset = place - np.maximum.accumulate(np.where(first, place, 0))
                out |= spaces & (offset > 0) & (offset % self.block == 0)
        out[begins] = True
        return out

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of pairs of symbols; pairs that don't merge have rank _NEVER."""
        code = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        holds = self.pairs[at] == code
        return np.where(holds, self.rank[at], _NEVER), np.where(holds, self.made[at], np.int32(-1))

    def counts(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each sequence. symbols: all sequences in a row; starts: where each begins.

        Every round applies to all unfinished sequences, at once, each one's merge of lowest rank: at all its places from
        the left that don't overlap, or at the leftmost where a rank's merges go one at a time.
        """
        out, own = np.zeros(len(starts), np.int64), np.arange(len(starts))
        if not len(self.pairs):
            return np.add.reduceat(self.cost[symbols], starts) if len(starts) else out
        seq = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
        rank, made = np.full(len(symbols), _NEVER), np.full(len(symbols), -1, np.int32)
        fresh = np.arange(len(symbols) - 1)
        while len(symbols):
            fresh = fresh[fresh + 1 < len(symbols)]
            inside = fresh[seq[fresh] == seq[fresh + 1]]
            rank[fresh] = _NEVER
            rank[inside], made[inside] = self.lookup(symbols[inside], symbols[inside + 1])
            best = np.minimum.reduceat(rank, starts)
            ended = best == _NEVER
            if ended.any():
                out[own[ended]] = np.add.reduceat(self.cost[symbols], starts)[ended]
                stay = ~ended[seq]
                symbols, rank, made, own, best = symbols[stay], rank[stay], made[stay], own[~ended], best[~ended]
                sizes = np.diff(np.append(starts, len(seq)))[~ended]
                starts = np.cumsum(sizes) - sizes
                seq = np.repeat(np.arange(len(sizes)), sizes)
                if not len(symbols):
                    break
            place = np.arange(len(symbols))
            hit = rank == best[seq]
            alone = self.single[best]
            if alone.any():
                leftmost = np.minimum.reduceat(np.where(hit, place, len(place)), starts)
                hit &= ~alone[seq] | (place == leftmost[seq])
            first = hit & ~np.concatenate(([False], hit[:-1]))
            hit &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = made[at]
            keep, changed = np.ones(len(symbols), bool), hit.copy()
            keep[at + 1] = False
            changed[:-1] |= hit[1:]
            symbols, rank, made, seq = symbols[keep], rank[keep], made[keep], seq[keep]
            rank[-1] = _NEVER
            fresh = np.flatnonzero(changed[keep])
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        return out


def read_model(path: str) -> Merges:
    """The merges of a SentencePiece file. Raises ValueError unless it is a BPE model with byte fallback that changes nothing in a text but its spaces."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError(f"{path}: only BPE models with byte fallback, a space in front and no other changes of the text are supported")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: pieces that users defined or that aren't used are not supported")
    return Merges({p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}, True)


class Counter:
    """Counts tokens of texts with one vocabulary."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.number = merges, merges.number()
        self.mix = np.random.default_rng(11).integers(1, 2**63, merges.size, np.uint64) | np.uint64(1)

    def _points(self, text: str) -> np.ndarray:
        return np.frombuffer(text.replace(" ", chr(SPACE)).encode("utf-32-le"), np.int32)

    def _cut(self, points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = self.number[points]
        return symbols, self.merges.cuts(symbols, points == SPACE, begins)

    def _windows(self, texts: list[str]):
        """(number of each text in it, where each begins, code points): texts together up to WINDOW, a longer one in parts."""
        held, names, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if size and size + len(text) > WINDOW:
                yield names, held
                held, names, size = [], [], 0
            text, at, width = chr(SPACE) + text, 0, WINDOW
            while len(text) - at > width:
                points = self._points(text[at : at + width])
                ends = np.flatnonzero(self._cut(points, np.array([0]))[1][1:])
                if len(ends):
                    yield [i], [points[: ends[-1] + 1]]
                    at, width = at + int(ends[-1]) + 1, WINDOW
                else:
                    width *= 2
            held.append(self._points(text[at:]))
            names.append(i)
            size += len(held[-1])
        if held:
            yield names, held

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for names, held in self._windows(texts):
            sizes = np.array([len(h) for h in held])
            points, begins = np.concatenate(held), np.cumsum(sizes) - sizes
            symbols, cut = self._cut(points, begins)
            starts = np.flatnonzero(cut)
            tokens = self._sequences(symbols, points, starts)
            np.add.at(out, np.array(names), np.add.reduceat(tokens, np.searchsorted(starts, begins)))
        return out

    def _sequences(self, symbols: np.ndarray, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; equal ones are merged once."""
        sizes = np.diff(np.append(starts, len(symbols)))
        out = np.ones(len(starts), np.int64)
        strange = symbols[starts] < 0  # code points in no piece stand alone: a token a byte
        at = points[starts[strange]]
        out[strange] = 1 + (at > 0x7F) + (at > 0x7FF) + (at > 0xFFFF)
        many = np.flatnonzero(sizes > 1)
        lone = np.flatnonzero((sizes == 1) & ~strange)
        out[lone] = self.merges.cost[symbols[starts[lone]]]
        if not len(many):
            return out
        flat, begins = _gathered(starts[many], sizes[many])
        own, offset = symbols[flat], flat - np.repeat(starts[many], sizes[many])
        powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        hashes = np.add.reduceat(self.mix[own] * powers[offset], begins)
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        like = first[group]  # a sequence with the same hash, taken for equal only if it is
        same = sizes[many][like] == sizes[many]
        other = np.minimum(np.repeat(begins[like], sizes[many]) + offset, len(own) - 1)
        same &= np.logical_and.reduceat(own[other] == own, begins)
        chosen = np.unique(np.concatenate((first, np.flatnonzero(~same))))
        flat, place = _gathered(begins[chosen], sizes[many][chosen])
        tokens = np.zeros(len(many), np.int64)
        tokens[chosen] = self.merges.counts(own[flat], place)
        out[many] = np.where(same, tokens[like], tokens)
        return out


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of runs, one after another; where each run begins among these)."""
    begins = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(begins - starts, sizes), begins


def _counted(merges: Merges):
    def run(batches):
        counter = Counter(merges)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512)
                tokens = counter.count([t or "" for t in part.to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), batch.column(2).slice(at, 512), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs: a text's UTF-8 bytes, and its tokens in the model at that path.

    Texts are cut where no piece can run on, which bounds what is merged at once; equal sequences of a window are merged
    once. A sequence takes a round for each piece it makes, so work is linear in its length at any length. The model's
    arrays go to the tasks, which read no file. No shuffle.

    Null and empty texts have no bytes and no tokens; null and repeated ids come back as they are; an empty table gives
    an empty one; further columns, whatever their names, are ignored. Control strings inside texts are ordinary text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_counted(read_model(model)), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
