"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns (letters of assign in either case) and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
KINDS = ("assign", "access", "hex", "entropy")

#: Entropy scan. A candidate is a run of these characters with a digit and a letter; a window of its class's size counts
#: if its entropy in bits a character reaches the class's threshold. Classes are tried in this order.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]+"), 24, 3.2),
    ("base32", re.compile(r"[A-Z2-7=]+"), 24, 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.9),
)
#: What looks random and isn't secret: UUIDs, paths and snake or kebab words, and runs of one alphabet.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
        r"(?:[A-Za-z]+|[0-9]+)(?:[/_=+-]+(?:[A-Za-z]+|[0-9]+))*[/_=+-]*",
    )
)
#: Placeholders: of a run, the part between two dividers that holds one isn't secret; the other parts may be.
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|dummy|your(?=[_-])|xxxx|0000000|abcdefgh|0123456789|qwerty")
DIVIDER = re.compile(r"[/=_-]")


def high_entropy(text: str, window: int, threshold: float) -> tuple[int, int] | None:
    """From the first to the end of the last window whose entropy reaches threshold; each step changes two counts."""
    terms = [0.0, *(n * math.log2(n) for n in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, first, last = 0.0, None, None  # sum of n log n; entropy is log(window) - total / window
    most = (math.log2(window) - threshold) * window + 1e-9
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += terms[n + 1] - terms[n]
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += terms[n - 1] - terms[n]
        if i >= window - 1 and total <= most:
            first, last = (i - window + 1 if first is None else first), i + 1
    return None if first is None else (first, last)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _placeholders(text: str, a: int, b: int):
    """The parts of a to b, between dividers, that hold a placeholder; each character is looked at a fixed number of times."""
    at = a
    while m := PLACEHOLDER.search(text, at, b):
        start = max(*(text.rfind(c, at, m.start()) for c in "/=_-"), at - 1) + 1
        end = d.start() if (d := DIVIDER.search(text, m.end(), b)) else b
        yield start, end
        at = end


def _entropy_spans(text: str, taken: list[tuple[int, int]]):
    """Spans in what base spans and placeholders leave of the candidates. taken: sorted and disjoint, passed over once."""
    k = 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        free = []
        while k < len(taken) and taken[k][0] < end:
            if at < taken[k][0]:
                free.append((at, taken[k][0]))
            at = max(at, taken[k][1])
            if at > end:
                break  # it reaches into what follows
            k += 1
        if at < end:
            free.append((at, end))
        for a, b in free:
            for c, d in _placeholders(text, a, b):
                if a < c:
                    yield from _entropy_span(text[a:c], a)
                a = d
            if a < b:
                yield from _entropy_span(text[a:b], a)


def _entropy_span(run: str, at: int):
    if not any(map(str.isdigit, run)) or not any(map(str.isalpha, run)) or any(p.fullmatch(run) for p in ALLOW):
        return
    for _, chars, window, threshold in CLASSES:
        if len(run) >= window and chars.fullmatch(run):
            if hit := high_entropy(run, window, threshold):
                yield at + hit[0], at + hit[1]
            return


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind in the order of KINDS."""
    found = []
    found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_CHARS]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    found += [(a, b, "entropy") for a, b in list(_entropy_spans(text, _merged([s[:2] for s in found])))]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def masked(text: str) -> str:
    """text with each secret replaced by a mark of its kind; overlapping spans go together under the first's kind."""
    out, at, upto = [], 0, -1
    for a, b, kind in scan(text):
        if a < upto:
            upto = max(upto, b)
            at = upto
            continue
        out += [text[at:a], f"[SECRET:{kind}]"]
        at = upto = b
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scanned(batches):
    for batch in batches:
        counts, digests, spans = {k: [] for k in KINDS}, [], []
        for text in batch.column(1):
            found = scan(text.as_py() or "")
            for kind in KINDS:
                counts[kind].append(sum(s[2] == kind for s in found))
            digests.append(hashlib.sha256(_joined(s for s in found if s[2] != "entropy").encode()).hexdigest())
            spans.append(_joined(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of every row, over its whole text.

    Positions are code points, ends exclusive. Null texts are empty; ids may be null or repeated; further columns are
    ignored. A map over rows: no shuffle, and memory for one batch.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with secrets masked and chars_col, where there is one, counted anew; all other columns as they are. Null stays null."""
    at, names = docs.columns.index(text_col), docs.columns
    count = names.index(chars_col) if chars_col in names else None
    kind = docs.schema[chars_col].dataType.simpleString() if count is not None else ""

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [x if x is None else masked(x) for x in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count is not None and kind in ("bigint", "int"):
                was = batch.column(count).to_pylist()
                columns[count] = pa.array([w if x == y else len(y) for w, x, y in zip(was, old, new, strict=True)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
