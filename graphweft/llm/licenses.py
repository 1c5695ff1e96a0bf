"""License scans: MinHash bands over overlapping text windows retrieve templates; shingle containment verifies them."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS, CONTAINMENT = 5, 0.8
#: One row a band, so that a window and a template with Jaccard similarity j meet with probability 1 - (1 - j) ** BANDS.
#: A window of 4/3 to 8/3 of a template's shingles, dealt at quarters of its size, holds any copy of it whole; at
#: containment 0.8 j is 0.27 at least and the probability 0.9998. Templates of one shingle are met with certainty.
BANDS = 27
#: Bytes of short texts looked at together, and words of which arrays are made at a time.
GROUP_BYTES, CHUNK_WORDS, HASHED_LETTERS = 1 << 20, 1 << 16, 64

#: Notices and license texts as their publishers word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do"
        " so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        ' in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY'
        " KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
        " FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"
        " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT'
        " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
        " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    ),
    "isc-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES'
        " OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,"
        " or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,"
        " and by any means."
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and"
        " redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must"
        " not claim that you wrote the original software."
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to"
        " the public domain worldwide. This software is distributed without any warranty."
    ),
}

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word: runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    raw = np.frombuffer(text, np.uint8)
    inside = _LETTER[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    hashes = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    at, live = starts.copy(), np.arange(len(starts))
    for _ in range(HASHED_LETTERS):
        if not len(live):
            break
        hashes[live] = _mixed(hashes[live] * _ODD + _LOWER[raw[at[live]]] + np.uint64(1))
        at[live] += 1
        live = live[at[live] < ends[live]]
    for i in live.tolist():  # very long words
        rest = text[at[i] : ends[i]].lower()
        hashes[i] = _mixed(hashes[i : i + 1] ^ np.uint64(int.from_bytes(hashlib.blake2b(rest, digest_size=8).digest())))[0]
    return hashes * _ODD + lengths.astype(np.uint64), starts, ends


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        out = _mixed(out * _ODD + words[i : i + n]) if n > 0 else out
    return out


def _permuted(hashes: np.ndarray, band: int) -> np.ndarray:
    return _mixed(hashes * np.uint64(2 * band + 3) + np.uint64((band * 0x632BE59BD9B4E019) % 2**64))


class Index:
    """Templates by number of words a shingle, window size and band value."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names, self.words, self.sets, self.places, self.classes = list(templates), [], [], [], {}
        for t, name in enumerate(self.names):
            words, _, _ = words_of(templates[name].encode())
            size = min(SHINGLE_WORDS, len(words))
            own = np.unique(shingles(words, size)) if size else np.zeros(0, np.uint64)
            places: dict[int, int] = {}
            for place, gram in enumerate(shingles(words, size).tolist()):
                places[gram] = -1 if gram in places else place  # only what stands once tells an order
            self.words.append(words)
            self.sets.append(own)
            self.places.append(places)
            if not len(own):
                continue
            count = len(words) - size + 1
            window = 1 if count == 1 else 1 << int(np.ceil(np.log2(count * 4 / 3)))
            bands = self.classes.setdefault(size, {}).setdefault(window, [{} for _ in range(BANDS)])
            for band in range(BANDS):
                bands[band].setdefault(int(_permuted(own, band).min()), []).append(t)

    def retrieve(self, grams: np.ndarray, size: int):
        """(template, first shingle, end) for each window that shares a band with a template."""
        found = set()
        largest = max(self.classes[size])
        for band in range(BANDS if largest > 1 else 1):
            low, step, window = _permuted(grams, band), 1, 1
            while True:
                if window in self.classes[size] and (window > 1 or not band):  # any band decides on one shingle
                    known = self.classes[size][window][band]
                    for i in np.flatnonzero(np.isin(low, np.fromiter(known, np.uint64, len(known)))).tolist():
                        found.update((t, i * step, i * step + window) for t in known[int(low[i])])
                if window >= largest:
                    break
                ahead = window // step
                low[:-ahead] = np.minimum(low[:-ahead], low[ahead:])
                if window >= 4:  # starts at quarters of the window are enough
                    low, step = low[::2].copy(), step * 2
                window *= 2
        return found

    def matches(self, texts: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        """For each text (template, first byte, end byte, containment) of its verified copies, in order, no two of a template overlapping."""
        out, at = [], 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) <= GROUP_BYTES):
                held += len(texts[upto]) + 1
                upto += 1
            out += self._matches(texts[at:upto])
            at = upto
        return out

    def _matches(self, texts: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        words, starts, ends = words_of(b"\n".join(texts))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        first = np.searchsorted(starts, bounds)  # first word of each text
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        for size in self.classes:
            reach, near = 2 * max(self.classes[size]), {}
            for base in range(0, max(len(words) - size + 1, 0), CHUNK_WORDS):
                grams = shingles(words[base : base + CHUNK_WORDS + reach + size], size)
                for t, a, b in self.retrieve(grams, size):
                    near.setdefault(t, []).append((base + a, base + min(b, len(grams))))
            for t, windows in near.items():
                n, hits = len(self.words[t]) - size + 1, []
                for a, b in _merged([(max(0, a - n), min(b + n, len(words) - size + 1)) for a, b in windows]):
                    grams = shingles(words[a : b + size - 1], size)
                    at = np.flatnonzero(np.isin(grams, self.sets[t]))
                    hits += zip((at + a).tolist(), grams[at].tolist(), strict=True)
                docs = np.searchsorted(first, [h[0] for h in hits], "right") - 1
                for doc in np.unique(docs).tolist():
                    own = [h for h in hits[np.searchsorted(docs, doc) : np.searchsorted(docs, doc, "right")] if h[0] + size <= first[doc + 1]]
                    for a, b, share in self._copies(own, t, n):
                        out[doc].append((self.names[t], int(starts[a] - bounds[doc]), int(ends[b + size - 1] - bounds[doc]), share))
        return [sorted(own, key=lambda m: (m[1], m[2], m[0])) for own in out]

    def _copies(self, hits: list[tuple[int, int]], t: int, n: int) -> list[tuple[int, int, float]]:
        """(first, last shingle, containment) of all disjoint copies of t among hits (place, shingle).

        Copies one after another are told apart where the template's order starts anew; then what lies between the
        copies found so is searched without regard to order.
        """
        parts, part, before = [], [], -n
        for hit in hits:
            place = self.places[t][hit[1]]
            if part and (hit[0] - part[-1][0] > n or 0 <= place < before - n // 4):
                parts.append(part)
                part, before = [], -n
            part.append(hit)
            before = max(before, place) if place >= 0 else before
        found = [best for p in [*parts, part] if (best := self._fullest(p, t, n))]
        gaps, at = [], 0
        for a, b, _ in found:
            upto = bisect_left(hits, (a,))
            gaps.append(hits[at:upto])
            at = bisect_left(hits, (b + 1,))
        gaps.append(hits[at:])
        while gaps:
            gap = gaps.pop()
            if best := self._fullest(gap, t, n):
                found.append(best)
                gaps += [gap[: bisect_left(gap, (best[0],))], gap[bisect_left(gap, (best[1] + 1,)) :]]
        return sorted(found)

    def _fullest(self, hits: list[tuple[int, int]], t: int, n: int) -> tuple[int, int, float] | None:
        """The fullest stretch of hits no longer than the template and a quarter, the first of equals, if it's enough.

        Both ends move over the hits once; at its ends a stretch has no shingle that it also has elsewhere.
        """
        need = CONTAINMENT * len(self.sets[t])
        if len(hits) < need:
            return None
        counts: dict[int, int] = {}
        best, j = (0, 0, 0), 0
        for i, (place, gram) in enumerate(hits):
            while j < len(hits) and hits[j][0] < place + n + n // 4:
                counts[hits[j][1]] = counts.get(hits[j][1], 0) + 1
                j += 1
            if len(counts) > best[0]:
                best = (len(counts), i, j)
            counts[gram] -= 1
            if not counts[gram]:
                del counts[gram]
        if best[0] < need:
            return None
        inside = Counter(h[1] for h in hits[best[1] : best[2]])
        i, j = best[1], best[2] - 1
        while inside[hits[j][1]] > 1:
            inside[hits[j][1]] -= 1
            j -= 1
        while inside[hits[i][1]] > 1:
            inside[hits[i][1]] -= 1
            i += 1
        return hits[i][0], hits[j][0], best[0] / len(self.sets[t])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _code_points(text: bytes, places: list[int]) -> list[int]:
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += len(text[at:place].decode("utf-8", "replace"))
        at, out[place] = place, n
    return [out[p] for p in places]


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_licenses, licenses, spans) of every row: the templates in its whole text, in SHINGLE_WORDS-word shingles.

    licenses: distinct names in order, comma-joined; spans: name:start:end:containment by start, in code points, ends
    exclusive. A template shorter than a shingle is one shingle of all its words. Null texts are empty; ids may be null
    or repeated; further columns are ignored. A map over rows: no shuffle, memory for one batch and one chunk.
    """

    def run(batches):
        index = Index(templates)
        for batch in batches:
            count, names, spans = [], [], []
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary())]
            for raw, found in zip(texts, index.matches(texts), strict=True):
                places = _code_points(raw, [p for m in found for p in m[1:3]]) if found else []
                count.append(len(found))
                names.append(",".join(sorted({m[0] for m in found})))
                spans.append(",".join(f"{m[0]}:{places[2 * i]}:{places[2 * i + 1]}:{m[3]:.3f}" for i, m in enumerate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_licenses", "licenses", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_licenses long, licenses string, spans string")
