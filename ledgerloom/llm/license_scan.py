"""License scans: template k-grams pick candidates, banded alignment confirms them.

Templates are cut into word k-grams, which enter an inverted index: those winnowed
from every window if the words that may differ always leave a whole window, else
all, and shorter ones too where not even a k-gram is sure to be left. Words of the documents that no template
has cannot match, so k-grams are formed from the ids of template words and are
exact. Where a document meets the index, the template is aligned with the words
around that place within a band, which gives the matched share and the span. The
span has to hold the template's numbers and the words that name its license, and
name the same kind of it; where no naming word is near, nothing is aligned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, encoded, mixed, raw, slices, spans, table

K = 3
WINDOW = 4
# Least share of a template's words that has to match, and words the band allows on either side, as a share of them.
COVERAGE = 0.8
SLACK = 0.2
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

# Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software."
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
}
TEMPLATES |= {
    f"CC-{kind}-{v}": f"Licensed under CC {kind} {v}"
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0") if (kind, v) != ("BY-NC", "4.0")
} | {
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "Apache-1.0": "Licensed under the Apache License, Version 1.0",
    "BSD": "Released under the BSD License",
    "BSD-2-Clause": "Released under the BSD 2-Clause License",
    "BSD-3-Clause": "Released under the BSD 3-Clause License",
    "BSD-2-Clause turned": "Released under the 2-Clause BSD License",
    "BSD-3-Clause turned": "Released under the 3-Clause BSD License",
    "ISC": "Released under the ISC License",
    "MPL-1.1": "Licensed under the Mozilla Public License, Version 1.1",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0",
    "EPL-1.0": "Licensed under the Eclipse Public License, Version 1.0",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0",
}
# The long header keeps its words, but for the kind and version.
for _name, _kind, _version in [
    ("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"),
    ("AGPL-3.0", "Affero ", "3"),
]:
    TEMPLATES[_name] = TEMPLATES["GPL-3.0"].replace("General", f"{_kind}General").replace("version 3", f"version {_version}")
    TEMPLATES[f"{_name} header"] = TEMPLATES["GPL-3.0 header"].replace("General", f"{_kind}General").replace("version 3", f"version {_version}")
# Abbreviations, with the version beside or in the word, and machine-readable tags.
for _family, _versions in {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",)}.items():
    for _version in _versions:
        _short, _name = _version.removesuffix(".0"), f"{_family}-{_version}"
        TEMPLATES[f"{_name} abbreviated"] = f"Licensed under the {_family} v{_short}"
        TEMPLATES[f"{_name} by version"] = f"Licensed under the {_family} {_version}"
        for _verb in ("Licensed", "Released") if "." not in _short else ():
            TEMPLATES[f"{_name} in a word, {_verb.lower()}"] = f"{_verb} under the {_family}v{_short}"
for _name in [n for n in TEMPLATES if " " not in n and n != "BSD"]:
    TEMPLATES[f"{_name} tag"] = f"SPDX-License-Identifier: {_name}"
# Words that name a license; a version may be written to the end of one.
NAMES = {b"mit", b"apache", b"gnu", b"cc", b"mozilla", b"mpl", b"bsd", b"isc", b"eclipse", b"epl", b"gpl", b"lgpl", b"agpl"}
VERSIONED = re.compile(rb"([a-z]*?)v?([0-9]+)")
# What tells kinds of a family apart, after the words that it stands behind.
KINDS = {b"cc": {b"nc", b"sa", b"nd"}, b"gnu": {b"lesser", b"library", b"affero"}}


def named_in(word: bytes) -> tuple[bytes, bytes]:
    """The license name and the number that a word holds: gplv3 holds both, v3 and 3 a number; empty where it holds none."""
    parts = VERSIONED.fullmatch(word)
    name, number = parts.groups() if parts else (word, b"")
    return (name, number) if name in NAMES else (b"", b"" if name else number)


def marks(span: list[bytes]) -> tuple[set[bytes], set[bytes], set[bytes]]:
    """Numbers, words that tell the kind of license, and names of licenses, of a span of words."""
    kinds = {w for i, w in enumerate(span) for family, named in KINDS.items() if w in named and family in span[max(0, i - 4 if family == b"cc" else i - 1) : i]}
    names, numbers = zip(*map(named_in, span)) if span else ((), ())
    return set(numbers) - {b""}, kinds, set(names) - {b""}


def words(column: pa.Array):
    """Starts, ends and rows of the words of all texts, their ids, and the distinct words: letters and digits, A-Z in lower case."""
    data, offsets = raw(column)
    separator = SEPARATOR[data]
    starts, ends, row = spans(separator, offsets)
    ids, distinct = encoded(LOWER[data], separator, starts, ends)
    return starts, ends, row, ids, distinct, offsets


def kgrams(ids: np.ndarray, row: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the k-grams within a text whose words all have an id above zero."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, whole = np.zeros(n, np.int64), row[k - 1 :] == row[:n]
    for j in range(k):
        code = code * base + ids[j : j + n]
        whole &= ids[j : j + n] > 0
    at = np.flatnonzero(whole)
    return at, code[at]


class Index:
    """Words of all templates and the places of their k-grams."""

    def __init__(self, templates: dict[str, str], k: int = K, window: int = WINDOW, coverage: float = COVERAGE):
        self.names = list(templates)
        _, _, row, ids, distinct, _ = words(pa.array(list(templates.values()), pa.string()))
        self.vocabulary = {w: i + 1 for i, w in enumerate(distinct.to_pylist())}
        self.base = len(self.vocabulary) + 1
        # Codes of k-grams are exact: very many different words make them shorter, which finds more candidates.
        while self.base**k >= 2**62:
            k -= 1
        self.templates = [ids[row == i] + 1 for i in range(len(self.names))]
        self.slack = [max(2, int(SLACK * len(t))) for t in self.templates]
        named = distinct.to_pylist()
        self.marks = [marks([named[w - 1] for w in template]) for template in self.templates]
        entries, self.ks = [], set()
        for i, template in enumerate(self.templates):
            # What may differ cuts the template into pieces, the longest of which has ``left`` words or more.
            differ = len(template) - int(np.ceil(coverage * len(template) - 1e-9))
            left = -(-(len(template) - differ) // (differ + 1))
            size = max(1, min(k, left))
            self.ks.add(size)
            at, code = kgrams(template, np.zeros(len(template), np.int64), size, self.base)
            if left < size + window - 1:
                entries += [(int(c), i, int(p)) for c, p in zip(code, at)]
                continue
            hashes = mixed(code)
            chosen = {int(s + hashes[s : s + window].argmin()) for s in range(max(1, len(at) - window + 1)) if len(at)}
            entries += [(int(code[p]), i, int(at[p])) for p in chosen]
        entries.sort()
        self.codes, self.starts = np.unique(np.array([e[0] for e in entries], np.int64), return_index=True)
        self.starts = np.append(self.starts, len(entries))
        self.template = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)


def align(template: np.ndarray, text: np.ndarray, first: int, slack: int) -> tuple[int, int, int]:
    """(matched words, start, stop) of the best alignment with the template's first word within ``slack`` of ``first``.

    A match counts one, a replaced, missing or additional word takes off a half.
    """
    width = 2 * slack + 1
    low = first - slack
    at = np.arange(width)
    position = low + at
    valid = (position >= 0) & (position <= len(text))
    far = -1e9
    score, start, matched = np.where(valid, 0.0, far), position.copy(), np.zeros(width, np.int64)
    padded = np.full(len(template) + width + 1, -1, np.int64)
    begin, stop = max(0, low), min(len(text), low + len(padded))
    if stop > begin:
        padded[begin - low : stop - low] = text[begin:stop]
    for i, word in enumerate(template):
        same = padded[i : i + width] == word
        cross = score + np.where(same, 1.0, -0.5)
        lacks = np.append(score[1:] - 0.5, far)
        take = lacks > cross
        new = np.where(take, lacks, cross)
        begun = np.where(take, np.append(start[1:], 0), start)
        found = np.where(take, np.append(matched[1:], 0), matched + same)
        lead = new + 0.5 * at
        best = np.maximum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == best, at, 0))
        score, start, matched = best - 0.5 * at, begun[source], found[source]
        position = i + 1 + low + at
        score = np.where((position < 0) | (position > len(text)), far, score)
    top = int(score.argmax())
    return int(matched[top]), int(start[top]), len(template) + low + top


def near_its_name(index: Index, named: list[bytes], plain: np.ndarray, template: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which candidates have all naming words of their template among the words that an alignment can reach."""
    names = sorted(NAMES)
    code = np.array([names.index(n) if n else -1 for n, _ in map(named_in, named)] or [-1], np.int64)
    code = code[plain] if len(plain) else plain
    places = {name: np.flatnonzero(code == j) for j, name in enumerate(names)}
    keep = np.ones(len(template), bool)
    for t in np.unique(template).tolist():
        mine = np.flatnonzero(template == t)
        slack, size = index.slack[t], len(index.templates[t])
        for name in index.marks[t][2]:
            at = places[name]
            low, high = first[mine] - slack, first[mine] + size + slack
            keep[mine] &= np.searchsorted(at, low) < np.searchsorted(at, high)
    return keep


def find(index: Index, column: pa.Array, coverage: float = COVERAGE):
    """(row, template, matched words, start, stop) of every match in a slice; places are bytes of the text."""
    starts, ends, row, ids, distinct, offsets = words(column)
    named, plain = distinct.to_pylist(), ids
    known = np.array([index.vocabulary.get(w, 0) for w in named], np.int64)
    ids = known[ids] if len(ids) else ids
    at, code = (np.concatenate(x) for x in zip(*(kgrams(ids, row, k, index.base) for k in sorted(index.ks))))
    near = np.searchsorted(index.codes, code)
    hit = near < len(index.codes)
    hit[hit] = index.codes[near[hit]] == code[hit]
    at, near = at[hit], near[hit]
    n = index.starts[near + 1] - index.starts[near]
    entry = np.repeat(index.starts[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    template, first, text = index.template[entry], np.repeat(at, n) - index.place[entry], np.repeat(row[at], n)
    near = near_its_name(index, named, plain, template, first)
    template, first, text = template[near], first[near], text[near]
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    order = np.lexsort((first, template, text))
    found: dict[int, list] = {}
    last = None
    for r, t, f in zip(text[order].tolist(), template[order].tolist(), first[order].tolist()):
        slack = index.slack[t]
        # Hits whose template would begin at nearly the same word are one candidate.
        if last and last[:2] == (r, t) and f - last[2] <= slack // 2:
            continue
        last = (r, t, f)
        base = int(bounds[r])
        matched, start, stop = align(index.templates[t], ids[base : bounds[r + 1]], f - base, slack)
        if matched < coverage * len(index.templates[t]) - 1e-9 or stop <= start:
            continue
        numbers, kinds, names = marks([named[w] for w in plain[base + start : base + stop].tolist()])
        if index.marks[t][0] <= numbers and index.marks[t][1] == kinds and index.marks[t][2] <= names:
            found.setdefault(r, []).append((matched, t, base + start, base + stop))
    for r, matches in sorted(found.items()):
        kept = []
        # The longest first: what lies inside a longer match is part of it.
        for matched, t, start, stop in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(start < b and stop > a for _, _, a, b in kept):
                kept.append((matched, t, start, stop))
        for matched, t, start, stop in sorted(kept, key=lambda m: m[2]):
            yield r, t, matched, int(starts[start] - offsets[r]), int(ends[stop - 1] - offsets[r])


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """One row for each license notice found: id, license, coverage, matched words, start and stop as bytes of the text.

    Matches that overlap a longer one of their document are left out; of equally
    long ones the template that comes first stays, then the earlier place. Documents
    without a match, null and empty texts have no row; repeated rows repeat their
    matches.
    """
    index = Index(templates or TEMPLATES, coverage=coverage)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            hits = list(find(index, part.column("text"), coverage))
            if hits:
                row, template, matched, start, stop = (np.array(x) for x in zip(*hits))
                sizes = np.array([len(t) for t in index.templates])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(row)),
                        pa.array([index.names[t] for t in template], pa.string()),
                        pa.array(matched / sizes[template]),
                        *(pa.array(x, pa.int64()) for x in (matched, start, stop)),
                    ],
                    ["id", "license", "coverage", "matched_words", "start", "stop"],
                )

    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"id {kind}, license string, coverage double, matched_words long, start long, stop long")
    return found.withColumnRenamed("id", id_col)


def op10_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
