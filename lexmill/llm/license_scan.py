"""License scan: MinHash bands over overlapping windows retrieve templates, and exact
containment of word shingles decides.

For each length of a template, rounded up to ``LENGTHS``, windows of that many words start at
every ``length // STEP_SHARE`` words of a text, so that some window holds all but a small
share of a template standing anywhere. A window's ``ROWS * BANDS`` minima over its shingles
of ``SHINGLE`` words make band keys; a template with an equal band key is a candidate, and
matches if the window around, widened by a step on both sides, holds at least
``CONTAINMENT`` of its shingles. Those with a number, and those that tell the template from
similar ones of other licenses, must be there too (all, or ``PART_SHARE`` of a part of
``LONG_PART`` and more): a version, a "NonCommercial" or a third clause is a small part of a notice
but decides. A license whose template is contained in that of another, as two clauses are in
three, is reported only where the more specific one doesn't match.

A window over a template at the worst offset has a Jaccard similarity of about
``1 - 2 / STEP_SHARE`` or more, at which one of ``BANDS`` bands of ``ROWS`` rows agrees with
a probability of over 0.999 (``band_recall``). A band key can only agree if the window
holds a shingle of the template, and a template can only match where as many template shingles
stand as it needs, so that windows with fewer than any template of their length needs are
skipped before they are hashed: that loses no match.

Templates are a parameter of the caller, kept in memory; a list of more than
``MOST_SHINGLES`` shingles is refused.

Defined cases: null, empty and short texts have fewer windows or none and match nothing; a
template of fewer words than a shingle is refused; words are compared A-Z lower-cased and
without punctuation; a license matched more than once in a document is one row with its best
containment; repeated rows are reported each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.byte_words import DIGIT, PUNCTUATED, inside_rows, mix64, shingles, words_of

SHINGLE = 3
BANDS, ROWS = 24, 2
STEP_SHARE = 8
CONTAINMENT = 0.8
# share of a template's shingles in another's from which both are told apart
SIMILAR = 0.6
# share of a template's shingles in a longer one from which that is the more specific
CONTAINED = 0.9
# distinguishing shingles from which some may be missing, and the share that must be there
LONG_PART, PART_SHARE = 10, 0.6
MOST_SHINGLES = 1 << 20
LENGTHS = tuple(sorted({round(5 * 1.3**k) for k in range(30)}))

_CLAUSES = {
    "head": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met",
    "source": "Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer",
    "binary": "Redistributions in binary form must reproduce the above copyright notice, this list "
    "of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution",
    "advertising": "All advertising materials mentioning features or use of this software must "
    "display the following acknowledgement",
    "names": "Neither the name of the copyright holder nor the names of its contributors may be "
    "used to endorse or promote products derived from this software without specific prior "
    "written permission",
}
_GNU = {
    "GPL": ("General Public License", ("2", "3")),
    "LGPL": ("Lesser General Public License", ("2.1", "3")),
    "AGPL": ("Affero General Public License", ("3",)),
}
_CREATIVE = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _clauses(*names: str) -> str:
    return ". ".join(_CLAUSES[n] for n in names)


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {name}" for name in names)


def _gnu_notices(short: str, long: str, version: str) -> tuple[str, ...]:
    whole = version if "." in version else f"{version}.0"
    forms = [
        f"This {work} is free software{mark} you can redistribute it and/or modify it under the terms "
        f"of the GNU {long} as published by the Free Software Foundation{after} either version "
        f"{version} of the License, or (at your option) any later version"
        for work in ("program", "library")
        for mark, after in (((":", ","),) if version == "3" else ((";", ";"),))
    ]
    return (
        f"This work is licensed under the GNU {long}, version {version}",
        *forms,
        *(f"{short} v{v} {kind}" for v in {version, whole} for kind in ("only", "or later")),
        *(f"GNU {short} v{v}" for v in {version, whole}),
        *_spdx(f"{short}-{whole}", f"{short}-{whole}-only", f"{short}-{whole}-or-later"),
    )


# public license notices, by SPDX identifier
TEMPLATES = {
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the software",
        *_spdx("MIT"),
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
        *_spdx("ISC"),
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0",
        *_spdx("Apache-2.0"),
    ),
    **{
        f"{short}-{version if '.' in version else version + '.0'}": _gnu_notices(short, long, version)
        for short, (long, versions) in _GNU.items()
        for version in versions
    },
    **{
        f"CC-{short}-{version}": (
            f"Licensed under CC {short} {version}",
            f"This work is licensed under a Creative Commons {long} {version} {port} License",
            *_spdx(f"CC-{short}-{version}"),
        )
        for short, long in _CREATIVE.items()
        for version, port in (("3.0", "Unported"), ("4.0", "International"))
    },
    "BSD-2-Clause": (_clauses("head", "source", "binary"), *_spdx("BSD-2-Clause")),
    "BSD-3-Clause": (_clauses("head", "source", "binary", "names"), *_spdx("BSD-3-Clause")),
    "BSD-4-Clause": (
        _clauses("head", "source", "binary", "advertising", "names"),
        *_spdx("BSD-4-Clause"),
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        *_spdx("MPL-2.0"),
    ),
}

_U64 = np.uint64
_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def band_recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that sets of that Jaccard similarity share a band key."""
    return 1 - (1 - similarity**rows) ** bands


def band_keys(found: np.ndarray) -> np.ndarray:
    """A set's key in each band."""
    least = mix64(found[None, :] ^ _SEEDS[:, None]).min(axis=1).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=_U64)
    for k in range(ROWS):
        key = mix64(key * _U64(0x9E3779B97F4A7C15) + least[:, k])
    return key


class TemplateIndex:
    """Templates by band key, their shingles and window lengths."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.names, self.sets, self.words, self.bands = [], [], [], {}
        # window length: shingles of the smallest template that it is for
        self.lengths: dict[int, int] = {}
        total, numbers, across = 0, [], []
        for name, texts in sorted(templates.items()):
            for text in texts:
                whole = next(words_of(pa.array([text]), PUNCTUATED))
                words = whole.hashes
                digits = np.concatenate([[0], np.cumsum(DIGIT[whole.data])])
                number = digits[whole.end] > digits[whole.begin]
                if len(words) < SHINGLE:
                    raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
                every = shingles(words, SHINGLE)
                found = np.unique(every)
                numbers.append(every[[number[i : i + SHINGLE].any() for i in range(len(every))]])
                between = [
                    b". " in whole.data[whole.end[i] : whole.begin[i + SHINGLE - 1]].tobytes()
                    for i in range(len(every))
                ]
                across.append(every[np.array(between, bool)])
                total += len(found)
                if total > MOST_SHINGLES:
                    raise ValueError(f"the templates have more than {MOST_SHINGLES} shingles")
                for key in band_keys(found):
                    self.bands.setdefault(int(key), []).append(len(self.sets))
                self.names.append(name)
                self.sets.append(found)
                self.words.append(len(words))
                fitting = [x for x in LENGTHS if x >= len(words)]
                length = fitting[0] if fitting else len(words)
                self.lengths[length] = min(len(found), self.lengths.get(length, len(found)))
        # per template the shingles that must be there: with a number, and per similar template
        # those that it lacks; and the templates that are more specific
        self.needed, self.above = [], []
        for name, found, needed, apart in zip(self.names, self.sets, numbers, across, strict=True):
            parts, above = [np.unique(needed)], set()
            for t, (other, theirs) in enumerate(zip(self.names, self.sets, strict=True)):
                shared = np.isin(found, theirs)
                if other != name and shared.mean() >= SIMILAR:
                    # between two sentences texts put numbers and marks
                    parts.append(found[~shared & ~np.isin(found, apart)])
                if other != name and shared.mean() >= CONTAINED and len(theirs) > len(found):
                    above.add(t)
            whole = [1.0] + [PART_SHARE if len(p) >= LONG_PART else 1.0 for p in parts[1:]]
            self.needed.append([(p, w) for p, w in zip(parts, whole, strict=True) if len(p)])
            self.above.append(above)
        self.every = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, _U64)

    def _told_apart(self, t: int, around: np.ndarray) -> bool:
        return all(np.isin(part, around).mean() >= share for part, share in self.needed[t])

    def matches(self, found: np.ndarray, hits: np.ndarray, least: float):
        """(template, containment, first word) of the matches in one text. ``found``: its
        shingles in order; ``hits``: the places of those that are shingles of a template."""
        matched: dict[tuple[int, int], float] = {}
        for length, smallest in self.lengths.items():
            step = max(1, length // STEP_SHARE)
            wide = max(1, length - SHINGLE + 1)
            # windows start at multiples of the step; a short text is one window
            low = np.maximum(0, -(-(hits - wide + 1) // step))
            starts = np.unique(
                np.concatenate([np.arange(a, b + 1) for a, b in zip(low, hits // step, strict=True)])
            )
            begins = np.maximum(0, starts * step - step)
            inside = np.searchsorted(hits, starts * step + wide + step) - np.searchsorted(hits, begins)
            for s in starts[inside >= least * smallest].tolist():
                a = s * step
                begin = max(0, a - step)
                around = found[begin : a + wide + step]
                tried = set()
                for key in band_keys(found[a : a + wide]).tolist():
                    for t in self.bands.get(key, ()):
                        if t in tried:
                            continue
                        tried.add(t)
                        share = float(np.isin(self.sets[t], around).mean())
                        if share >= least and self._told_apart(t, around):
                            first = begin + int(np.flatnonzero(np.isin(around, self.sets[t]))[0])
                            matched[t, first] = max(share, matched.get((t, first), 0.0))

        def overlap(t: int, at: int, u: int, other: int) -> bool:
            return at < other + self.words[u] and other < at + self.words[t]

        return [
            (t, share, at)
            for (t, at), share in sorted(matched.items())
            if not any(u in self.above[t] and overlap(t, at, u, other) for u, other in matched)
        ]


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    least: float = CONTAINMENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, license, containment, first_word``: a row per document and license."""
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            rows, names, shares, places = [], [], [], []
            for words in words_of(batch.column(1), PUNCTUATED):
                every = shingles(words.hashes, SHINGLE)
                if not len(every) or not len(known.every):
                    continue
                place = np.minimum(np.searchsorted(known.every, every), len(known.every) - 1)
                hit = np.flatnonzero((known.every[place] == every) & inside_rows(words.first, SHINGLE))
                owner = np.searchsorted(words.first, hit, side="right") - 1
                for row in np.unique(owner):
                    a, b = int(words.first[row]), int(words.first[row + 1])
                    found = every[a : b - SHINGLE + 1]
                    best: dict[str, tuple[float, int]] = {}
                    for t, inside, at in known.matches(found, hit[owner == row] - a, least):
                        name = known.names[t]
                        if inside > best.get(name, (0.0, 0))[0]:
                            best[name] = (inside, at)
                    for name, (inside, at) in sorted(best.items()):
                        rows.append(words.start + int(row))
                        names.append(name)
                        shares.append(inside)
                        places.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()),
                 pa.array(shares, pa.float64()), pa.array(places, pa.int64())],
                ["doc_id", "license", "containment", "first_word"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(
        run, "doc_id long, license string, containment double, first_word long"
    )
