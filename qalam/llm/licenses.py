"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashSet, shingle_hashes, word_hashes
from .decontaminate import shingles, words
from .license_texts import TEXTS

#: Chance that the bands miss a window that holds a template.
MISS = 1e-9
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")

# fixed values: the licences' public notices
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
              "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
              "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
              "copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 1, or (at your "
                "option) any later version."),
    *((f"CC-{short}-4.0", f"Licensed under CC {short} 4.0") for short in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons Attribution{rest} 4.0 International License")
      for short, rest in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"),
                          ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"))),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work"),
]

# the FSF's standard headers; versions and kinds differ by a word, so each needs its own for the fullest to be the right one
_HEADER = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by "
           "the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")
_GNU = [("GPL-1.0", "General Public License", "1"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
        ("LGPL-2.0", "Library General Public License", "2"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")]
# BSD texts as far as they tell two clauses from three and hold no holder's name; conditions with numbers or bullets
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: {} Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. {} Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. {}")
_DISCLAIMER = (
    "THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE.")
_PROVIDED = "THIS SOFTWARE IS PROVIDED BY"
_ADVERTISING = ("All advertising materials mentioning features or use of this software must display the following acknowledgement: "
                "This product includes software developed by")
#: Names of texts that several licences open with: any other finding on the same words goes first.
NEUTRAL = {"BSD"}
#: What follows a whole identifier must not go on with it, as -0 does behind MIT.
_IDENTIFIER = "SPDX-License-Identifier:"
_GOES_ON = re.compile(r"[-.][A-Za-z0-9]")
_THIRD = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
          "derived from this software without specific prior written permission.")


def _texts() -> list[tuple[str, str]]:
    """The standard headers, identifiers, BSD texts and full licence texts that TEMPLATES does not spell out."""
    out = []
    for name, title, version in _GNU:
        out += [(name, _HEADER.format(noun, ":", title, ",", version)) for noun in ("program", "library")]
        out.append((name, f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                          f"{title} version {version} as published by the Free Software Foundation."))
        out.append((name, f"licensed under the GNU {title}, version {version}"))
        out += [(name, f"SPDX-License-Identifier: {name}{x}") for x in ("", "-only", "-or-later")]
    out += [(name, f"{_IDENTIFIER} {name}") for name in (
        "BSD-2-Clause", "BSD-4-Clause", "MIT-0", "EPL-1.0", "EPL-2.0", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0",
        *(f"CC-{x}-4.0" for x in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")))]
    for marks in (("1.", "2.", "3."), ("*", "*", "*")):
        head = _BSD.format(*marks[:2], "")
        out += [("BSD-2-Clause", head + _PROVIDED), ("BSD-2-Clause", f"{head}{_PROVIDED} {_DISCLAIMER}"),
                ("BSD-4-Clause", f"{head}{marks[2]} {_ADVERTISING}"),
                ("BSD-3-Clause", f"{head}{marks[2]} Neither the name of"),
                ("BSD-3-Clause", f"{head}{marks[2]} {_THIRD} {_PROVIDED} {_DISCLAIMER}")]
    return [*out, *TEXTS.items()]


TEMPLATES += [x for x in _texts() if x not in TEMPLATES]


@dataclass
class Group:
    """Templates of like length: the half-window that holds any of them, and their signatures."""
    half: int
    members: list[int]
    mul: np.ndarray
    add: np.ndarray
    signatures: np.ndarray


class Index:
    """Templates by length class, with band settings from the least overlap a true window can have.

    A window is two half-windows, overlapping the next by one, so every run
    of up to a half lies in one window whole. A window that holds the asked
    share s of a template's n shingles shares at least s*n of at most
    (window + (1 - s) * n) with it; one-row bands miss with at most MISS at
    so many bands.
    """

    def __init__(self, templates: list[tuple[str, str]], k: int, similarity: float):
        self.similarity, self.k = similarity, k
        self.templates: list[tuple[str, set[str], int]] = []
        self.identifiers: set[int] = set()
        by_class: dict[tuple[int, int], list[int]] = {}
        hashes: list[np.ndarray] = []
        for name, text in templates:
            ws = words(text)
            if not ws:
                continue
            size = min(k, len(ws))
            by_class.setdefault((size, len(ws).bit_length()), []).append(len(self.templates))
            if text.startswith(_IDENTIFIER):
                self.identifiers.add(len(self.templates))
            self.templates.append((name, shingles(ws, k), size))
            hashes.append(np.unique(shingle_hashes(word_hashes(text), size)))
        rng = np.random.default_rng(7)
        self.groups: dict[int, list[Group]] = {}
        self.keys: dict[int, HashSet] = {}
        for (size, _), members in by_class.items():
            fewest = min(len(hashes[i]) for i in members)
            longest = max(len(self.templates[i][1]) + size - 1 for i in members)
            half = math.ceil(longest / similarity)
            least = similarity * fewest / (2 * half + (1 - similarity) * fewest)
            bands = math.ceil(math.log(MISS) / math.log(1 - least))
            mul = rng.integers(1, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            add = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
            g = Group(half, members, mul, add, np.stack([self.signature(hashes[i], mul, add) for i in members]))
            self.groups.setdefault(size, []).append(g)
        for size in self.groups:
            self.keys[size] = HashSet(np.concatenate([hashes[i] for g in self.groups[size] for i in g.members]))

    @staticmethod
    def signature(h: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
        x = h[:, None] * mul[None, :] + add[None, :]
        return ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0)

    def candidates(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(template, first word, end word) of every window whose bands meet a template's.

        A window without any shingle of a template has none of their minima,
        so only the others are signed.
        """
        hashed = word_hashes(text)
        for size, groups in self.groups.items():
            h = shingle_hashes(hashed, size)
            at = self.keys[size].where(h)
            if not len(at):
                continue
            for g in groups:
                first = at // g.half
                for w in np.unique(np.concatenate([first, np.maximum(first - 1, 0)])).tolist():
                    lo, hi = w * g.half, (w + 2) * g.half
                    own = h[lo:max(lo + 1, hi - size + 1)]
                    same = (g.signatures == self.signature(own, g.mul, g.add)[None, :]).any(axis=1)
                    for m in np.flatnonzero(same).tolist():
                        yield g.members[m], lo, hi

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, containment, start, end) of the notices of a text, in code points, ends exclusive.

        Of overlapping findings the fullest stays, then the longest, then the first: versions of a
        licence differ by a word, so a weaker reading of the same words is not reported. Neutral
        names give way to any other.
        """
        if not text or not (todo := list(self.candidates(text))):
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        ws = [text[a:b].lower() for a, b in places]
        found = []
        for t, lo, hi in todo:
            name, want, size = self.templates[t]
            own = {}
            for i in range(lo, max(lo + 1, min(hi, len(ws)) - size + 1)):
                if (s := " ".join(ws[i:i + size])) in want:
                    own.setdefault(s, []).append(i)
            if len(own) >= self.similarity * len(want) - 1e-9:
                hits = [i for x in own.values() for i in x]
                # two copies of a short notice may share a window: the runs without a template-long gap
                hits.sort()
                runs = [[hits[0]]]
                for i in hits[1:]:
                    if i - runs[-1][-1] > max(1, len(want)) or (len(want) == 1 and i > runs[-1][-1]):
                        runs.append([])
                    runs[-1].append(i)
                for run in runs:
                    if t in self.identifiers and _GOES_ON.match(text, places[run[-1] + size - 1][1]):
                        continue
                    share = len({" ".join(ws[i:i + size]) for i in run}) / len(want)
                    if share >= self.similarity - 1e-9:
                        found.append((name, share, places[run[0]][0], places[run[-1] + size - 1][1]))
        kept: list[tuple[str, float, int, int]] = []
        for x in sorted(set(found), key=lambda x: (x[0] in NEUTRAL, -x[1], x[2] - x[3], x[2])):
            if not any(y[2] < x[3] and x[2] < y[3] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: (x[2], x[0]))


def scan_documents(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = 5, similarity: float = 0.8,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence notice found: id, license, containment, start, end.

    A notice is a place that holds at least ``similarity`` of a template's
    distinct k-word shingles (a shorter template is one shingle); words are
    those of the decontamination operator. An identifier (SPDX) must be whole:
    ``MIT`` is not found in ``MIT-0``. Null and empty texts hold none.
    Repeated rows give repeated findings. Other columns are not read.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(templates, k, similarity)
        for texts in batches:
            yield pd.Series([[{"license": n, "containment": c, "start": s, "end": e} for n, c, s, e in index.scan(t)]
                             for t in texts], dtype=object)

    found = F.pandas_udf(run, "array<struct<license:string,containment:double,start:int,end:int>>")
    return docs.select(F.col(id_col).alias("_id"), F.explode(found(F.col(text_col))).alias("_f")).select(
        F.col("_id").alias(id_col), "_f.*")
