"""Licence notices in texts: MinHash bands over windows retrieve, exact containment verifies.

Texts become shingles of five words (lower-cased, punctuation dropped). The
shingles are cut into windows that overlap by three quarters, in sizes of
powers of two; a template is looked for in windows of two to four times its
own size. An occurrence that keeps 80 % of the template's shingles, stretched
by up to a quarter, lies whole in some window and has a Jaccard similarity of
0.19 or more with it; 64 bands of one MinHash each then meet with a
probability of at least 1 - (1 - 0.19)**64 > 0.999998.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
LEAST = 0.8
BANDS = 64
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

#: Wordings to look for: short notices, file headers, and the bodies of short licences. Licences themselves prescribe them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause-body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gnu-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib-body": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "unlicense-body": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost-1.0-header": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
_VERSION = re.compile(r"-[0-9]+(?:\.[0-9]+)*")


def family(name: str) -> str:
    """A template's name without its version."""
    return _VERSION.sub("", name)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all five-word shingles in order; none for fewer words."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").lower())
    if len(words) < WORDS:
        return np.zeros(0, dtype=np.uint64)
    line, at, ends = " ".join(words).encode(), 0, []
    starts = []
    for w in words:
        n = len(w.encode()) if not w.isascii() else len(w)
        starts.append(at)
        ends.append(at + n)
        at += n + 1
    return np.fromiter((xxh64_intdigest(line[s:e]) for s, e in zip(starts, ends[WORDS - 1 :], strict=False)), dtype=np.uint64, count=len(words) - WORDS + 1)


@functools.lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240501)
    return draw.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def minhashes(window: np.ndarray) -> np.ndarray:
    """The least value of each hash function in a window."""
    a, b = _factors()
    h = window[None, :] * a[:, None] + b[:, None]
    return (h ^ (h >> np.uint64(29))).min(axis=1)


def window_class(n: int) -> int:
    """log2 of the window size in which templates of ``n`` shingles are looked for: twice to four times n."""
    return max(2, int(np.ceil(np.log2(n))) + 1)


class _Templates:
    def __init__(self, templates: dict[str, str]) -> None:
        self.sets, self.bands = {}, defaultdict(lambda: defaultdict(set))
        for name, text in templates.items():
            own = np.unique(shingles(text))
            if not len(own):
                raise ValueError(f"template {name} has fewer than {WORDS} words")
            self.sets[name] = own
            for k, v in enumerate(minhashes(own).tolist()):
                self.bands[window_class(len(own))][k, v].add(name)
        self.known = np.unique(np.concatenate(list(self.sets.values())))

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """``(template, first shingle, shingles in the window, containment)`` of the best window of each template found."""
        own, best = shingles(text), {}
        # a window without any template's shingle shares no least value with one
        at_known = np.flatnonzero(np.isin(own, self.known))
        if not len(at_known):
            return []
        for c, bands in self.bands.items():
            size, step = 1 << c, 1 << (c - 2)
            near = np.unique((at_known[:, None] // step - np.arange(4)[None, :]).ravel())  # a window is four steps long
            for at in (near[near >= 0] * step).tolist():
                window = own[at : at + size]
                for name in {n for key in enumerate(minhashes(window).tolist()) for n in bands.get(key, ())}:
                    best.setdefault(name, {})[at] = self.containment(name, window)
        out = []
        for name, seen in best.items():
            at = min(seen, key=lambda w: (-seen[w], w))
            if seen[at] >= LEAST:
                out.append((name, at, min(1 << window_class(len(self.sets[name])), len(own) - at), seen[at]))
        return sorted(h for h in out if not any(_better(o, h) for o in out))

    def containment(self, name: str, window: np.ndarray) -> float:
        return float(np.isin(self.sets[name], window).sum() / len(self.sets[name]))


def _better(other: tuple, hit: tuple) -> bool:
    """Whether another version of the same licence fits the same place better."""
    apart = other[1] + other[2] <= hit[1] or hit[1] + hit[2] <= other[1]
    return other[0] != hit[0] and family(other[0]) == family(hit[0]) and not apart and (-other[3], other[0]) < (-hit[3], hit[0])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, first_shingle, window_shingles, containment)``, one row per text and template contained to 80 % or more.

    Whole texts are scanned. The window is the first of those with the
    greatest containment; where windows of versions of one licence overlap,
    the version contained most stays. Texts that are null or have fewer than five words
    match nothing. Repeated rows give repeated results; other columns are not
    read. The templates are a parameter and go to every task.
    """
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _Templates(chosen)
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch["id"], batch["text"], strict=True) for hit in table.scan(t)]
            yield pd.DataFrame(rows, columns=["id", "license", "first_shingle", "window_shingles", "containment"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInPandas(run, f"id {kind}, license string, first_shingle long, window_shingles long, containment double")
    return out.withColumnRenamed("id", id_col)
