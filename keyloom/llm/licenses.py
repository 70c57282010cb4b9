"""License scans: MinHash bands over overlapping windows, then exact containment.

A text is folded to lower-case words and hashed as five-word shingles. For each length of template, windows
of that many words overlap by seven eighths, so some window is within a sixteenth of any
occurrence. A window's MinHash of BANDS bands with ROWS rows retrieves the templates that share a band: a window
that holds four fifths of a template's shingles has a similarity of 0.6 at least, and
1 - (1 - 0.6**2)**16 > 0.999 of those collide. Retrieved templates are checked exactly: the
share of the template's shingles in the window, widened by one step on both sides, is 0.8 or more.
Windows that overlap are one run, which is cut into occurrences: one ends where a shingle comes again after
0.8 of the template has been met, and reaches from its first template shingle to its last.

The templates are broadcast: a fixed table (MAX_TEMPLATES at most).

Defined cases: templates of fewer than five words are refused, as none of their shingles would be in a longer text;
null and short texts have no match; what is left of a run after its last
occurrence is none; repeated rows are scanned each; an empty table gives an empty result; further columns are
carried along untouched.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, pack, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
CONTAINED = 0.8
BANDS, ROWS = 16, 2
OVERLAP = 8
MAX_TEMPLATES = 10_000
#: Templates that hold so much of each other are rivals: where they overlap, the better match stays.
RIVALS = 0.5
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
MULTIPLY = np.array([xxhash.xxh64_intdigest(b"m%d" % i) | 1 for i in range(BANDS * ROWS)], np.uint64)
ADD = np.array([xxhash.xxh64_intdigest(b"a%d" % i) for i in range(BANDS * ROWS)], np.uint64)

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_END = "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
FREE = "is free software{} you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
CC = "This work is licensed under a Creative Commons {} 4.0 International License."
CC_KINDS = {"by-sa": "Attribution-ShareAlike", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

#: Public notices of well-known licenses.
TEMPLATES = {
    "mit-short": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-2-clause": f"{BSD} {BSD_END}",
    "bsd-3-clause": f"{BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_END}",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",  # what all BSD licenses begin with
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "gpl-2.0": "This program " + FREE.format(";", "", ";", "2"),
    "lgpl-2.1": "This library " + FREE.format(";", "Lesser", ";", "2.1"),
    "lgpl-3.0": "This program " + FREE.format(":", "Lesser", ",", "3"),
    "agpl-3.0": "This program " + FREE.format(":", "Affero", ",", "3"),
    "gfdl-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    **{f"cc-{k}-4.0-notice": CC.format(v) for k, v in CC_KINDS.items()},
    "cc-by-nc-4.0-notice": CC.format("Attribution-NonCommercial"),
    **{f"cc-{k}-4.0": f"Licensed under CC {k.upper()} 4.0." for k in CC_KINDS},
    "cc0-1.0": "has waived all copyright and related or neighboring rights to",
    "epl-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """One hash per run of k words; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - k + 1, 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def window_minima(x: np.ndarray, width: int, step: int) -> np.ndarray:
    """Minima over x[s : s + width] for s = 0, step, ... and one window at the end; width is a multiple of step."""
    n = len(x)
    if n <= width:
        return x.min(axis=0, keepdims=True)
    blocks = np.minimum.reduceat(x, np.arange(0, n, step), axis=0)
    per = width // step
    return np.minimum.reduce([blocks[j : len(blocks) - per + 1 + j] for j in range(per)])


class Scanner:
    def __init__(self, templates: Mapping[str, str]):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"over {MAX_TEMPLATES} templates")
        if short := [name for name, t in templates.items() if len(words_of(t.encode())) < SHINGLE]:
            raise ValueError(f"a template needs {SHINGLE} words at least: {short}")
        self.shingles = {name: np.unique(shingle_hashes(words_of(t.encode()))) for name, t in templates.items()}
        self.classes: dict[int, dict[int, list[str]]] = {}
        self.keys: dict[int, np.ndarray] = {}
        for name, s in self.shingles.items():
            step = max(1, len(s) // OVERLAP)
            width = -(-len(s) // step) * step
            bands = self.classes.setdefault(width, {})
            for key in self.band_keys(self.signed(s).min(axis=0, keepdims=True)).ravel():
                bands.setdefault(int(key), []).append(name)
        for width, bands in self.classes.items():
            self.keys[width] = np.array(sorted(bands), np.uint64)
        self.rivals: dict[str, set[str]] = {name: set() for name in templates}
        holders: dict[int, list[str]] = {}
        for name, s in self.shingles.items():
            for x in s.tolist():
                holders.setdefault(x, []).append(name)
        for name, s in self.shingles.items():
            for other, n in Counter(o for x in s.tolist() for o in holders[x]).items():
                if other != name and n >= RIVALS * max(len(s), len(self.shingles[other])):
                    self.rivals[name].add(other)
        self.all = np.unique(np.concatenate(list(self.shingles.values())))
        self.low = np.zeros(1 << 16, bool)
        self.low[self.all & np.uint64(0xFFFF)] = True

    def may_collide(self, h: np.ndarray) -> bool:
        """Equal minima come from an equal shingle: a text without any shingle of a template shares no band."""
        maybe = h[self.low[h & np.uint64(0xFFFF)]]
        return bool(len(maybe)) and bool(np.isin(maybe, self.all).any())

    @staticmethod
    def signed(h: np.ndarray) -> np.ndarray:
        x = h[:, None] * MULTIPLY + ADD
        return x ^ (x >> np.uint64(31))

    @staticmethod
    def band_keys(minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(len(minima), BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
        for r in range(ROWS):
            key = (key ^ m[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        return key

    def scan(self, raw: bytes | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, word after the last, containment) of each occurrence, in order."""
        h = shingle_hashes(words_of(raw))
        if not self.may_collide(h):
            return []
        found: dict[tuple[str, int], int] = {}
        for at in range(0, len(h), 1 << 14):
            for width, bands in self.classes.items():
                step = next(s for s in (max(1, width // OVERLAP), 1) if width % s == 0)
                part = h[at : at + (1 << 14) + width]
                keys = self.band_keys(window_minima(self.signed(part), width, step))
                for w in np.flatnonzero(np.isin(keys, self.keys[width]).any(axis=1)):
                    a = at + int(w) * step
                    lo, hi = max(0, a - step), min(len(h), a + width + step)
                    for name in {x for k in keys[w] for x in bands.get(int(k), ())}:
                        if float(np.isin(self.shingles[name], h[lo:hi]).mean()) >= CONTAINED:
                            found[name, lo] = max(hi, found.get((name, lo), 0))
        runs: list[list] = []
        for (name, a), b in sorted(found.items()):
            if runs and runs[-1][0] == name and a < runs[-1][2]:
                runs[-1][2] = max(b, runs[-1][2])
            else:
                runs.append([name, a, b])
        each = [x for run in runs for x in self.occurrences(h, *run)]
        by_name: dict[str, list] = {}
        for x in each:  # those of a name are in order and apart
            by_name.setdefault(x[0], []).append(x)

        def beaten(x: tuple) -> bool:
            for other in self.rivals[x[0]] & by_name.keys():
                own = by_name[other]
                for y in reversed(own[: bisect_left(own, x[2], key=lambda y: y[1])]):
                    if y[2] <= x[1]:
                        break
                    if y[3] > x[3]:
                        return True
            return False

        best = [x for x in each if not beaten(x)]
        return sorted(best, key=lambda x: (x[1], x[0]))

    def occurrences(self, h: np.ndarray, name: str, a: int, b: int) -> list[tuple[str, int, int, float]]:
        out: list[tuple[str, int, int, float]] = []
        met: set[int] = set()
        first = last = a
        whole = len(self.shingles[name])
        for at in (a + np.flatnonzero(np.isin(h[a:b], self.shingles[name]))).tolist():
            x = int(h[at])
            if x in met and len(met) >= CONTAINED * whole:
                out.append((name, first, last + SHINGLE, len(met) / whole))
                met = set()
            if not met:
                first = at
            met.add(x)
            last = at
        if len(met) >= CONTAINED * whole:
            out.append((name, first, last + SHINGLE, len(met) / whole))
        return out


def scanner(shared):
    @F.pandas_udf("array<struct<license:string,first:long,last:long,containment:double>>")
    def scan(raw: pd.Series) -> pd.Series:
        held = shared.value
        if "scanner" not in held:  # built once in a worker, and kept with the templates
            held["scanner"] = Scanner(held["templates"])
        s = held["scanner"]
        return pd.Series([[{"license": n, "first": a, "last": b, "containment": c} for n, a, b, c in s.scan(x)] for x in raw], dtype=object)

    return scan


def find_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, text: str = "text") -> DataFrame:
    """`row` (all columns of docs) and `found`, the occurrences with their word positions."""
    spark = docs.sparkSession
    lean_batches(spark)
    Scanner(templates or TEMPLATES)  # refuses what it cannot find, here and not in a task
    shared = spark.sparkContext.broadcast({"templates": dict(templates or TEMPLATES)})
    return pack(docs).withColumn("found", scanner(shared)(F.col("row")[text].cast("binary")))


def op9_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("found")["license"])), ",")
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size("found").cast("long").alias("n_matches"), names.alias("licenses"))
