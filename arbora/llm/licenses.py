"""Licence scans with a positional index of rare template words.

1. Document frequencies of the templates' words are counted over all documents; a word's weight is its IDF.
2. Of each template the places of highest IDF are indexed, as many as leave the others together below ``coverage``: no
   alignment that reaches it can do without them. The file's licence words of these look up their postings, which are intersected by
   relative position (place in the file minus place in the template): a candidate alignment is one at which the words that meet
   there, and those not indexed, can reach the coverage together, however many notices a file holds.
3. At a candidate alignment the template is compared word by word; the licence is labelled if the share of equal words,
   weighted by IDF, reaches ``coverage`` and every mandatory phrase stands consecutively within the aligned region.

Base phrases are labelled wherever their words stand consecutively, whatever the templates say.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are judged each on its own;
an empty table gives an empty result; other columns are ignored; of a licence that stands several times the alignment of
highest coverage counts, of equal ones the first.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import batches, id_text, table
from arbora.llm._text import ALNUM, Words, words_of

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by which files commonly name a licence, with the phrases that must be there.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license 2 0"]),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["general public license version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    ("gpl-2.0-or-later", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["free software foundation", "version 2 of the license", "any later version"]),
    ("gpl-3.0-or-later", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["free software foundation", "version 3 of the license", "any later version"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement", ["advertising materials"]),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", ["bsd style license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee", "and or distribute"]),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED", ["with or without fee is hereby granted the software"]),
    ("lgpl-2.1-or-later", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ["lesser general public license", "version 2 1 of the license"]),
    ("lgpl-3.0-or-later", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["lesser general public license", "version 3 of the license"]),
    ("agpl-3.0-or-later", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["affero general public license"]),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ["public domain worldwide"]),
    ("cc0-1.0", "licensed under CC0 1.0 Universal", ["cc0 1 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ["you want to public license"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["will the authors be held liable"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("epl-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", ["eclipse public license v1 0"]),
    ("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License", ["common development and distribution license"]),
    ("artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0)", ["artistic license 2 0"]),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ["sil open font license"]),
    ("psf-2.0", "Licensed under the Python Software Foundation License Version 2", ["python software foundation license"]),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial 4 0"]),
    ("cc-by-nd-4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["attribution noderivatives 4 0"]),
    ("ms-pl", "This source is subject to the Microsoft Public License", ["microsoft public license"]),
    ("mit", "The MIT License (MIT)", ["mit license mit"]),
    ("mit", "MIT License Copyright (c)", ["mit license copyright"]),
    ("mit", "licensed under the terms of the MIT license", ["terms of the mit license"]),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", ["of merchantability fitness for a particular purpose and noninfringement"]),
    ("apache-2.0", "Apache License Version 2.0, January 2004", ["apache license version 2 0"]),
    ("apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ["terms and conditions for use reproduction and distribution"]),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3", ["gnu general public license version 3"]),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", ["affero general public license version 3"]),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", ["lesser general public license version 2 1"]),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", ["lesser general public license version 3"]),
    ("gpl", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", ["verbatim copies of this license document"]),
    ("mpl-2.0", "Mozilla Public License Version 2.0", ["mozilla public license version 2 0"]),
    ("bsd-3-clause", "BSD 3-Clause License", ["bsd 3 clause license"]),
    ("bsd-2-clause", "BSD 2-Clause License", ["bsd 2 clause license"]),
    ("isc", "ISC License", ["isc license"]),
    ("epl-2.0", "Eclipse Public License - v 2.0", ["eclipse public license v 2 0"]),
]

# Identifiers of the SPDX list that tags name, with their labels here; a rule makes their templates.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache-2.0", "GPL-2.0-only": "gpl-2.0", "GPL-3.0-only": "gpl-3.0", "GPL-2.0-or-later": "gpl-2.0-or-later", "GPL-3.0-or-later": "gpl-3.0-or-later",
    "LGPL-2.1-only": "lgpl-2.1", "LGPL-2.1-or-later": "lgpl-2.1-or-later", "LGPL-3.0-only": "lgpl-3.0", "LGPL-3.0-or-later": "lgpl-3.0-or-later", "AGPL-3.0-only": "agpl-3.0", "AGPL-3.0-or-later": "agpl-3.0-or-later",
    "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "BSD-4-Clause": "bsd-4-clause", "0BSD": "0bsd", "ISC": "isc", "MPL-2.0": "mpl-2.0", "EPL-1.0": "epl-1.0", "EPL-2.0": "epl-2.0", "CC0-1.0": "cc0-1.0",
    "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0", "CC-BY-NC-4.0": "cc-by-nc-4.0", "Unlicense": "unlicense", "Zlib": "zlib", "BSL-1.0": "bsl-1.0", "OFL-1.1": "ofl-1.1",
}
TEMPLATES += [(label, f"SPDX-License-Identifier: {name}", [f"spdx license identifier {name}"]) for name, label in SPDX.items()]


def _split(text: str) -> list[bytes]:
    w = words_of(pa.array([text]), ALNUM, lower=True)
    return [w.word(i) for i in range(len(w.starts))]


def _hashes(words: list[bytes]) -> list[int]:
    return words_of(pa.array([b" ".join(words).decode()]), ALNUM, lower=True).hashes.tolist() if words else []


class LicenseIndex:
    def __init__(self, templates=TEMPLATES, base=BASE, coverage: float = 0.8):
        self.coverage = coverage
        self.templates = [(label, _split(text), [_split(p) for p in phrases]) for label, text, phrases in templates]
        self.base = [(_split(phrase), _hashes(_split(phrase)), label) for phrase, label in base.items()]
        self.hashes = [_hashes(words) for _, words, _ in self.templates]
        self.vocabulary = np.array(sorted({h for hs in self.hashes for h in hs}), np.uint64)
        self.idf = dict.fromkeys(self.vocabulary.tolist(), 1.0)
        self._post()

    def weigh(self, n_docs: int, frequency: dict[int, int]) -> None:
        self.idf = {h: math.log((n_docs + 1) / (frequency.get(h, 0) + 0.5)) + 1e-6 for h in self.idf}
        self._post()

    def _post(self) -> None:
        """Index each template's places of highest IDF, until the rest cannot reach the coverage alone."""
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []  # what the indexed words of an alignment have to weigh together
        for t, hs in enumerate(self.hashes):
            rest = total = sum(self.idf[h] for h in hs)
            for q in sorted(range(len(hs)), key=lambda q: (-self.idf[hs[q]], hs[q], q)):
                if rest < (self.coverage - 1e-9) * total:
                    break
                self.postings[hs[q]].append((t, q))
                rest -= self.idf[hs[q]]
            self.needed.append((self.coverage - 1e-9) * total - rest)
        self.indexed = np.array(sorted(self.postings), np.uint64)

    def places(self, words: Words) -> np.ndarray:
        """Word places of licence words in a batch."""
        seen = np.zeros(1 << 16, bool)
        seen[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        some = np.flatnonzero(seen[(words.hashes >> np.uint64(48)).astype(np.int64)])
        return some[np.isin(words.hashes[some], self.vocabulary)]

    def align(self, places: list[int], hashes: list[int], base: int, words: Words) -> dict[str, tuple[float, int]]:
        """Labels of one document with their coverage and first word (from 0), best alignment each."""
        met: dict[tuple[int, int], float] = defaultdict(float)
        for p, h in zip(places, hashes):
            for t, q in self.postings.get(h, ()):
                met[t, p - q] += self.idf[h]
        candidates = [(t, shift) for (t, shift), weight in met.items() if weight >= self.needed[t]]
        at = dict(zip(places, hashes))
        found: dict[str, tuple[float, int]] = {}
        for t, shift in candidates:
            label, own, phrases = self.templates[t]
            hs = self.hashes[t]
            total = sum(self.idf[h] for h in hs)
            same = sum(self.idf[h] for q, h in enumerate(hs) if at.get(shift + q) == h)
            if same < self.coverage * total:
                continue
            low, high = max(shift, 0), shift + len(own)
            region = [words.word(base + x) for x in range(low, min(high + 8, int(words.offsets[np.searchsorted(words.offsets, base, "right")]) - base))]
            if all(any(region[i : i + len(p)] == p for i in range(len(region) - len(p) + 1)) for p in phrases):
                found[label] = max(found.get(label, (0.0, 0)), (same / total, -low))
        return {k: (c, -low) for k, (c, low) in found.items()}

    def scan(self, t: pa.Table) -> pa.RecordBatch:
        words = words_of(t.column("text"), ALNUM, lower=True)
        n = words.n_docs
        n_base, first, last, base_labels = np.zeros(n, np.int64), [None] * n, [None] * n, [set() for _ in range(n)]
        doc_of = lambda p: np.searchsorted(words.offsets, p, "right") - 1
        for own, hs, label in self.base:
            starts = np.flatnonzero(words.hashes == np.uint64(hs[0]))
            for p, d in zip(starts.tolist(), doc_of(starts).tolist()):
                if p + len(own) <= words.offsets[d + 1] and all(words.word(p + k) == w for k, w in enumerate(own)):
                    k = p - int(words.offsets[d])
                    n_base[d] += 1
                    first[d] = k if first[d] is None else min(first[d], k)
                    last[d] = k if last[d] is None else max(last[d], k)
                    base_labels[d].add(label)
        labels, score = [set(x) for x in base_labels], [0.5 if x else 0.0 for x in base_labels]
        places = self.places(words)
        docs = doc_of(places)
        # Only documents with an indexed word have a candidate.
        open_ = np.zeros(n, bool)
        open_[docs[np.isin(words.hashes[places], self.indexed)]] = True
        places, docs = places[open_[docs]], docs[open_[docs]]
        edges = np.flatnonzero(np.diff(docs, prepend=-1, append=n))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d = int(docs[a])
            base = int(words.offsets[d])
            found = self.align((places[a:b] - base).tolist(), words.hashes[places[a:b]].tolist(), base, words)
            labels[d] |= set(found)
            score[d] = max([score[d], *(min(1.0, c) for c, _ in found.values())])
        joined = lambda sets: pa.array([",".join(sorted(x)) for x in sets])
        cols = [t.column("doc_id").combine_chunks(), pa.array(words.counts().astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), joined(base_labels), joined(labels), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None) -> DataFrame:
    docs = id_text(docs)
    index = index or LicenseIndex()
    vocabulary = index.vocabulary

    def frequencies(iterator):
        for t in batches(iterator):
            words = words_of(t.column("text"), ALNUM, lower=True)
            places = index.places(words)
            doc = np.searchsorted(words.offsets, places, "right") - 1
            pairs = np.unique(np.stack([doc, np.searchsorted(vocabulary, words.hashes[places])]), axis=1) if len(places) else np.zeros((2, 0), np.int64)
            n = np.bincount(pairs[1], minlength=len(vocabulary))
            keys = np.append(np.arange(len(vocabulary)), -1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.append(n, words.n_docs).astype(np.int64))], names=["word", "n"])

    # One row for each template word, however many documents there are.
    counted = {r["word"]: r["n"] for r in docs.mapInArrow(frequencies, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    index.weigh(counted.pop(-1, 0), {int(vocabulary[k]): n for k, n in counted.items()})

    def scan(iterator):
        for t in batches(iterator):
            yield index.scan(t)

    return docs.mapInArrow(scan, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
