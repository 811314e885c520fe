"""License scans: exact set-similarity join of text blocks and license templates (operator 13).

Base labels come from three phrases, counted wherever their words stand consecutively. The method's labels come from
TEMPLATES, a stated set of license notices: a block of text has a template's label if it holds at least THRESHOLD of the
template's distinct words. Blocks are windows of 2s words that begin every s words of a document, for s the smallest
power of two of 1.25 times the template's words or more, so a notice of up to s words lies whole in some block however
it is broken over lines.

The join is exact and never compares all blocks with all templates. Words are ordered by their frequency in all
documents (counted in a first pass, one row for each word of a template and task), rare ones first; words of no template
stand before all others. Of a template with n words that must share `need`, its n - need + 1 rarest words are its prefix,
and a block without any of them is never looked at. A block is dropped where its words are fewer than `need` (length)
or where too few words follow the first common one on either side (position); what is left is counted in full.

A-Z are lower-cased; words are runs of letters, digits and non-ASCII bytes. Null texts are empty. Every row is a document
of its own whatever its doc_id. Templates are broadcast in the tasks' closure: at most MAX_TEMPLATE_BYTES together, or a
ValueError. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .decontam import _IS_WORD, _NORMAL, _hashes, normal_words

THRESHOLD = 0.8
MAX_TEMPLATE_BYTES = 1 << 20
# Phrases and their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Fixed values: (label, wording) of public license notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
]


def need(n: int, threshold: float = THRESHOLD) -> int:
    """Words that must be shared with a template of n distinct ones."""
    return max(math.ceil(threshold * n - 1e-9), 1)


def stride(n_words: int) -> int:
    """Half a block's length for a template of so many words, repeats included."""
    return 1 << max(math.ceil(1.25 * n_words) - 1, 0).bit_length()


@dataclass
class Index:
    """Templates as sorted frequency ranks, by stride, with their prefixes inverted."""

    words: list[bytes]
    hashes: np.ndarray  # sorted
    rank: np.ndarray  # of each word, by its place in `hashes`; 0 is the rarest
    sizes: list[int]
    labels: list[str]
    needs: list[int]
    ranks: list[np.ndarray] = field(default_factory=list)
    prefixes: dict[int, dict[int, list[int]]] = field(default_factory=dict)  # stride -> rank -> templates


def vocabulary(templates: list[tuple[str, str]]) -> tuple[list[bytes], np.ndarray]:
    """The templates' distinct words in the order of their hashes, and the hashes."""
    if sum(len(t.encode()) for _, t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_BYTES} bytes together")
    words = sorted({w for _, t in templates for w in normal_words(t)})
    if not words:
        return [], np.zeros(0, np.uint64)
    h = _hashes(words)
    order = np.argsort(h)
    return [words[i] for i in order.tolist()], h[order]


def index(templates: list[tuple[str, str]], counts: dict[int, int], threshold: float = THRESHOLD) -> Index:
    """counts: occurrences in the corpus by the word's place in the vocabulary."""
    words, hashes = vocabulary(templates)
    place = {w: i for i, w in enumerate(words)}
    order = sorted(range(len(words)), key=lambda i: (counts.get(i, 0), words[i]))
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(len(words))
    split = [normal_words(t) for _, t in templates]
    out = Index(words, hashes, rank, [len(set(ws)) for ws in split], [x for x, _ in templates], [need(len(set(ws)), threshold) for ws in split])
    for t, ws in enumerate(split):
        own = np.unique(rank[[place[w] for w in ws]]) if ws else np.zeros(0, np.int64)
        out.ranks.append(own)
        for r in own[: len(own) - out.needs[t] + 1].tolist():
            out.prefixes.setdefault(stride(len(ws)), {}).setdefault(r, []).append(t)
    return out


def _places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words, their starts, their ends, first word of each document)."""
    starts, ends, first = K.spans(_IS_WORD[raw], offsets)
    return K.span_hash(K.prefix_hash(_NORMAL[raw]), starts, ends), starts, ends, first


def _numbers(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the vocabulary, or -1."""
    if not len(sorted_hashes):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at, -1)


def frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """Occurrences of each template word in all documents."""
    _, hashes = vocabulary(templates)
    if not len(hashes):
        return {}

    def run(batches):
        count = np.zeros(len(hashes) + 1, np.int64)
        for b in batches:
            for _, _, raw, off in K.chunks(b.column(0)):
                count += np.bincount(_numbers(hashes, _places(raw, off)[0]) + 1, minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashes), dtype=np.int32)), pa.array(count[1:])], ["word", "n"])

    return {r.word: r.n for r in docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def matched_blocks(ix: Index, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, template, first word, end word, shared) of every block that meets a template's threshold."""
    out = []
    known = np.flatnonzero(ids >= 0)
    ranks = np.full(len(ids), -1)
    ranks[known] = ix.rank[ids[known]]
    doc = K.doc_of(first)
    for s, prefix in ix.prefixes.items():
        wanted = np.zeros(len(ix.words), bool)
        wanted[list(prefix)] = True
        at = known[wanted[ranks[known]]]
        if not len(at):
            continue
        d, p = doc[at], at - first[doc[at]]
        block = np.concatenate([p // s, p // s - 1])
        pairs = np.stack([np.concatenate([d, d]), block, np.concatenate([ranks[at], ranks[at]])], 1)[block >= 0]
        pairs = np.unique(pairs, axis=0)
        cuts = np.flatnonzero(np.any(pairs[1:, :2] != pairs[:-1, :2], axis=1)) + 1
        for group in np.split(pairs, cuts):
            k, b = int(group[0, 0]), int(group[0, 1])
            begin = int(first[k]) + b * s
            end = min(begin + 2 * s, int(first[k + 1]))
            own = np.unique(ranks[begin:end])
            own = own[own >= 0]
            met: dict[int, int] = {}  # template -> its rarest word that the block holds
            for r in group[:, 2].tolist():
                for t in prefix[r]:
                    met.setdefault(t, r)
            for t, r in met.items():
                ours, least = ix.ranks[t], ix.needs[t]
                if len(own) < least:
                    continue  # length
                i, j = int(np.searchsorted(ours, r)), int(np.searchsorted(own, r))
                if 1 + min(len(ours) - i - 1, len(own) - j - 1) < least:
                    continue  # position
                shared = len(np.intersect1d(ours, own, assume_unique=True))
                if shared >= least:
                    out.append((k, t, begin - int(first[k]), end - int(first[k]), shared))
    return out


def base_places(hashes: np.ndarray, first: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Places where each label's phrase begins, and document of each word."""
    out = {}
    for label, phrase in PHRASES.items():
        h = _hashes(phrase.encode().split())
        n = len(hashes) - len(h) + 1
        if n <= 0:
            out[label] = np.zeros(0, np.int64)
            continue
        ok = K.inside_docs(first, len(h), len(hashes))
        for i, x in enumerate(h):
            ok &= hashes[i : i + n] == x
        out[label] = np.flatnonzero(ok)
    return out, K.doc_of(first)


_MATCH = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, matches array<struct<label:string,template:int,first_word:long,end_word:long,start:long,end:long,containment:double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: words, places of the base phrases, and every block that meets a template, in words and bytes."""
    templates = TEMPLATES if templates is None else templates
    ix = index(templates, frequencies(docs, templates), threshold)
    names = list(PHRASES)

    def run(batches):
        for b in batches:
            for row, end, raw, off in K.chunks(b.column(1)):
                h, starts, ends, first = _places(raw, off)
                n = len(off) - 1
                base, doc = base_places(h, first)
                count, low, high, said = [0] * n, [None] * n, [None] * n, [""] * n
                hits: dict[int, list[tuple[int, str]]] = {}
                for label in names:
                    for at in base[label].tolist():
                        hits.setdefault(int(doc[at]), []).append((at - int(first[doc[at]]), label))
                for d, found in hits.items():
                    count[d], low[d], high[d], said[d] = len(found), min(found)[0], max(found)[0], ",".join(sorted({x for _, x in found}))
                matches: list[list[dict]] = [[] for _ in range(n)]
                for d, t, w, stop, shared in matched_blocks(ix, _numbers(ix.hashes, h), first):
                    a, z = int(first[d]) + w, int(first[d]) + stop - 1
                    matches[d].append({"label": ix.labels[t], "template": t, "first_word": w, "end_word": stop, "start": int(starts[a] - off[d]), "end": int(ends[z] - off[d]), "containment": shared / ix.sizes[t]})
                cols = [b.column(0).slice(row, end - row), pa.array(np.diff(first).astype(np.int64)), *(pa.array(x, pa.int64()) for x in (count, low, high)), pa.array(said, pa.string()), pa.array(matches, pa.list_(_MATCH))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def labelled(found: DataFrame) -> DataFrame:
    """Adds labels, base ones and the method's, and score: the largest containment found, 1 where a phrase stands, else 0."""
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.transform("matches", lambda m: m["label"]))), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.withColumn("labels", labels).withColumn("score", F.when(F.col("n_base") > 0, 1.0).otherwise(best))
