"""License notices in whole texts, found by a positional index of rare words.

Templates are license notices. An index holds for each of their words the templates and places that have it. A
word's weight is its inverse document frequency over the whole corpus, so what is rare depends on the documents.
For each file and template the ANCHORS rarest words of the template that the file has are looked up; each place
in the file, less the word's place in the template, is where the template would begin. Where enough different
anchors agree on a beginning, within SLACK words, the template is verified: its mandatory phrases must stand there
word for word, and the weight of its words found at their places gives the score, at least COVER.

A template whose words in the file weigh less than COVER in all can't be verified and is not looked up. The index
is as large as the templates; nothing else is held but one slice of texts a task. Plain phrases (BASE) are found
by the same words without weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.arrowtext import slices, word_hashes
from foliospark.llm.common import small_batches

ANCHORS = 6
SLACK = 8
COVER = 0.7

#: Phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices: a label, the text, and the phrases without which it does not hold.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("in compliance with the license", "www apache org licenses license 2 0")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "v 2 0")),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("proprietary", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited", ("proprietary and confidential",)),
)

#: Bytes that part words: all of ASCII but digits and letters.
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SPANS = "array<struct<label: string, start: long, end: long, score: double, base: boolean>>"


class Index:
    """Words of templates and phrases as small numbers, and where each template has them."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        split = lambda text: "".join(" " if _APART[ord(c)] else c for c in text.lower()).split()  # noqa: E731  templates are ASCII
        self.labels = [label for label, _, _ in templates]
        bodies = [split(text) for _, text, _ in templates]
        self.base_labels = [label for _, label in base]
        phrases = [split(p) for p, _ in base]
        must = [[split(p) for p in required] for _, _, required in templates]
        self.words = sorted({w for seq in (*bodies, *phrases, *(p for m in must for p in m)) for w in seq})
        number = {w: i for i, w in enumerate(self.words)}
        coded = lambda seq: np.array([number[w] for w in seq])
        self.bodies, self.phrases = [coded(b) for b in bodies], [coded(p) for p in phrases]
        self.must = [[coded(p) for p in m] for m in must]
        hashes, _ = word_hashes(pa.array(self.words), _APART)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.times = np.array([np.bincount(body, minlength=len(self.words)) for body in self.bodies]).T

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a slice of texts: the numbers of words of each text, the places of index words, and which they are.

        Places count all words of the slice on from 0.
        """
        hashes, at = word_hashes(column, _APART)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[near] == hashes)
        return at, places, self.order[near[places]]


def _run_of(places: np.ndarray, which: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the words of a phrase stand one behind the other."""
    starts = places[which == phrase[0]]
    for k, word in enumerate(phrase[1:], 1):
        if not len(starts):
            break
        own = places[which == word]
        i = np.searchsorted(own, starts + k)
        ok = i < len(own)
        ok[ok] = own[i[ok]] == starts[ok] + k
        starts = starts[ok]
    return starts


def _frequencies(index: Index):
    """Of each batch: in how many texts each index word stands; word -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(index.words), dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                at, places, which = index.hits(part.column("text"))
                row = np.searchsorted(at, places, side="right") - 1
                total += np.bincount(np.unique(row * len(index.words) + which) % len(index.words), minlength=len(index.words))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["word", "n"])

    return run


def weigh_words(docs: DataFrame, index: Index) -> np.ndarray:
    """Inverse document frequency of each index word over all texts, above 0. What the driver gets is as large as the index."""
    small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(_frequencies(index), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in found}
    return np.log1p(n.get(-1, 0) / np.array([n.get(w, 0) + 1 for w in range(len(index.words))])) + 1e-9


def aligned(index: Index, weights: np.ndarray, t: int, places: np.ndarray, which: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of each place of template t in one text, of its index words `which` at rising `places`."""
    body = index.bodies[t]
    present = np.intersect1d(which, body)
    anchors = present[np.lexsort((present, -weights[present]))][:ANCHORS]
    needed = max(2, -(-min(ANCHORS, len(np.unique(body))) // 2))
    if len(anchors) < needed:
        return []
    starts, words = [], []
    for word in anchors:  # the postings of the word, at every place where the text has it
        begin = (places[which == word][:, None] - np.flatnonzero(body == word)[None]).ravel()
        starts.append(begin)
        words.append(np.full(len(begin), word))
    starts, words = np.concatenate(starts), np.concatenate(words)
    order = np.argsort(starts, kind="stable")
    starts, words = starts[order], words[order]
    out, behind = [], -1
    # clusters of beginnings of which each is within SLACK of the one before it
    cuts = [0, *(np.flatnonzero(np.diff(starts) > SLACK) + 1).tolist(), len(starts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if len(np.unique(words[a:b])) < needed:
            continue
        begins, agreeing = np.unique(starts[a:b], return_counts=True)
        for begin in begins[agreeing >= min(2, agreeing.max())]:
            if begin < behind:
                continue  # within the notice found last
            low, high = np.searchsorted(places, [begin - SLACK, begin + len(body) + SLACK])
            near, what = places[low:high], which[low:high]
            if any(not len(_run_of(near, what, p)) for p in index.must[t]):
                continue
            stands = {}  # place in the template: the nearest place of its word
            for q, word in enumerate(body):
                at = near[what == word]
                if len(at) and (gap := np.abs(at - begin - q)).min() <= SLACK:
                    stands[q] = int(at[gap.argmin()])
            score = float(weights[body[list(stands)]].sum() / weights[body].sum())
            if score >= COVER:
                behind = max(stands.values()) + 1
                out.append((min(stands.values()), behind, score))
    return out


def _settled(spans: list[dict]) -> list[dict]:
    """Spans in order; of overlapping notices of one label the one with the best score (the first of equal ones)."""
    kept: list[dict] = []
    last: dict[str, int] = {}
    for span in sorted(spans, key=lambda s: (s["start"], s["end"], s["label"], not s["base"])):
        at = last.get(span["label"])
        if span["base"] or at is None or kept[at]["end"] <= span["start"]:
            kept.append(span)
            if not span["base"]:
                last[span["label"]] = len(kept) - 1
        elif kept[at]["score"] < span["score"]:
            kept[at] = span
    return sorted(kept, key=lambda s: (s["start"], s["end"], s["label"], not s["base"]))


def _scanned(index: Index, weights: np.ndarray):
    mass = index.times * weights[:, None]
    least = COVER * mass.sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, places, which = index.hits(part.column("text"))
                row = np.searchsorted(at, places, side="right") - 1
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                add = lambda r, label, a, b, score, base: spans[r].append({"label": label, "start": int(a - at[r]), "end": int(b - at[r]), "score": score, "base": base})
                for label, phrase in zip(index.base_labels, index.phrases, strict=True):
                    for p in _run_of(places, which, phrase):
                        r = int(np.searchsorted(at, p, side="right")) - 1
                        if p + len(phrase) <= at[r + 1]:
                            add(r, label, p, p + len(phrase), 1.0, True)
                has = np.zeros((part.num_rows, len(index.words)), dtype=bool)
                has[row, which] = True
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                for r, t in zip(*np.nonzero(has @ mass >= least), strict=True):
                    own = slice(ends[r], ends[r + 1])
                    for a, b, score in aligned(index, weights, t, places[own], which[own]):
                        add(r, index.labels[t], a, b, score, False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array([_settled(x) for x in spans], KIND)], ["doc_id", "n_words", "spans"]
                )

    return run


KIND = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc_id, n_words, spans) of every row of docs: where license notices stand in the whole text.

    Words are runs of digits, letters and all that is not ASCII, A-Z folded. A span has a label, its start and end
    in words (end exclusive), a score up to 1 and whether it is a plain phrase of `base`. A null text is an empty one; texts
    without words have no spans; a null or repeated doc_id changes nothing, each row is judged by itself. Spans
    come by start, end and label; of notices of one label that overlap the best one stays. Templates are ASCII and have two different words or more.
    """
    index = Index(templates, base)
    weights = weigh_words(docs, index)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanned(index, weights), f"doc_id long, n_words long, spans {SPANS}")
