"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of every text, every text as a whole, and for each template every run of as many consecutive words as it has, across lines, is a bag of
words; its cosine to each template (for a run, to the one) counts, with weights log(1 + n / df) of document
frequencies over all texts. So notices are found that are wrapped over lines, or lie inside a long one, or inside a full licence text. A run has to have
all version numbers of its template, and one word that no other licence's templates have, if there are such, and none of OTHERS. Runs are bounded by prefix sums first, and counted only where the bound reaches ``least``. A file's own licence is its best template, if the cosine reaches ``least``. Files
without one inherit: files named like licence files declare the licence of their directory, each path joins all its ancestor directories, and the
deepest one that declares a licence gives it.

Only words of templates can add to a cosine, so document frequencies are kept for these alone, a bounded vocabulary; all other
words of a line count in its norm, as words that occur once.

Defined cases: a null text is empty and has no own licence; a null path has no ancestors. Ties go to the first template by name; among several
licence files of a directory the best cosine counts, then the first path. Rows that repeat a file are scanned each by itself. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: Usual notices of some licences.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
#: Heads of long licence texts, which are compared with runs only.
HEADS = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
}
#: Words that make another licence of a run that is otherwise alike, if they are in it or next to it, or for heads as near as a head is long.
OTHERS = frozenset({"lesser", "affero", "sa", "sharealike", "nd", "noderivs", "noderivatives"})
LEAST = 0.75
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
_WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """Cosines of bags of words to all templates at once."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[str, int], n: int, heads: dict[str, tuple[str, ...]] = HEADS):
        pairs = [(name, t) for some in (templates, heads) for name, texts in sorted(some.items()) for t in texts]
        self.names, bags = [name for name, _ in pairs], [Counter(words(t)) for _, t in pairs]
        self.lines = sum(map(len, templates.values()))  # the first ones, which lines and whole texts are compared with
        self.rare = math.log(1 + n)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        self.weight = np.array([math.log(1 + n / max(1, frequency.get(w, 1))) for w in self.vocabulary])
        m = np.zeros((len(bags), len(self.vocabulary)))
        for k, b in enumerate(bags):
            for w, c in b.items():
                m[k, self.vocabulary[w]] = c * self.weight[self.vocabulary[w]]
        self.unit = m / np.sqrt((m**2).sum(axis=1, keepdims=True))
        self.lengths = [sum(b.values()) for b in bags]
        licence = {name: {w for n, b in zip(self.names, bags) if n == name for w in b} for name in self.names}
        own = [set(b) - {w for name, ws in licence.items() if name != n for w in ws} for n, b in zip(self.names, bags)]
        self.own = [{self.vocabulary[w] for w in x if w.isalpha()} for x in own]
        self.versions = [{self.vocabulary[w] for w in b if w[0].isdigit()} for b in bags]
        #: What an occurrence of a word adds to the product with each template, and to the squared norm at least; the last row is that of other words.
        self.adds = np.vstack([(self.unit * self.weight).T, np.zeros(len(bags))])
        self.squares = np.append(self.weight, self.rare) ** 2

    def cosines(self, bag: Counter) -> np.ndarray:
        """To every template, without heads."""
        return self._cosines(bag)[: self.lines]

    def _cosines(self, bag: Counter) -> np.ndarray:
        """To every template and head. Words outside the vocabulary have the weight of words that occur once."""
        v = np.zeros(len(self.vocabulary))
        rest = 0
        for w, c in bag.items():
            if (k := self.vocabulary.get(w)) is None:
                rest += c * c
            else:
                v[k] = c * self.weight[k]
        norm = math.sqrt((v**2).sum() + rest * self.rare**2)
        return self.unit @ v / norm if norm else np.zeros(len(self.unit))

    def _runs(self, text: list[str], least: float) -> Iterator[tuple[int, float]]:
        """Templates and cosines of the runs that are as long as a template and reach ``least``."""
        at = np.array([self.vocabulary.get(w, -1) for w in text], np.int64)
        there = set(at.tolist())
        known = np.concatenate([[0], np.cumsum(at >= 0)])
        squares = np.concatenate([[0.0], np.cumsum(self.squares[at])])
        others = np.concatenate([[0], np.cumsum([w in OTHERS for w in text])])
        for k, n in enumerate(self.lengths):
            if n > len(text) or not self.versions[k] <= there or self.own[k] and not self.own[k] & there:
                continue
            start = np.arange(len(text) - n + 1)
            if self.own[k]:  # only around words that no other licence has
                own = np.concatenate([[0], np.cumsum(np.isin(at, list(self.own[k])))])
                start = start[own[start + n] > own[start]]
            for v in self.versions[k]:
                own = np.concatenate([[0], np.cumsum(at == v)])
                start = start[own[start + n] > own[start]]
            near = 1 if k < self.lines else n
            adds = np.concatenate([[0.0], np.cumsum(self.adds[at, k])])
            # A word that occurs c times adds c * c of its weight to the squared norm, so c at least.
            bound = (adds[start + n] - adds[start]) / np.sqrt(np.maximum(squares[start + n] - squares[start], 1e-9))
            good = (bound >= least - 1e-9) & (others[np.minimum(start + n + near, len(text))] == others[np.maximum(start - near, 0)]) & (known[start + n] > known[start])
            start, bound = start[good], bound[good]
            top = 0.0
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < top - 1e-9:
                    break
                top = max(top, float(self._cosines(Counter(text[start[i] : start[i] + n]))[k]))
            if top >= least:
                yield k, top

    def best(self, text: str, least: float) -> tuple[str | None, float]:
        """The licence of a text: of its lines, of the whole, and of runs as long as templates."""
        found, score = None, 0.0
        lines = [words(x) for x in text.split("\n")]
        for bag in (*lines, [w for x in lines for w in x]):
            known = sum(map(self.vocabulary.__contains__, bag))
            # No word weighs more than one outside the vocabulary: known words add at most known**2 to the squared norm, others at least 1 each if distinct.
            if known and known**2 * (1 - least**2) >= least**2 * (len(set(bag)) - known) and (c := self.cosines(Counter(bag))).max() > score + 1e-12:
                found, score = self.names[int(c.argmax())], float(c.max())
        for k, c in self._runs([w for x in lines for w in x], least):
            if c > score + 1e-12:
                found, score = self.names[k], c
        return (found, score) if score >= least else (None, 0.0)


def _frequencies(vocabulary: frozenset[str]):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        n = 0
        for f in frames:
            for t in f["text"]:
                seen.update(vocabulary.intersection(words(t or "")))
            n += len(f)
        yield pd.DataFrame([*seen.items(), ("", n)], columns=["word", "n"])

    return task


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", heads: dict[str, tuple[str, ...]] = HEADS) -> DataFrame:
    """doc_id, path, own_license, score, license, license_from for every row; score is the cosine of an own licence, else 0; license_from is the directory that gave it, null for an own licence."""
    spark = files.sparkSession
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    vocabulary = frozenset(w for some in (templates, heads) for texts in some.values() for t in texts for w in words(t))
    counts = rows.select("text").mapInPandas(_frequencies(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with common.small_batches(spark):
        frequency = {r["word"]: r["n"] for r in counts.collect()}  # a row for each word of the templates at most
    sent = spark.sparkContext.broadcast(Matcher(templates, frequency, max(1, frequency.get("", 0)), heads))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [sent.value.best(t or "", least) for t in f["text"]]
            out = f.drop(columns="text")
            out["own_license"], out["score"] = [x[0] for x in found], [x[1] for x in found]
            yield out

    kinds = dict(files.dtypes)
    own = common.cut(rows.mapInPandas(task, f"doc_id {kinds[id_col]}, path string, own_license string, score double"))
    return inherit(own)


def inherit(own: DataFrame) -> DataFrame:
    """Licences from the nearest ancestor directories, for rows (doc_id, path, own_license, score)."""
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    name = F.element_at(parts, -1)
    declared = own.where(F.col("own_license").isNotNull() & name.rlike(LICENCE_FILE)).withColumn("folder", folder)
    declared = declared.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own_license")).getField("own_license").alias("given"))
    # Only rows that may inherit are joined, and ancestors of distinct folders, so a folder with very many files is one row there.
    heirs, others = F.col("own_license").isNull() & F.col("path").isNotNull(), F.col("own_license").isNotNull() | F.col("path").isNull()
    below = own.where(heirs).withColumn("of", folder)
    folders = common.cut(below.groupBy("of").agg(F.count("*").alias("files")))
    up = F.split("of", "/")
    ancestors = folders.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(up)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(up, F.lit(1), n), "/").alias("folder")))).alias("a")).select("of", "a.depth", "a.folder")
    # The nearer to the root a folder is, the more rows have it as an ancestor.
    declared = declared.join(ancestors.groupBy("folder").agg(F.count("*").alias("below")), "folder")
    found = common.join_by_size(ancestors, declared, "folder", "below", ancestors.count())
    nearest = found.groupBy("of").agg(F.max(F.struct("depth", "folder", "given")).alias("best"))
    nearest = folders.join(nearest, "of", "left")
    out = common.join_by_size(below, nearest, "of", "files", folders.agg(F.sum("files")).first()[0] or 0)
    out = out.select("doc_id", "path", "own_license", "score", F.col("best.given").alias("license"), F.col("best.folder").alias("license_from"))
    return out.union(own.where(others).select("doc_id", "path", "own_license", "score", F.col("own_license").alias("license"), F.lit(None).cast("string").alias("license_from")))
