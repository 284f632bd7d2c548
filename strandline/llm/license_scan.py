"""License scans: text units against licence templates by the Dice coefficient over word bigrams.

Units are a text's lines, its paragraphs of several lines (blank lines part them), and the whole text. Words are
lower-cased runs of letters and digits. With a least coefficient t a template of b distinct bigrams can only match units
of t / (2 - t) * b to (2 - t) / t * b distinct bigrams; other templates are passed over. Per document the best match stays
(ties: the template listed first), and how many units matched any template.

A null or empty text matches nothing; repeated rows are rows of their own; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, expand, freed, mix, prepare, read, slices, utf8, word_hashes, words

#: Standard notices of public licences (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST = 0.8

_BETWEEN = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BETWEEN[_a:_b] = False
_C = np.uint64(0x9FB21C651E98DF25)


def bigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word bigrams of each row."""
    buf = LOWER[buf]
    start, end, row = words(buf, offs, _BETWEEN)
    h = word_hashes(buf, start, end)
    same = row[1:] == row[:-1]
    value, row = mix(h[:-1] * _C + h[1:])[same], row[1:][same]
    by = np.lexsort((value, row))
    value, row = value[by], row[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


class Templates:
    def __init__(self, texts: dict[str, str], least: float):
        self.names, self.least = list(texts), least
        row, value = bigrams(*utf8(pa.array(list(texts.values()))))
        self.size = np.bincount(row, minlength=len(texts))
        order = np.argsort(value, kind="stable")
        self.value, self.of = value[order], row[order]

    def matches(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, template, dice) of all units and templates that reach the least coefficient."""
        row, value = bigrams(buf, offs)
        size = np.bincount(row, minlength=len(offs) - 1)
        low, high = self.least / (2 - self.least), (2 - self.least) / self.least
        # units that no template's size allows leave first
        fits = (size >= low * self.size.min() - 1e-9) & (size <= high * self.size.max() + 1e-9)
        keep = fits[row]
        row, value = row[keep], value[keep]
        first, last = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        n = last - first
        unit = np.repeat(row, n)
        at = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        pair, shared = np.unique(unit * len(self.names) + self.of[at], return_counts=True)
        unit, template = pair // len(self.names), pair % len(self.names)
        a, b = size[unit], self.size[template]
        bound = (a >= low * b - 1e-9) & (a <= high * b + 1e-9)
        dice = np.where(bound, 2 * shared / (a + b), 0.0)
        ok = dice >= self.least - 1e-12
        return unit[ok], template[ok], dice[ok]


def units(buf: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the lines, paragraphs of several lines and whole of one text."""
    cut = np.flatnonzero(buf == 10)
    start = np.concatenate([[0], cut + 1])
    end = np.concatenate([cut, [len(buf)]])
    out = list(zip(start.tolist(), end.tolist(), strict=True))
    if len(out) > 1:
        out.append((0, len(buf)))
        blank = np.array([not buf[a:b].size or bool(np.isin(buf[a:b], (32, 9, 13)).all()) for a, b in out[:-1]])
        if blank.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.astype(np.int8), [1]])))
            out += [(int(start[a]), int(end[b - 1])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a > 1]
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("n_matches", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        for a, b in slices(offs):
            spans, owner = [], []
            for r in range(a, b):
                for x, y in units(buf[offs[r] : offs[r + 1]]):
                    spans.append((offs[r] + x, offs[r] + y))
                    owner.append(r - a)
            at = np.array(spans, np.int64).reshape(-1, 2)
            sizes = at[:, 1] - at[:, 0]
            text, ends, owner = buf[expand(at[:, 0], sizes)], np.concatenate([[0], np.cumsum(sizes)]), np.array(owner, np.int64)
            unit, template, dice = templates.matches(text, ends)
            row = owner[unit]
            order = np.lexsort((template, -dice, row))
            row, template, dice, unit = row[order], template[order], dice[order], unit[order]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            n = np.bincount(owner[np.unique(unit)], minlength=b - a) if len(unit) else np.zeros(b - a, np.int64)
            name, value = [None] * (b - a), [0.0] * (b - a)
            for k in first.tolist():
                name[row[k]], value[row[k]] = templates.names[template[k]], round(float(dice[k]), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(name, pa.string()), pa.array(value), pa.array(n.astype(np.int64))], schema=_OUT)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license (null: none), dice (0: none), n_matches for every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    known = Templates(templates, least)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(freed(lambda b: _scan(b, known)), "doc_id long, license string, dice double, n_matches long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
