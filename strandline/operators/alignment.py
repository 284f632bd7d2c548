"""Protein alignment: banded, global, with affine gaps; the share of identical residues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gap opening and extension and half the band's width (fixed values).
OPEN, EXTEND, BAND = -5.0, -10.0, 50


def read_matrix(text: str) -> dict[tuple[str, str], float]:
    """A substitution matrix of the usual layout: a line of symbols, then a symbol and its row."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {(row[0], c): float(v) for row in lines[1:] for c, v in zip(lines[0], row[1:], strict=False)}


def matches(a: str, b: str, matrix: dict[tuple[str, str], float] | None = None, band: int = BAND) -> int:
    """Identical residues on a best-scoring path; of equal paths the one with the most."""
    n, m = len(a), len(b)
    band = max(band, abs(n - m) + 1)
    score = (lambda x, y: matrix.get((x, y), -8.0)) if matrix else (lambda x, y: 5.0 if x == y else -4.0)
    none = (-np.inf, 0)
    # best (score, matches) ending in a match, a gap in b, a gap in a
    best, down = {0: (0.0, 0)}, {}
    right: tuple[float, int] = none
    for j in range(1, min(m, band) + 1):
        best[j] = (OPEN + EXTEND * j, 0)
    for i in range(1, n + 1):
        new, new_down, right = {}, {}, none
        for j in range(max(0, i - band), min(m, i + band) + 1):
            up, left, diagonal = best.get(j, none), new.get(j - 1, none), best.get(j - 1, none)
            d = down.get(j, none)
            new_down[j] = max((up[0] + OPEN + EXTEND, up[1]), (d[0] + EXTEND, d[1]))
            right = max((left[0] + OPEN + EXTEND, left[1]), (right[0] + EXTEND, right[1]))
            options = [new_down[j], right]
            if j and diagonal[0] > -np.inf:
                options.append((diagonal[0] + score(a[i - 1], b[j - 1]), diagonal[1] + (a[i - 1] == b[j - 1])))
            new[j] = max(options)
        best, down = new, new_down
    return best.get(m, none)[1] if n else 0


def identity(a: Column, b: Column, matrix: dict[tuple[str, str], float] | None = None) -> Column:
    """Matches over the longer length, per row in Arrow batches; 1 for two empty proteins, null if either is null."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None:
                return None
            return matches(p, q, matrix) / max(len(p), len(q)) if p or q else 1.0

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="object").astype("float64")

    return share(a, b)
