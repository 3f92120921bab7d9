"""Alignment of two sequences, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cost of a mismatch and of a gap of one base; and for local alignment match, mismatch, gap open, extend.
MISMATCH, GAP = 1, 2
LOCAL = (2, -2, -3, -1)


def global_cost(x: str, y: str, mismatch: int = MISMATCH, gap: int = GAP) -> int:
    """Least cost of turning x into y; a row of the table at a time, gaps within it by a running minimum."""
    a, b = (np.frombuffer(s.encode(), np.uint8) for s in (x, y))
    ramp = np.arange(len(b) + 1) * gap
    row = ramp.copy()
    for i, c in enumerate(a.tolist()):
        down = np.empty_like(row)
        down[0] = (i + 1) * gap
        down[1:] = np.minimum(row[:-1] + np.where(b == c, 0, mismatch), row[1:] + gap)
        row = np.minimum.accumulate(down - ramp) + ramp
    return int(row[-1])


def alignment_cost(x: Column, y: Column, mismatch: int = MISMATCH, gap: int = GAP) -> Column:
    """global_cost() of two columns; null if either is."""

    @F.arrow_udf("long")
    def cost(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else global_cost(p, q, mismatch, gap) for p, q in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    return cost(x, y)


def local_alignment(query: str, reference: str, scores: tuple[int, int, int, int] = LOCAL) -> dict:
    """Best local alignment with affine gaps: score, half-open ranges, and the cigar with = X I D of the query.

    Of equal scores the one that ends first in the reference, then in the query; going back, a match comes before a gap
    in the query, and that before one in the reference.
    """
    match, mismatch, opened, extend = scores
    n, m = len(query), len(reference)
    h = np.zeros((n + 1, m + 1), np.int64)
    e = np.full((n + 1, m + 1), -(1 << 40))  # a gap in the reference: the query goes on
    f = np.full((n + 1, m + 1), -(1 << 40))  # a gap in the query: the reference goes on
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i, j] = max(h[i - 1, j] + opened, e[i - 1, j] + extend)
            f[i, j] = max(h[i, j - 1] + opened, f[i, j - 1] + extend)
            h[i, j] = max(0, h[i - 1, j - 1] + (match if query[i - 1] == reference[j - 1] else mismatch), e[i, j], f[i, j])
    score = int(h.max())
    if not score:
        return {"score": 0, "query_begin": 0, "query_end": 0, "reference_begin": 0, "reference_end": 0, "cigar": ""}
    j, i = (int(x[0]) for x in np.nonzero(h.T == score))
    ends, ops, state = (i, j), [], "h"
    while True:
        if state == "h":
            if not h[i, j]:
                break
            same = query[i - 1] == reference[j - 1]
            if h[i, j] == h[i - 1, j - 1] + (match if same else mismatch):
                ops.append("=" if same else "X")
                i, j = i - 1, j - 1
            else:
                state = "e" if h[i, j] == e[i, j] else "f"
        elif state == "e":
            ops.append("I")
            state = "h" if e[i, j] == h[i - 1, j] + opened else "e"
            i -= 1
        else:
            ops.append("D")
            state = "h" if f[i, j] == h[i, j - 1] + opened else "f"
            j -= 1
    ops.reverse()
    cigar, k = "", 0
    while k < len(ops):
        run = k
        while run < len(ops) and ops[run] == ops[k]:
            run += 1
        cigar, k = cigar + f"{run - k}{ops[k]}", run
    return {"score": score, "query_begin": i, "query_end": ends[0], "reference_begin": j, "reference_end": ends[1], "cigar": cigar}


def aligned(query: Column, reference: Column, scores: tuple[int, int, int, int] = LOCAL) -> Column:
    """local_alignment() of two columns as a struct; null if either is."""
    kinds = pa.struct([(n, pa.int64()) for n in ("score", "query_begin", "query_end", "reference_begin", "reference_end")] + [("cigar", pa.string())])

    @F.arrow_udf("score long, query_begin long, query_end long, reference_begin long, reference_end long, cigar string")
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else local_alignment(p, q, scores) for p, q in zip(a.to_pylist(), b.to_pylist(), strict=True)], kinds)

    return found(query, reference)
