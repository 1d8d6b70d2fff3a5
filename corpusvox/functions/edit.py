"""Edit alignment between token sequences.

Character distance uses Spark's built-in ``levenshtein`` (JVM, code points).
Word-level alignment *counts* (correct / substitution / insertion / deletion)
need the choice made at every cell, so they run in an Arrow-batched pandas UDF
that fills the tables of many pairs at once, one anti-diagonal after the other.
Unit costs; on a mismatch the cheapest of substitution, insertion, deletion
wins, ties in that order; a match always takes the diagonal.  Counts are carried
forward along the chosen cell, which equals walking the choices back from the
corner.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIGN_TYPE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("cor", "sub", "ins", "del", "wrong")])


#: Cells of one anti-diagonal that are filled together, over all pairs of a group.
CELLS = 200_000
COST, SUB, INS, DEL = range(4)


def _numbers(words: list[list[str]], ids: dict[str, int], pad: int) -> np.ndarray:
    """Word numbers of each list as a row, lower-cased, filled up with ``pad``."""
    out = np.full((len(words), max(map(len, words), default=0)), pad, np.int64)
    for row, w in enumerate(words):
        out[row, :len(w)] = [ids.setdefault(x.lower(), len(ids)) for x in w]
    return out


def _group_counts(hyps: list[list[str]], refs: list[list[str]]) -> np.ndarray:
    """(pairs, 4) of COST, SUB, INS, DEL; cell (i, j) stands on diagonal i + j at column i."""
    ids: dict[str, int] = {}
    h, r = _numbers(hyps, ids, -1), _numbers(refs, ids, -2)
    n_pairs, n, m = len(hyps), h.shape[1], r.shape[1]
    corner = np.array([len(x) for x in hyps]), np.array([len(x) for x in refs])
    out = np.zeros((n_pairs, 4), np.int32)
    last = now = np.zeros((4, n_pairs, n + 1), np.int32)
    for d in range(n + m + 1):
        new = np.zeros_like(now)
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        if len(i):
            diagonal, above, left = last[:, :, i - 1], now[:, :, i - 1], now[:, :, i]
            same = h[:, i - 1] == r[:, d - i - 1]
            best = np.minimum(np.minimum(diagonal[COST], above[COST]), left[COST])
            by_diagonal = same | (diagonal[COST] == best)
            by_insert = ~by_diagonal & (above[COST] == best)
            by_delete = ~by_diagonal & ~by_insert
            cells = np.where(by_diagonal, diagonal, np.where(by_insert, above, left))
            cells[COST] += ~same
            cells[SUB] += by_diagonal & ~same
            cells[INS] += by_insert
            cells[DEL] += by_delete
            new[:, :, i] = cells
        if d <= m:
            new[COST, :, 0] = new[DEL, :, 0] = d
        if d <= n:
            new[COST, :, d] = new[INS, :, d] = d
            if d == 0:
                new[:, :, 0] = 0
        done = np.flatnonzero(corner[0] + corner[1] == d)
        out[done] = new[:, done, corner[0][done]].T
        last, now = now, new
    return out


def align_pairs(hyps: list[list[str]], refs: list[list[str]]) -> np.ndarray:
    """(pairs, 5): cor, sub, ins, del, wrong.  Pairs of like size are filled together."""
    size = np.array([max(len(h), len(r)) for h, r in zip(hyps, refs, strict=True)], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    out = np.zeros((len(hyps), 5), np.int32)
    at = 0
    while at < len(order):
        width = 1
        while at + width < len(order) and (width + 1) * (size[order[at + width]] + 1) <= CELLS:
            width += 1
        group = order[at:at + width]
        c = _group_counts([hyps[g] for g in group], [refs[g] for g in group])
        n_ref = np.array([len(refs[g]) for g in group])
        # a reference word is matched, substituted or deleted
        out[group] = np.stack([n_ref - c[:, SUB] - c[:, DEL], c[:, SUB], c[:, INS], c[:, DEL], c[:, COST]], axis=1)
        at += width
    return out


def align_counts(hyp, ref) -> tuple[int, int, int, int, int]:
    """(cor, sub, ins, del, wrong) of one pair."""
    return tuple(int(x) for x in align_pairs([list(hyp)], [list(ref)])[0])


@F.pandas_udf(ALIGN_TYPE)
def word_alignment(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = align_pairs([list(h) if h is not None else [] for h in hyp], [list(r) if r is not None else [] for r in ref])
    return pd.DataFrame(rows, columns=["cor", "sub", "ins", "del", "wrong"])


def char_distance(hyp, ref, remove_spaces: bool = True):
    """Character edit distance; spaces removed first for CER."""
    h, r = (F.col(hyp) if isinstance(hyp, str) else hyp), (F.col(ref) if isinstance(ref, str) else ref)
    if remove_spaces:
        h, r = F.replace(h, F.lit(" "), F.lit("")), F.replace(r, F.lit(" "), F.lit(""))
    return F.levenshtein(h, r)
