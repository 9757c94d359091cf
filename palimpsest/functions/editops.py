"""Counts of character insertions, deletions and substitutions, batch by batch with numpy.

The counts are those of the alignment found walking back from the ends of both texts and
preferring a match, then a substitution, an insertion, a deletion. Only the distance and
the number of substitutions on that path are carried forward, row by row, so memory grows
with the text length and not with its square; texts of any length go through whole.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.shipping import by_value

by_value(__name__)

_CELLS = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<i4")


def _common_tail(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    if n == 0:
        return 0
    differ = np.nonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])[0]
    return int(differ[0]) if len(differ) else n


def _padded(parts, fill):
    width = max(len(p) for p in parts)
    out = np.full((len(parts), width), fill, dtype=np.int32)
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def _solve(olds, news):
    """Distance and substitution count for a block of pairs of similar size."""
    m = np.array([len(o) for o in olds])
    n = np.array([len(s) for s in news])
    old, new = _padded(olds, -1), _padded(news, -2)
    rows, width = len(olds), new.shape[1]
    col = np.arange(width + 1, dtype=np.int64)
    dist = np.broadcast_to(col, (rows, width + 1)).copy()
    subs = np.zeros_like(dist)
    at = np.arange(rows)
    final_d, final_s = dist[at, n].copy(), subs[at, n].copy()
    for i in range(1, old.shape[1] + 1):
        same = old[:, i - 1:i] == new
        best = np.empty_like(dist)
        best[:, 0] = i
        best[:, 1:] = np.minimum(dist[:, :-1] + ~same, dist[:, 1:] + 1)
        now = np.minimum.accumulate(best - col, axis=1) + col
        diagonal = dist[:, :-1] + 1
        replaced = ~same & (now[:, 1:] == diagonal)
        inserted = ~same & ~replaced & (now[:, 1:] == now[:, :-1] + 1)
        path = np.empty_like(subs)
        path[:, 0] = 0
        path[:, 1:] = np.where(same, subs[:, :-1], np.where(replaced, subs[:, :-1] + 1, subs[:, 1:]))
        # an insertion repeats the count of the cell to its left: take the last other cell
        source = np.zeros((rows, width + 1), dtype=np.int64)
        source[:, 1:] = np.where(inserted, 0, col[1:])
        np.maximum.accumulate(source, axis=1, out=source)
        subs = np.take_along_axis(path, source, axis=1)
        dist = now
        done = m == i
        if done.any():
            final_d[done], final_s[done] = dist[at[done], n[done]], subs[at[done], n[done]]
    return final_d, final_s


def count_edits(olds, news) -> np.ndarray:
    """Rows of (insertions, deletions, substitutions) for paired lists of texts."""
    pairs = []
    for o, s in zip(olds, news):
        a, b = _codes(o), _codes(s)
        tail = _common_tail(a, b)
        pairs.append((a[:len(a) - tail], b[:len(b) - tail]))
    out = np.zeros((len(pairs), 3), dtype=np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    start = 0
    while start < len(order):
        stop, widest = start, 0
        while stop < len(order):
            widest = max(widest, len(pairs[order[stop]][1]) + 1)
            if stop > start and (stop - start + 1) * widest > _CELLS:
                break
            stop += 1
        block = order[start:stop]
        dist, subs = _solve([pairs[i][0] for i in block], [pairs[i][1] for i in block])
        gap = np.array([len(pairs[i][1]) - len(pairs[i][0]) for i in block])
        moved = dist - subs
        out[block, 0], out[block, 1], out[block, 2] = (moved + gap) // 2, (moved - gap) // 2, subs
        start = stop
    return out


_COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("char_insertions", "char_deletions", "char_substitutions")])


@F.pandas_udf(_COUNTS)
def edit_ops(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    valid = old.notna() & new.notna()
    counts = np.full((len(old), 3), np.nan)
    if valid.any():
        counts[valid.to_numpy()] = count_edits(old[valid].tolist(), new[valid].tolist())
    frame = pd.DataFrame(counts, columns=_COUNTS.names)
    return frame.astype("Int32")
