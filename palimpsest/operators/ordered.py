"""Order-dependent operators that stay balanced when one key holds most rows.

A plain window hands every row of a key to one task. Here a key with more than ``floor``
rows is cut into consecutive spans of the order column (chunks); each task orders one
(key, chunk) and a small per-chunk summary carries in what lies before or after. Rows of
different chunks are strictly ordered, so the result equals the plain window exactly.

``with_chunk`` decides with one count over the key columns. Where no key is hot it hands
back ``None`` for the split, and the operators below are plain windows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import shared_dir

CHUNK = "_chunk"
_WHOLE = -(1 << 63)  # the chunk of a key that is not cut
_FINE = 64  # spans per floor of rows: few rounds for bursts, and still one summary row for thousands of rows


@dataclass(frozen=True)
class Split:
    """When to cut a key: above ``floor`` rows, what one task may order on its own.

    The bound does not grow with the data. The table of hot keys has at most one row per
    ``floor`` rows; Spark broadcasts it where it is small and shuffles it where it is not.
    """

    floor: int = 1_000_000


DEFAULT_SPLIT = Split()


@dataclass(frozen=True)
class Fold:
    """``kind`` (min, max or sum) of ``column`` over the strictly earlier (``later``) rows of ``keys``."""

    name: str
    kind: str
    column: str
    keys: tuple
    later: bool = False


def _stats(order: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")]


def _hot(df: DataFrame, groups, order: str, split: Split) -> DataFrame | None:
    """The groups to cut with their first order value and span width, or None; looks at one row of totals."""
    sized = df.groupBy(*groups).agg(*_stats(order))
    can = F.col("_hi") > F.col("_lo")
    most = sized.agg(F.max(F.when(can, F.col("_n")))).first()[0]
    if not most or most <= split.floor:
        return None
    pieces = F.ceil(F.col("_n") / F.lit(split.floor)) * _FINE
    width = F.ceil((F.col("_hi") - F.col("_lo") + 1) / pieces).cast("bigint")
    return sized.where(can & (F.col("_n") > split.floor)).select(*groups, "_lo", width.alias("_width"))


def _cut(df: DataFrame, hot: DataFrame, on, order: str, how: str) -> DataFrame:
    """Set ``_chunk`` of the hot groups' rows to the start of their span."""
    tags = [f"_g{i}" for i in range(len(on))]
    right = hot.select(*[F.col(k).alias(t) for k, t in zip(on, tags)], "_lo", "_width")
    joined = df.join(right, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(on, tags)], how)
    start = F.expr(f"_lo + ((`{order}` - _lo) div _width) * _width")
    return joined.select(*[c for c in df.columns if c != CHUNK], F.coalesce(start, F.col(CHUNK)).alias(CHUNK))


def with_chunk(df: DataFrame, keys, order: str, split: Split | None = DEFAULT_SPLIT):
    """(df with ``_chunk``, split), or (df, None) where no key is hot.

    A hot key is cut into equal spans of ``order`` (BIGINT), and a span that is itself
    above the floor (a burst) again, until all are small or hold a single order value.
    Each further round looks at the hot rows only. Chunks of a coarse key also serve any
    finer key. NULL is a key like any other.
    """
    if split is None or CHUNK in df.columns:
        return df, split
    keys = list(keys)
    hot = _hot(df, keys, order, split)
    if hot is None:
        return df, None
    whole = F.lit(_WHOLE).cast("bigint").alias(CHUNK)
    out = _cut(df.select("*", whole), hot, keys, order, "left")
    crowded = _cut(df.select(*keys, order, whole), hot, keys, order, "inner")
    while (bursts := _hot(crowded, [*keys, CHUNK], order, split)) is not None:
        out = _cut(out, bursts, [*keys, CHUNK], order, "left")
        crowded = _cut(crowded, bursts, [*keys, CHUNK], order, "inner")
    return out, split


def settled(df: DataFrame, split: Split | None) -> DataFrame:
    """With hot keys, a checkpoint in the shared folder: each later step reads its input twice."""
    if split is None:
        return df
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _carry_join(df: DataFrame, carry: DataFrame, keys) -> DataFrame:
    tags = [f"_c{i}" for i in range(len(keys) + 1)]
    right = carry.select(*[F.col(k).alias(t) for k, t in zip([*keys, CHUNK], tags)],
                         *[c for c in carry.columns if c not in (*keys, CHUNK)])
    cond = [F.col(k).eqNullSafe(F.col(t)) for k, t in zip([*keys, CHUNK], tags)]
    return df.join(right, cond, "left").drop(*tags)


def _agg(kind: str, column) -> Column:
    return {"min": F.min, "max": F.max, "sum": F.sum}[kind](column)


def _merge(fold: Fold, hot: bool) -> Column:
    inside, carried = F.col(fold.name), F.col(f"_k_{fold.name}")
    if fold.kind == "sum":
        total = F.coalesce(inside, F.lit(0)) + (F.coalesce(carried, F.lit(0)) if hot else F.lit(0))
        return total.alias(fold.name)
    if not hot:
        return inside
    return (F.least if fold.kind == "min" else F.greatest)(inside, carried).alias(fold.name)


def running(df: DataFrame, order: str, folds, split: Split | None = None) -> DataFrame:
    """Add every fold; rows with an equal ``order`` value are not in each other's fold.

    A sum over no rows is 0. Sorting makes each frame start at its partition's edge, which
    Spark evaluates in linear time. ``df`` comes from ``with_chunk``.
    """
    cut = [CHUNK] if split else []

    def frame(keys, later):
        way = F.col(order).desc() if later else F.col(order).asc()
        return Window.partitionBy(*keys, *cut).orderBy(way).rangeBetween(Window.unboundedPreceding, -1)

    out = df.select("*", *[_agg(f.kind, F.col(f.column)).over(frame(f.keys, f.later)).alias(f.name) for f in folds])
    for keys in dict.fromkeys(f.keys for f in folds) if split else ():
        mine = [f for f in folds if f.keys == keys]
        sums = df.where(F.col(CHUNK) > _WHOLE).groupBy(*keys, CHUNK).agg(*[_agg(f.kind, f.column).alias(f"_p_{f.name}") for f in mine])

        def chunks(later, keys=keys):
            way = F.col(CHUNK).desc() if later else F.col(CHUNK).asc()
            return Window.partitionBy(*keys).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)

        carry = sums.select(*keys, CHUNK, *[_agg(f.kind, f"_p_{f.name}").over(chunks(f.later)).alias(f"_k_{f.name}") for f in mine])
        out = _carry_join(out, carry, keys)
    return out.select(*df.columns, *[_merge(f, split is not None) for f in folds])


def position(df: DataFrame, keys, order: str, ties=(), name: str = "position", split: Split | None = None) -> DataFrame:
    """1-based row number of each row within its key by (order, *ties)."""
    keys, cut = list(keys), [CHUNK] if split else []
    w = Window.partitionBy(*keys, *cut).orderBy(order, *ties)
    inside = df.select("*", F.row_number().over(w).cast("bigint").alias(name))
    if not split:
        return inside
    sizes = df.where(F.col(CHUNK) > _WHOLE).groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, CHUNK, F.sum("_size").over(chunks).alias("_before"))
    return _carry_join(inside, carry, keys).select(
        *df.columns, (F.col(name) + F.coalesce(F.col("_before"), F.lit(0))).alias(name))


def adjacent(df: DataFrame, keys, order: str, ties, columns: dict, split: Split | None = None) -> DataFrame:
    """Values of the row just before / just after by (order, *ties).

    ``columns`` maps an output name to ``(offset, column)`` with offset -1 or +1. The
    absent neighbour of the first or last row gives NULL.
    """
    keys, ties, cut = list(keys), list(ties), [CHUNK] if split else []
    w = Window.partitionBy(*keys, *cut).orderBy(order, *ties)
    if not split:
        return df.select("*", *[(F.lag if off < 0 else F.lead)(c).over(w).alias(n) for n, (off, c) in columns.items()])

    def cells(off):
        return F.struct(*[F.col(c).alias(n) for n, (o, c) in columns.items() if o == off])

    offsets = sorted({off for off, _ in columns.values()})
    joined = df.select("*", *[(F.lag if off < 0 else F.lead)(cells(off)).over(w).alias(f"_in{off + 1}") for off in offsets])
    for off in offsets:
        edge = F.struct(F.col(order).alias("_o"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)], cells(off).alias("_cells"))
        pick, move = (F.max, F.lag) if off < 0 else (F.min, F.lead)
        ends = df.where(F.col(CHUNK) > _WHOLE).groupBy(*keys, CHUNK).agg(pick(edge).alias("_e"))
        carry = ends.select(*keys, CHUNK, move("_e._cells").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias(f"_out{off + 1}"))
        joined = _carry_join(joined, carry, keys)
    return joined.select(*df.columns, *[
        F.coalesce(F.col(f"_in{o + 1}"), F.col(f"_out{o + 1}"))[n].alias(n) for n, (o, _) in columns.items()])


