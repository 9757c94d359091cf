"""Exact k-nearest-neighbour class shares.

Equal training points are counted once with a weight. :func:`neighbour_shares` partitions points by pivots and shuffles;
:func:`shares_by` sends a sample of labelled rows to all tasks where it is small, with the same result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.shipping import by_value
from palimpsest.session import shared_dir

by_value(__name__)

_SHARES = T.ArrayType(T.DoubleType())
#: bytes of labelled fit rows (rows x numbers x 8) up to which they are sent to all tasks
SMALL_BYTES = 16 << 20
#: points of a cell as the pivots are chosen, pivots at most, rows of either side that one task compares
PER_CELL, MOST_PIVOTS, BLOCK = 16_384, 512, 32_768
#: points of a leaf and queries of a group inside a task, either for vectors of many numbers, which rule out little, and from how many on
LEAF, GROUP, WIDE, MANY = 128, 64, 512, 16


def weighted_points(df: DataFrame, truths) -> DataFrame:
    """(features, ys, w, h): distinct training points with their number and a hash that breaks ties."""
    points = df.select("features", F.array(*truths).alias("ys")).groupBy("features", "ys").agg(F.count(F.lit(1)).alias("w"))
    return points.withColumn("h", F.xxhash64("features", "ys"))


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.empty((len(queries), len(points)))
    step = max(1, (1 << 22) // max(1, points.size))
    for i in range(0, len(queries), step):
        out[i:i + step] = np.sqrt(((queries[i:i + step, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    return out


def _leaves(points: np.ndarray, most: int):
    """(order, starts, low, high): rows cut at the median of the widest dimension until no leaf has more than ``most`` of them,
    and the box around each leaf. Leaf i is ``order[starts[i]:starts[i + 1]]``."""
    order, ends, open_ = np.arange(len(points)), [], [(0, len(points))]
    while open_:
        start, end = open_.pop()
        if end - start <= most:
            ends.append(end)
            continue
        part = points[order[start:end]]
        middle = (end - start) // 2
        wide = np.argmax(np.nan_to_num(np.max(part, axis=0) - np.min(part, axis=0)))
        order[start:end] = order[start:end][np.argpartition(part[:, wide], middle)]
        open_ += [(start + middle, end), (start, start + middle)]
    starts = np.array([0, *ends])
    sorted_ = points[order]
    return order, starts, np.minimum.reduceat(sorted_, starts[:-1]), np.maximum.reduceat(sorted_, starts[:-1])


def _to_boxes(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of boxes on the left to boxes on the right; what is no number rules nothing out."""
    out = np.zeros((len(least), len(low)))
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(low.shape[1]):
            gap = np.maximum(np.maximum(low[:, i] - most[:, i, None], least[:, i, None] - high[:, i]), 0)
            out += np.where(np.isfinite(gap), gap, 0) ** 2
    return out


def _nearest(asked: np.ndarray, points: np.ndarray, k: int, bounds: np.ndarray | None = None, leaves=None):
    """(query, point, distance), flat: the first k points of each query by (distance, position), none beyond its bound.

    Near queries are answered together. They visit the leaves of the points from the nearest box on, until no box can hold a
    neighbour; products of matrices pick out who may be one, and the distances of those are computed one by one.
    """
    dims = points.shape[1]
    order, starts, low, high = leaves or _leaves(points, WIDE if dims >= MANY else LEAF)
    sorted_, counts = points[order], np.diff(starts)
    kind = np.float32 if dims >= MANY else np.float64  # of the products, where they are most of the work
    error = 4 * (dims + 4) * np.finfo(kind).eps
    centre = np.nan_to_num(np.median(sorted_, axis=0)) if dims >= MANY else None
    shared = _known(sorted_, centre, kind) if dims >= MANY else None
    groups, cuts, least, most = _leaves(asked, WIDE if dims >= MANY else GROUP)
    room = np.empty(0, dtype=kind)  # of the products, used again
    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    out = [none]
    for g in range(len(cuts) - 1):
        rows = groups[cuts[g]:cuts[g + 1]]
        a = asked[rows]
        limit = np.full(len(rows), np.inf) if bounds is None else np.where(np.isnan(bounds[rows]), np.inf, _squared(bounds[rows]))
        far = _to_boxes(least[g][None], most[g][None], low, high)[0]
        middle = np.nan_to_num(np.median(a, axis=0))
        left = np.argsort(_to_boxes(middle[None], middle[None], low, high)[0], kind="stable")
        own, common = _moved(a, middle, kind), None
        q, p, d, chunk = *none, max(4 * k, 2 * LEAF) if np.isinf(limit).any() else 4_096
        while True:
            left = left[far[left] <= limit.max()]
            if not len(left):
                break
            now, left = np.split(left, [1 + np.searchsorted(np.cumsum(counts[left]), chunk)])
            chunk = min(2 * chunk, 4_096)
            who = np.arange(len(rows))
            if dims < MANY or far.max() > limit.max():  # boxes of many numbers cost more than they save where none is ruled out
                within = _to_boxes(a, a, low[now], high[now]) <= limit[:, None]
                now, who = now[within.any(axis=0)], np.flatnonzero(within.any(axis=1))
                if not len(now):
                    continue
            at = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in now])
            moved, size = own
            known = None
            if shared is not None and np.isfinite(limit).all():  # one centre for all groups, if what is rounded is small beside the distances
                common = _moved(a, centre, kind) if common is None else common
                if error * (float(common[1].max()) + float(shared[1].max())) <= 0.02 * float(limit.min()):
                    (moved, size), known, length = common, shared[0][at], shared[1][at]
            if known is None:
                known, length = _known(sorted_[at], middle, kind)
            if len(who) < len(rows):
                moved, size = moved[who], size[who]
            if room.size < len(who) * len(at):
                room = np.empty(2 * len(who) * len(at), dtype=kind)
            with np.errstate(over="ignore", invalid="ignore"):
                about = np.matmul(moved, known.T, out=room[:len(who) * len(at)].reshape(len(who), len(at)))
                slack = np.nan_to_num(error * (size + length[np.isfinite(length)].max(initial=0)), nan=0, posinf=0)
            odd = None
            if not float(size.max()) + float(length.max()) < np.finfo(kind).max / 8:  # looked at one by one
                odd = ~np.isfinite(about)
                about[odd] = np.inf
            if len(at) >= k and np.isinf(limit[who]).any():
                limit[who] = np.minimum(limit[who], np.partition(about, k - 1, axis=1)[:, k - 1] + slack)
            near = about <= _above(limit[who] + slack, kind)[:, None]
            found, c = np.divmod(np.flatnonzero(near if odd is None else near | odd), len(at))
            if not len(found):
                continue
            nq, np_ = who[found], order[at[c]]
            with np.errstate(over="ignore", invalid="ignore"):
                nd = [np.sqrt(((a[nq[i:i + 65_536]] - points[np_[i:i + 65_536]]) ** 2).sum(axis=1)) for i in range(0, len(nq), 65_536)]
            q, p, d = np.concatenate([q, nq]), np.concatenate([p, np_]), np.concatenate([d, *nd])
            first = np.lexsort((p, d, q))
            q, p, d = q[first], p[first], d[first]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            full = (rank == k - 1) & ~np.isnan(d)
            limit[q[full]] = np.minimum(limit[q[full]], _squared(d[full]))
            q, p, d = q[rank < k], p[rank < k], d[rank < k]
        kept = np.full(len(q), True) if bounds is None else np.isnan(bounds[rows][q]) | (d <= bounds[rows][q])
        out.append((rows[q[kept]], p[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _moved(a: np.ndarray, centre: np.ndarray, kind):
    """(rows, sizes): queries from a centre on, so that their product with :func:`_known` rows is the squared distance, but for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        moved = (a - centre).astype(kind)
        size = (moved ** 2).sum(axis=1)
    return np.column_stack([moved, size, np.ones_like(size)]), size


def _known(points: np.ndarray, centre: np.ndarray, kind):
    """(rows, lengths): the points of such products."""
    with np.errstate(over="ignore", invalid="ignore"):
        known = (points - centre).astype(kind)
        length = (known ** 2).sum(axis=1)
        return np.column_stack([-2 * known, np.ones_like(length), length]), length


def _above(limit: np.ndarray, kind) -> np.ndarray:
    """Limits as numbers of this kind, none less than before."""
    with np.errstate(over="ignore"):
        return np.nextafter(limit.astype(kind), np.array(np.inf, dtype=kind))


def _squared(d: np.ndarray) -> np.ndarray:
    """No less than the square, whatever was rounded."""
    return d ** 2 * (1 + 1e-12) + np.finfo(float).tiny


def _vote(near, ys, weights, ks):
    """Class shares among the nearest (queries x neighbours) for each k, side by side, a point of weight w counting as w neighbours.

    The neighbours for a smaller k are the first of those for the largest.
    """
    w = weights[near]
    before = np.cumsum(w, axis=1) - w
    out = []
    for k in ks:
        taken = np.clip(k - before, 0, w)
        out.append((taken[:, :, None] * ys[near]).sum(axis=1) / taken.sum(axis=1, keepdims=True))
    return np.concatenate(out, axis=1)


def _size(points: DataFrame) -> tuple[int, int, int]:
    """(rows, numbers of a point, classes)."""
    rows, wide, classes = points.agg(F.count(F.lit(1)), F.max(F.size("features")), F.max(F.size("ys"))).first()
    if not rows:
        raise ValueError("no training points")
    return rows, wide, classes


def _several(k) -> list[int]:
    return [k] if isinstance(k, int) else list(k)


def shares_by(points: DataFrame, k):
    """A function (queries, out) that adds class shares; ``points`` are labelled fit rows. Of several k, the shares follow each other.

    Up to ``SMALL_BYTES`` of them are sent to all tasks once; more are searched by cells. The result does not depend on it.
    """
    rows, wide, classes = _size(points)
    if rows * (wide + classes + 1) * 8 > SMALL_BYTES:
        return lambda queries, out: neighbour_shares(queries, points, k, out)
    table = points.orderBy("h").toPandas()
    known = np.stack(table["features"].to_numpy())
    sent = points.sparkSession.sparkContext.broadcast((
        known, np.stack(table["ys"].to_numpy()), table["w"].to_numpy(), _leaves(known, WIDE if known.shape[1] >= MANY else LEAF)))

    @F.pandas_udf(_SHARES)
    def vote(features: pd.Series) -> pd.Series:
        known, ys, w, leaves = sent.value
        if not len(features):
            return pd.Series([], dtype=object)
        asked = np.stack(features.to_numpy())
        q, p, _ = _nearest(asked, known, max(_several(k)), leaves=leaves)
        near = np.empty((len(asked), len(p) // len(asked)), dtype=np.int64)
        near[q, np.arange(len(q)) % near.shape[1]] = p
        return pd.Series(list(_vote(near, ys, w, _several(k))))

    return lambda queries, out: queries.withColumn(out, vote(F.col("features")))


def _assigned(df: DataFrame, pivots) -> DataFrame:
    """Add the cell of the nearest pivot and the distance to it."""
    @F.pandas_udf("struct<cell:int,far:double>")
    def nearest(features: pd.Series) -> pd.DataFrame:
        if not len(features):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "far": pd.Series(dtype="float64")})
        d = _distances(np.stack(features.to_numpy()), pivots.value)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "far": d[np.arange(len(d)), cell]})

    return df.withColumn("_a", nearest("features")).select(*df.columns, "_a.cell", "_a.far")


def _searched(visits: DataFrame, points: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(qid, d, h, w, ys): of each pair of blocks the k nearest points of each query that visits the cell, none beyond its bound.

    Cells and their visitors are cut into blocks of bounded size, so a crowded cell is many groups.
    """
    spread = cells.join(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")), "cell").select(
        "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("p"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("q"))
    spread = F.broadcast(spread)  # a row a cell
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = visits.join(spread, "cell").select("cell", span("p").alias("pb"), F.pmod(F.xxhash64("qid"), F.col("q")).cast("int").alias("qb"), "qid", F.col("features").alias("asked"), "bound")
    right = points.join(spread, "cell").select("cell", F.pmod(F.xxhash64("h"), F.col("p")).cast("int").alias("pb"), span("q").alias("qb"), F.col("features").alias("known"), "ys", "w", "h")

    def compare(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(known):
            return pd.DataFrame({"qid": [], "d": [], "h": [], "w": [], "ys": []})
        known = known.sort_values("h", kind="stable")
        q, at, d = _nearest(np.stack(asked["asked"].to_numpy()), np.stack(known["known"].to_numpy()), k, asked["bound"].to_numpy())
        return pd.DataFrame({"qid": asked["qid"].to_numpy()[q], "d": d, "h": known["h"].to_numpy()[at], "w": known["w"].to_numpy()[at],
                             "ys": known["ys"].to_numpy()[at]})

    keys = ["cell", "pb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "qid long, d double, h long, w long, ys array<double>")


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with the weight before each; a task passes on no more than k rows of a query."""
    order = Window.partitionBy("qid").orderBy("d", "h")
    kept = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return kept.withColumn("before", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")).drop("_n")


def neighbour_shares(queries: DataFrame, points: DataFrame, k, out: str = "shares", per_cell: int | None = None) -> DataFrame:
    """Add the share of each class among the k nearest training points of ``features``; points are from weighted_points. For a list of
    k there is one search, for the largest, and the shares of each k follow each other.

    Exact Euclidean search without a full comparison where the data allow it. Pivots (a bounded sample of the points) cut
    space into Voronoi cells, of which each keeps size and radius. A query is first answered in its own cell; the k-th
    distance found there rules out every cell that the triangle inequality puts further away, and the query visits the others.
    Ties go to the smaller hash. What the driver sees are pivots and one row a cell, both at most ``MOST_PIVOTS``.
    """
    shared_dir(queries.sparkSession)
    spark, ks = queries.sparkSession, _several(k)
    k = max(ks)
    rows, _, classes = _size(points)
    wanted = max(1, min(MOST_PIVOTS, rows // (per_cell or PER_CELL)))
    pivots = spark.sparkContext.broadcast(np.array([r.features for r in points.orderBy("h").limit(wanted).collect()]))
    points = _assigned(points, pivots).checkpoint()
    asked = _assigned(queries.select("features").distinct(), pivots).withColumn("qid", F.monotonically_increasing_id()).checkpoint()
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.max("far").alias("radius")).checkpoint()
    size = cells.toPandas().set_index("cell").reindex(range(len(pivots.value)))
    known = spark.sparkContext.broadcast((size["w"].fillna(0).to_numpy(), size["radius"].fillna(-np.inf).to_numpy(), _distances(pivots.value, pivots.value)))

    own = _first(_searched(asked.withColumn("bound", F.lit(float("nan"))), points, cells, k), k).checkpoint()
    reached = own.groupBy("qid").agg(F.min(F.when(F.col("before") + F.col("w") >= k, F.col("d"))).alias("bound"))

    @F.pandas_udf("array<int>")
    def visits(features: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        weight, radius, between = known.value
        d = _distances(np.stack(features.to_numpy()), pivots.value)
        result = []
        for row, c, most in zip(d, cell.to_numpy(), bound.to_numpy()):
            if np.isnan(most):  # fewer than k points in the own cell: as far as the nearest whole cells that hold k
                far = row + radius
                order = np.argsort(far, kind="stable")
                order = order[weight[order] > 0]
                enough = np.searchsorted(np.cumsum(weight[order]), k)
                most = far[order[min(enough, len(order) - 1)]] if enough < len(order) else np.inf
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = (row ** 2 - row[c] ** 2) / (2 * between[c])  # to the plane halfway to the other pivot
            least = np.fmax(row - radius, beyond)
            ok = (least <= most * (1 + 1e-9) + 1e-12) & (weight > 0)
            ok[c] = False
            result.append(np.flatnonzero(ok).astype("int32"))
        return pd.Series(result)

    more = asked.join(reached, "qid", "left").select(
        "qid", "features", F.coalesce("bound", F.lit(float("nan"))).alias("bound"), visits("features", "cell", "bound").alias("cells")).checkpoint()
    more = more.select("qid", "features", "bound", F.explode("cells").alias("cell"))  # not stored: as many rows as visits
    near = _first(own.drop("before").unionByName(_searched(more, points, cells, k)), k)
    taken = {j: F.greatest(F.lit(0), F.least(F.col("w"), j - F.col("before"))) for j in ks}
    voted = near.groupBy("qid").agg(*[F.sum(taken[j]).alias(f"_t{j}") for j in ks], *[
        F.sum(taken[j] * F.col("ys")[i]).alias(f"_y{j}_{i}") for j in ks for i in range(classes)])
    shares = asked.join(voted, "qid").select(F.col("features").alias("_features"), F.array(*[
        F.col(f"_y{j}_{i}") / F.col(f"_t{j}") for j in ks for i in range(classes)]).alias(out)).checkpoint()
    return queries.join(shares, F.col("features") == F.col("_features"), "left").drop("_features")
