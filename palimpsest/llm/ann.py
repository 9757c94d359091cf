"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

#: distinct vectors of one shard, queries of one block
SHARD, BLOCK = 4096, 512
#: neighbours of a node above the ground level; the ground level has twice as many
M = 16
#: nearest candidates from which a node's neighbours are chosen, and entries that a search keeps
BUILD, SEARCH = 48, 96
_INDEX = "dims int, shard int, n int, vectors binary, ids binary, offsets binary, nodes array<binary>, links array<binary>"


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and a vector without NULL or non-finite parts that is not zero."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<float>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & v.isNotNull()).where(fine)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1)[:, None] + (b * b).sum(-1)[None] - 2 * (a @ b.T)


def _level(x: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Flat neighbour array (len(nodes), most) of one level, -1 where there is none; entries are places in ``nodes``.

    Each node gets diverse near neighbours: a candidate closer to a chosen neighbour than to the node is passed over
    while others are left. Edges go both ways; a node with too many keeps its nearest.
    """
    v = x[nodes].astype(np.float64)
    n = len(nodes)
    out = np.full((n, most), -1, np.int32)
    if n < 2:
        return out
    k = min(BUILD, n - 1)
    heads, tails, lengths = [], [], []
    for s in range(0, n, 256):
        d = _squares(v[s:s + 256], v)
        rows = np.arange(len(d))
        d[rows, s + rows] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        dist = np.take_along_axis(d, near, 1)
        w = v[near]
        among = (w * w).sum(-1)
        among = among[:, :, None] + among[:, None, :] - 2 * (w @ w.transpose(0, 2, 1))
        chosen = np.zeros(near.shape, bool)
        for c in range(k):
            closer = (among[:, c, :c] < dist[:, c, None]) & chosen[:, :c]
            chosen[:, c] = ~closer.any(axis=1) & (chosen[:, :c].sum(axis=1) < most)
        # what is left of the places goes to the nearest that were passed over
        rank = np.argsort(~chosen, axis=1, kind="stable")[:, :most // 2]
        pick = chosen.copy()
        np.put_along_axis(pick, rank, True, 1)
        r, c = np.nonzero(pick)
        heads.append(s + r)
        tails.append(near[r, c])
        lengths.append(dist[r, c])
    a, b, d = np.concatenate(heads), np.concatenate(tails), np.concatenate(lengths)
    a, b, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    _, once = np.unique(a * n + b, return_index=True)
    a, b, d = a[once], b[once], d[once]
    order = np.lexsort((b, d, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < most
    out[a[keep], place[keep]] = b[keep]
    return out


def build(x: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes and flat neighbour arrays of each level, ground first. Levels are drawn as floor(-ln(u) / ln(M))."""
    rng = np.random.default_rng(seed)
    tall = np.floor(-np.log(1 - rng.random(len(x))) / math.log(M)).astype(int)
    nodes, links, level = [], [], 0
    while True:
        here = np.flatnonzero(tall >= level)
        if level and not len(here):
            break
        nodes.append(here.astype(np.int32))
        links.append(_level(x, here, M if level else 2 * M))
        level += 1
    return nodes, links


def _beam(x, nodes, links, q, entry: np.ndarray, width: int):
    """Best-first search of one level for a block of queries; entry (queries, any) and result (queries, width) are nodes."""
    count = len(q)
    width = min(width, len(nodes))
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, len(nodes)), bool)
    v = x[nodes]

    def distances(at):
        gap = v[at] - q[:, None, :]
        return np.einsum("qcd,qcd->qc", gap, gap)

    beam = entry[:, :max(1, min(entry.shape[1], width))]
    beam_d = distances(beam)
    seen[rows, beam] = True
    open_ = np.ones(beam.shape, bool)
    step = 4
    while open_.any():
        ahead = np.where(open_, beam_d, np.inf)
        go = np.argsort(ahead, axis=1, kind="stable")[:, :step]
        live = np.take_along_axis(open_, go, 1)
        np.put_along_axis(open_, go, False, 1)
        more = links[np.take_along_axis(beam, go, 1)]
        more = np.where(live[:, :, None], more, -1).reshape(count, -1)
        fresh = more >= 0
        more = np.where(fresh, more, 0)
        fresh &= ~seen[rows, more]
        order = np.sort(np.where(fresh, more, len(nodes)), axis=1)  # once each
        fresh = order < len(nodes)
        fresh[:, 1:] &= order[:, 1:] != order[:, :-1]
        if not fresh.any():
            continue
        cols = np.argsort(~fresh, axis=1, kind="stable")[:, :fresh.sum(axis=1).max()]
        fresh = np.take_along_axis(fresh, cols, 1)
        more = np.where(fresh, np.take_along_axis(order, cols, 1), 0)
        r, c = np.nonzero(fresh)
        seen[r, more[r, c]] = True
        d = np.where(fresh, distances(more), np.inf)
        beam, beam_d = np.concatenate([beam, more], 1), np.concatenate([beam_d, d], 1)
        open_ = np.concatenate([open_, fresh], 1)
        if beam.shape[1] > width:
            best = np.argsort(beam_d, axis=1, kind="stable")[:, :width]
            beam, beam_d, open_ = (np.take_along_axis(z, best, 1) for z in (beam, beam_d, open_))
    best = np.argsort(beam_d, axis=1, kind="stable")
    return np.take_along_axis(beam, best, 1), np.take_along_axis(beam_d, best, 1)


def search(x: np.ndarray, nodes: list, links: list, q: np.ndarray, width: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` near each query, nearest first, down from the top level; second: whether the entry is a row at all."""
    entry = np.tile(np.arange(min(len(nodes[-1]), 16)), (len(q), 1))
    for level in range(len(nodes) - 1, -1, -1):
        found, d = _beam(x, nodes[level], links[level], q, entry, width if level == 0 else width // 3)
        if level:
            entry = np.searchsorted(nodes[level - 1], nodes[level][found])
    return nodes[0][found], np.isfinite(d)


def build_index(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """One row per shard: vectors, their ids, and the graph of every level as flat arrays; stored in the shared folder.

    Equal vectors are one entry with its k + 1 smallest ids, which is all that a search for k neighbours can return of
    them. Entries are dealt to shards of about ``shard`` by hash, so no shard grows with the data or with a hot vector.
    """
    once = vectors.distinct()
    few = once.withColumn("_r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(
        F.col("_r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    few = stored(few.withColumn("dims", F.size("embedding")), "vectors")
    shards = max(1, -(-few.count() // shard))
    dealt = few.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.embedding.to_numpy()).astype(np.float32)
        order = np.lexsort((pdf.ids.map(lambda i: i[0]).to_numpy(),))  # the same graph however rows arrive
        x, ids = x[order], pdf.ids.to_numpy()[order]
        nodes, links = build(x, int(key[1]))
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        return pd.DataFrame([[int(key[0]), int(key[1]), len(x), x.tobytes(), np.concatenate(ids).astype(np.int64).tobytes(),
                              offsets.tobytes(), [a.tobytes() for a in nodes], [a.tobytes() for a in links]]],
                            columns=["dims", "shard", "n", "vectors", "ids", "offsets", "nodes", "links"])

    return stored(dealt.groupBy("dims", "shard").applyInPandas(make, _INDEX), "hnsw")


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by Euclidean distance in double precision, ties to smaller ids.

    Queries (vec_id, embedding) form blocks of bounded size, a copy of each block for each shard of the same dimension.
    A shard's neighbours are merged by an aggregate that keeps k rows of a query before it shuffles.
    """
    queries = queries.distinct()
    blocks = max(1, -(-queries.count() // block))
    packed = queries.withColumn("dims", F.size("embedding")).groupBy(
        "dims", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    names = index.groupBy("dims").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    copies = packed.join(names, "dims").select("dims", "queries", F.explode("shards").alias("shard"))
    pairs = copies.join(index, ["dims", "shard"])

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                x = np.frombuffer(row.vectors, np.float32).reshape(row.n, row.dims)
                ids, offsets = np.frombuffer(row.ids, np.int64), np.frombuffer(row.offsets, np.int64)
                nodes = [np.frombuffer(b, np.int32) for b in row.nodes]
                links = [np.frombuffer(b, np.int32).reshape(len(a), -1) for a, b in zip(nodes, row.links)]
                names_ = np.array([q["vec_id"] for q in row.queries], np.int64)
                q = np.array([q["embedding"] for q in row.queries], np.float32)
                found, there = search(x, nodes, links, q, max(width, 2 * k + 2))
                gap = x[found].astype(np.float64) - q[:, None, :].astype(np.float64)
                exact = np.sqrt((gap * gap).sum(-1))
                out = []
                for i, name in enumerate(names_.tolist()):
                    at = found[i][there[i]]
                    d = np.repeat(exact[i][there[i]], offsets[at + 1] - offsets[at])
                    own = np.concatenate([ids[offsets[a]:offsets[a + 1]] for a in at.tolist()])
                    d, own = d[own != name], own[own != name]
                    best = np.lexsort((own, d))[:k]
                    out.append(pd.DataFrame({"query_id": name, "vec_id": own[best], "score": d[best]}))
                yield pd.concat(out, ignore_index=True)

    spark = index.sparkSession
    found = pairs.repartition("dims", "shard").mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, shard: int = SHARD, width: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by ``every``.

    Rows without an id, and vectors that are NULL, empty, zero or hold NULL or non-finite parts, take no part. Vectors are
    compared with those of the same dimension. A query is no candidate of its own; rows that repeat an id and vector
    count once. Fewer candidates than k: all of them. Ties go to the smaller vec_id. Empty input: empty. Other columns are
    not read.
    """
    rows = usable(embeddings)
    return search_index(build_index(rows, k, shard), rows.where(F.col("vec_id") % every == 0), k, width)
