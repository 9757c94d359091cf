"""Toxicity by a classifier chain: categories in order, each model fed the probabilities of the categories before it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import by_bytes, map_texts
from palimpsest.llm.words import Words

#: hashed features, bytes of a word's beginning that is a feature beside the word
BITS, PREFIX = 18, 5
#: labelled rows that models are fitted on at most, half of them with the last category where there are as many
SAMPLE = 12_000
FOLDS, ROUNDS, RIDGE, EVIDENCE = 3, 100, 1e-4, 4.5


def features(texts: list, bits: int = BITS, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each text: its words and their first bytes, hashed. A-Z are lower-cased,
    ASCII punctuation parts words."""
    found = Words([None if t is None else t.translate(_PLAIN) for t in texts], lower=True)
    keys = np.concatenate([found.hash, found.prefix(prefix) ^ np.uint64(0x5BD1E9955BD1E995)])
    pairs = np.unique(np.concatenate([found.row, found.row]).astype(np.int64) << bits | (keys >> np.uint64(64 - bits)).astype(np.int64))
    return pairs >> bits, pairs & ((1 << bits) - 1)


#: ASCII punctuation parts words
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() or chr(b).isspace() else 32 for b in range(256))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Logistic regression on hashed features, scaled by the root of their number in a row, and a few dense columns."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def score(self, row, feature, n: int, extra: np.ndarray) -> np.ndarray:
        total = np.bincount(row, self.weights[feature], n)
        return total + extra @ self.dense + self.bias

    def probability(self, row, feature, n: int, extra: np.ndarray) -> np.ndarray:
        return _sigmoid(self.score(row, feature, n, extra))


def fit(row, feature, n: int, extra: np.ndarray, y: np.ndarray, size: int, rounds: int = ROUNDS, ridge: float = RIDGE) -> Linear:
    """Full-batch gradient steps with a step size per weight (Adagrad); the classes weigh the same.

    Only features whose share of rows differs between the classes by at least ``EVIDENCE`` standard errors get a weight:
    the rare words of a document are far more than the rows and would be learnt by heart.
    """
    ones, all_ = np.bincount(feature, y[row], size), np.bincount(feature, minlength=size)
    n1, n0 = max(1.0, y.sum()), max(1.0, n - y.sum())
    share_all = np.clip(all_ / max(1, n), 1e-9, 1 - 1e-9)
    z = (ones / n1 - (all_ - ones) / n0) / np.sqrt(share_all * (1 - share_all) * (1 / n1 + 1 / n0))
    kept = (np.abs(z) >= EVIDENCE)[feature]
    row, feature = row[kept], feature[kept]
    weights, dense, bias = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    seen = [np.full(size, 1e-8), np.full(extra.shape[1], 1e-8), 1e-8]
    share = max(1, y.sum()), max(1, n - y.sum())
    cost = np.where(y == 1, 0.5 / share[0], 0.5 / share[1])
    for _ in range(rounds):
        p = _sigmoid(np.bincount(row, weights[feature], n) + extra @ dense + bias)
        slope = (p - y) * cost
        g = np.bincount(feature, slope[row], size) + ridge * weights / n
        e, b = extra.T @ slope, slope.sum()
        seen[0] += g * g
        seen[1] += e * e
        seen[2] += b * b
        weights -= 0.5 * g / np.sqrt(seen[0])
        dense -= 0.5 * e / np.sqrt(seen[1])
        bias -= 0.5 * b / np.sqrt(seen[2])
    return Linear(weights, dense, bias)


def fit_chain(row, feature, n: int, labels: np.ndarray, fold: np.ndarray, size: int) -> list[Linear]:
    """One model per category (columns of labels). What a later model sees of the earlier ones in training are
    out-of-fold probabilities: each row's come from models that were not fitted on it."""
    chain, extra = [], np.zeros((n, 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        out = np.zeros(n)
        for f in range(FOLDS if c + 1 < labels.shape[1] else 0):
            held = fold == f
            part = ~held[row]
            place = (np.cumsum(~held) - 1).astype(np.int32)
            model = fit(place[row[part]], feature[part], int((~held).sum()), extra[~held], y[~held], size)
            out[held] = model.probability(row, feature, n, extra)[held]
        chain.append(fit(row, feature, n, extra, y, size))
        extra = np.column_stack([extra, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, bits: int = BITS) -> list[Linear]:
    """The chain, fitted on up to ``sample`` labelled documents: those whose id hashes lowest, from each class of the last
    category alike, so far as there are. The number of folds divides them by another hash.

    Only documents of the sample are turned into features, in tasks; the driver receives their feature numbers and
    labels and fits the linear models.
    """
    last = categories[-1]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        *[F.max(F.col(c).cast("int")).alias(c) for c in categories]).na.drop()
    order = F.xxhash64("_id", F.lit(7))
    positive, negative = [known.where(F.col(last) == v).orderBy(order).limit(sample // 2) for v in (1, 0)]
    chosen = positive.unionByName(negative)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", T.ArrayType(T.IntegerType()))])

    def run(ids, texts):
        row, feature = features(texts, bits)
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        return {"doc_id": ids, "features": [feature[a:b].astype(np.int32) for a, b in zip(cut, cut[1:])]}

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        chosen, F.col("doc_id") == F.col("_id"))
    made = map_texts(picked, "doc_id", "text", run, schema).join(chosen, F.col("doc_id") == F.col("_id")).select(
        "features", *categories, F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(FOLDS)).alias("fold"), order.alias("order")).toArrow().sort_by("order")
    size = 1 << bits
    if not made.num_rows:
        return [Linear(np.zeros(size), np.zeros(c), -30.0) for c in range(len(categories))]
    lists = made["features"].combine_chunks()
    feature = lists.flatten().to_numpy()  # 32-bit, as are the rows: the two largest arrays of the driver
    row = np.repeat(np.arange(made.num_rows, dtype=np.int32), lists.value_lengths().to_numpy())
    y, fold, n = np.column_stack([made[c].to_numpy() for c in categories]), made["fold"].to_numpy(), made.num_rows
    del made, lists
    return fit_chain(row, feature, n, y, fold, size)


def probabilities(texts: list, chain: list[Linear], bits: int = BITS) -> np.ndarray:
    """Probability of each category for each text; a text without words has 0 for all."""
    row, feature = features(texts, bits)
    n = len(texts)
    out = np.zeros((n, 0))
    for model in chain:
        out = np.column_stack([out, model.probability(row, feature, n, out)])
    out[np.bincount(row, minlength=n) == 0] = 0
    return out


def scored(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), threshold: float = 0.7,
           sample: int = SAMPLE) -> DataFrame:
    """The documents with a probability ``p_<category>`` for each category and ``rejected``: the last one's is at least
    ``threshold``.

    labels: doc_id and a 0/1 column per category; rows with a NULL among these are left out, of rows that repeat an id the
    larger values count. NULL and empty texts have probability 0. Without labelled rows nothing is rejected. Rows
    that repeat a doc_id are scored one by one. Other columns stay as they are; those with the names of the new ones give
    way. Scoring streams whole texts and shuffles nothing; the models' size is fixed (one weight per hashed feature).
    """
    categories = list(categories)
    chain = docs.sparkSession.sparkContext.broadcast([(m.weights.astype(np.float32), m.dense, m.bias) for m in train(docs, labels, categories, sample)])
    names = [f"p_{c}" for c in categories]
    docs = docs.drop(*names, "rejected")
    at = docs.columns.index("text")
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField("rejected", T.BooleanType())])

    def run(batches):
        models = [Linear(*m) for m in chain.value]
        for part in by_bytes(batches, at):
            p = probabilities(part.column(at).cast(pa.binary()).to_pylist(), models)
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= threshold)], names=schema.names)

    return docs.mapInArrow(run, schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The label table (doc_id, quality, toxic) with the categories of the chain: low_quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
