"""Resampling towards a target distribution: hashed n-gram importance weights and a draw without replacement."""

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import by_bytes, stored

#: lower-cased words: digits, letters and everything outside ASCII, as UTF-8 bytes
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: parts the texts of a batch; no word holds it
_SENTINEL = b"\x00"
#: words taken up at once, whatever the length of a text
_STEP = 200_000
#: distinct words whose checksum a task remembers
_MEMO = 200_000


class _Checksums(dict):
    """crc32 of words."""

    def __missing__(self, word):
        if len(self) >= _MEMO:
            self.clear()
        out = self[word] = zlib.crc32(word)
        return out


class Batch:
    """The words of a batch of texts, found in one pass over their concatenation."""

    def __init__(self, texts: list, longest: int, buckets: int, memo: dict):
        self.buffer = _SENTINEL.join((t or b"").lower() for t in texts)
        self.offsets = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])]).astype(np.int64)
        self.rows, self.longest, self.buckets, self.memo = len(texts), longest, buckets, memo
        self.n_words = np.zeros(self.rows, np.int64)

    def _steps(self) -> Iterator[tuple[list, list]]:
        words, starts = [], []
        for m in _WORD.finditer(self.buffer):
            words.append(m[0])
            starts.append(m.start())
            if len(words) >= _STEP:
                yield words, starts
                words, starts = [], []
        yield words, starts

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, bucket) of all runs of 1 to ``longest`` words inside one text, in arrays of bounded size.

        Offsets of the texts say to which one a word belongs; runs whose ends belong to two are masked.
        """
        tail: list[tuple[bytes, int]] = []  # the last words of the step before
        for words, starts in self._steps():
            row = np.searchsorted(self.offsets, np.array(starts, np.int64), side="right") - 1
            self.n_words += np.bincount(row, minlength=self.rows)
            old = len(tail)
            words = [w for w, _ in tail] + words
            row = np.concatenate([np.array([r for _, r in tail], np.int64), row])
            sums = [self.memo[w] for w in words]
            yield row[old:], np.array(sums[old:], np.int64) % self.buckets
            for size in range(2, self.longest + 1):
                sums = [zlib.crc32(b" " + w, s) for s, w in zip(sums, words[size - 1:])]  # of the run one word longer
                ends = np.arange(size - 1, len(words))
                inside = (row[ends - size + 1] == row[ends]) & (ends >= old)
                yield row[ends][inside], np.array(sums, np.int64)[inside] % self.buckets
            tail = list(zip(words, row.tolist()))[len(words) - self.longest + 1:] if self.longest > 1 else []


def counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Occurrences of each bucket in the column ``text`` of a table; each task sends one number a bucket."""
    def run(batches):
        total, memo = np.zeros(buckets, np.int64), _Checksums()
        for part in by_bytes(batches, 0):
            for _, bucket in Batch(part.column(0).cast(pa.binary()).to_pylist(), longest, buckets, memo).features():
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    made = texts.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "bucket long, n long")
    found = made.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both with one added to every bucket."""
    size, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (all_s + size)) / ((s + 1) * (all_t + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the weight is the floored mean gain of a text's features, 0 without any."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        memo, buckets = _Checksums(), len(sent.value)
        for part in by_bytes(batches, 1):
            batch = Batch(part.column(1).cast(pa.binary()).to_pylist(), longest, buckets, memo)
            n, total = np.zeros(batch.rows, np.int64), np.zeros(batch.rows, np.int64)
            for row, bucket in batch.features():
                n += np.bincount(row, minlength=batch.rows)
                np.add.at(total, row, sent.value[bucket])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(batch.n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10,
              least_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is NULL for those that are not drawn.

    A-Z are lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, features all runs of 1 to ``longest`` words of a text
    joined by one space, with repeats; a feature's bucket is its crc32 modulo ``buckets``. A bucket's gain compares the
    multinomial of ``target`` (a table with a text column) with that of all documents. The score adds a Gumbel number that
    depends on ``seed`` and doc_id, so the highest scores are a draw without replacement in proportion to
    exp(weight / 1000). Of the N documents with ``least_words`` words or more, floor(``percent`` * N / 100) are drawn, ties to the smaller
    doc_id; rows that repeat an id and a score follow by weight and n_features.

    NULL and empty texts have no features and weight 0. A NULL doc_id has no number of its own: its score is NULL, it is not drawn and
    not counted in N. Counts are of all rows, also of repeated ones. Other columns are not read. Empty documents: empty; an empty target: all
    gains come from the documents alone.
    """
    gain = gains(counts(docs, longest, buckets), counts(target, longest, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stored(weighted(docs, gain, longest).withColumn("score", F.col("weight") + noise), "weights")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    # scores are whole numbers in a range that the gains bound: their histogram is small whatever the number of documents
    heights = rows.where(able).groupBy("score").count().toArrow().sort_by([("score", "descending")])
    score, n = heights["score"].to_numpy(), heights["count"].to_numpy()
    drawn = int(n.sum()) * percent // 100
    above = np.cumsum(n) - n
    take = above < drawn
    cut = int(score[take][-1]) if drawn else None
    before = docs.sparkSession.createDataFrame(list(zip(score[take].tolist(), above[take].tolist())), "_score long, _above long")
    # only drawn rows are ordered, one score at a time: the noise of each doc_id spreads them over some ten thousand scores
    hot = rows.where(able & (F.col("score") >= F.lit(cut)))
    inside = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "weight", "n_features"))
    rank = hot.withColumn("_turn", inside).join(F.broadcast(before), F.col("score") == F.col("_score")).select(
        "doc_id", "n_features", "weight", "score", (F.col("_above") + F.col("_turn")).cast("long").alias("rank"))
    rank = rank.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~F.coalesce(able & (F.col("score") >= F.lit(cut)), F.lit(False)))
    return rank.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
