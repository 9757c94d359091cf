"""Substring dedup: word windows that an earlier document has too are removed."""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import BATCH_BYTES, by_bytes, stored
from palimpsest.llm.words import Words, window_min

#: words of the grams whose minimum names the shard of a window
_GRAM = 5
#: windows that one stored span holds at most
_SPAN = 64
#: occurrences from which the windows of a shard are dealt out one by one
_HOT = 5_000
#: spans of hot windows that one task remembers having sent
_MEMO = 200_000
#: the largest filter, in bits (32 MB); fuller ones let more spans through to the exact stage, no fewer
_MOST_BITS = 1 << 28


class Automaton:
    """A suffix automaton of word sequences, added in ascending order of their documents.

    A state keeps the document in which its sequences were first seen; matching statistics of a new sequence therefore
    tell, for each window of ``length`` words, the smallest document that has it.
    """

    def __init__(self, length: int):
        self.length = length
        self.next: list[dict] = [{}]
        self.link, self.size, self.doc = [-1], [0], [0]

    def _state(self, size, link, moves, doc):
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        self.doc.append(doc)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]), self.doc[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, doc: int) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:  # a prefix of this sequence is there already
                last = known if self.size[known] == self.size[last] + 1 else self._split(last, word, known)
                continue
            new, p = self._state(self.size[last] + 1, 0, {}, doc), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            last = new

    def first(self, words: list) -> list:
        """For each window of ``length`` words, the document that had it first, or None."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= self.length:
                while self.size[self.link[state]] >= self.length:
                    state = self.link[state]
                matched = min(matched, self.size[state])
            if i >= self.length - 1:
                out.append(self.doc[state] if matched >= self.length else None)
        return out


def _minimizers(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: the smallest gram hash in it, and whether the window lies in one row."""
    gram = min(_GRAM, length)
    grams = found.grams(gram)
    if len(found) < length:
        return np.empty(0, np.uint64), np.empty(0, bool)
    return window_min(grams, length - gram + 1), found.inside(length)


def _hits(filter_bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    size = np.uint64(len(filter_bits) * 64 - 1)
    hit = np.ones(len(keys), bool)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & size
        hit &= (filter_bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``m``: at least 16 bits a key, up to a fixed size. Built in the JVM, word by word."""
    count = keys.count()
    bits = min(_MOST_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("m", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32)]))
    words = keys.select(at.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _identified(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _scan(docs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(ids, text hashes, words, memo)`` over slices of the documents that have an id; the memo is a task's own."""
    def run(batches):
        memo: dict = {}
        for part in by_bytes(batches, 2):
            ids = part.column(0).to_numpy()
            yield fn(ids, part.column(1).to_numpy(), Words(part.column(2).cast(pa.binary()).to_pylist()), memo)

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, schema)


def _spans(docs: DataFrame, length: int, common, hot, texts: bool) -> DataFrame:
    """Spans of windows that may occur in two documents: (key, sh, doc_id, th, pos, n), or with ``texts`` the distinct spans
    of each slice of the input, (key, sh, doc_id, span).

    A span is a run of windows with one minimizer. Windows of hot minimizers are spans of their own, under a hash of the
    whole window. Equal windows of any two documents get equal keys. A task sends a hot window again only for a smaller document, so a
    window that occurs everywhere is a few rows a task.
    """
    schema = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("doc_id", pa.int64())] + (
        [("span", pa.binary())] if texts else [("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())]))

    def fn(ids, hashes, found, memo):
        m, inside = _minimizers(found, length)
        at = np.flatnonzero(inside)
        at = at[_hits(common.value, m[at])]
        key = m[at]
        alone = _hits(hot.value, key)
        key[alone] = found.grams(length)[at[alone]]
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1]) | alone[1:] | alone[:-1]
        begin = np.flatnonzero(cut)
        # long runs (repetitive texts) are cut
        run = np.diff(np.append(begin, len(at)))
        extra = np.concatenate([np.arange(b + _SPAN, b + r, _SPAN) for b, r in zip(begin[run > _SPAN], run[run > _SPAN])]
                               ) if (run > _SPAN).any() else np.empty(0, np.int64)
        begin = np.sort(np.concatenate([begin, extra])).astype(np.int64)
        run = np.diff(np.append(begin, len(at)))
        first = at[begin]
        last = first + run + length - 2
        row = found.row[first]
        spans = [b" ".join(found.buffer[a:b].split()) for a, b in zip(found.start[first].tolist(), found.end[last].tolist())] if len(first) else []
        sh = np.array([xxhash.xxh64_intdigest(s) for s in spans], np.uint64).view(np.int64)
        columns = [key[begin].view(np.int64), sh, ids[row]]
        if texts:  # equal spans once, with the smallest document
            order = np.lexsort((columns[2], columns[1], columns[0]))
            columns = [c[order] for c in columns]
            once = np.ones(len(order), bool)
            once[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            for i in np.flatnonzero(once & alone[begin][order]).tolist():
                span, doc = (int(columns[0][i]), int(columns[1][i])), int(columns[2][i])
                if memo.get(span, doc + 1) <= doc:
                    once[i] = False
                    continue
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[span] = doc
            columns = [c[once] for c in columns] + [pa.array([spans[i] for i in order[once].tolist()], pa.binary())]
        else:
            columns += [hashes[row], (first - found.first[row]).astype(np.int32), run.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return _scan(docs, fn, "key long, sh long, doc_id long" + (", span binary" if texts else ", th long, pos int, n int"))


def _firsts(spans: DataFrame, length: int) -> DataFrame:
    """(key, sh, firsts): for each window of a distinct span the smallest document that has it.

    Spans are dealt out by key once; what is equal has been combined before, slice by slice.
    """
    distinct = spans.repartition("key").groupBy("key", "sh", "span").agg(F.min("doc_id").alias("doc_id"))
    schema = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("firsts", pa.list_(pa.int64()))])

    def solve(group):
        if len(group) == 1:  # one sequence, whoever has it
            return [[group[0][2]] * (len(group[0][1].split()) - length + 1)]
        shard, out = Automaton(length), []
        for _, span, doc in group:
            words = span.split()
            firsts = shard.first(words)
            if None in firsts:
                shard.add(words, doc)
            out.append([doc if f is None else f for f in firsts])
        return out

    def run(batches):
        group, key = [], None
        for batch in batches:
            done = ([], [], [])

            def finish():
                if group:
                    done[0].extend([key] * len(group))
                    done[1].extend(g[0] for g in group)
                    done[2].extend(solve(group))

            for k, sh, span, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    finish()
                    group, key = [], k
                group.append((sh, span, doc))
            yield pa.RecordBatch.from_arrays([pa.array(d, t.type) for d, t in zip(done, schema)], schema=schema)
        done = ([], [], [])
        if group:
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(group)), pa.array([g[0] for g in group]),
                                              pa.array(solve(group), pa.list_(pa.int64()))], schema=schema)

    return distinct.sortWithinPartitions("key", "doc_id").select("key", "sh", "span", "doc_id").mapInArrow(
        run, "key long, sh long, firsts array<long>")


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, places): the windows of a document, by the place of their first word, that an earlier one has too."""
    spark = docs.sparkSession
    own = _identified(docs)

    def names(ids, hashes, found, memo):
        m, inside = _minimizers(found, length)
        at = np.flatnonzero(inside)
        key, row = m[at], found.row[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        return pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(ids[row[cut]])], names=["m", "doc_id"])

    shared = stored(_scan(own, names, "m long, doc_id long").groupBy("m").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("m", "n"), "shared")
    common = spark.sparkContext.broadcast(_filter(shared))
    hot = spark.sparkContext.broadcast(_filter(shared.where(F.col("n") > _HOT)))
    firsts = _firsts(_spans(own, length, common, hot, True), length)
    found = _spans(own, length, common, hot, False).join(firsts, ["key", "sh"])
    late = F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("firsts", k) < F.col("doc_id")),
                       lambda k: k + F.col("pos"))
    return found.select("doc_id", "th", late.alias("places")).where(F.size("places") > 0).groupBy("doc_id", "th").agg(
        F.flatten(F.collect_set("places")).alias("places"))


def deduplicated(docs: DataFrame, length: int = 13) -> DataFrame:
    """The documents with ``kept`` (words joined by one space), ``n_words`` and ``n_removed``; other columns as they are.

    Words ``[^\\x20\\x09-\\x0D]+`` stay unchanged. A word goes if one of the windows of ``length`` words that cover it
    has a word sequence which also starts in a document with a smaller doc_id; windows are judged on the input. NULL,
    empty and short texts have no window and lose nothing (``kept`` of NULL is ''). A NULL doc_id takes no part. Rows that
    repeat a doc_id do not count as earlier than one another. Ties cannot occur: only a smaller id counts. Input columns
    with the names of the new ones give way. Empty input: empty.

    Windows are dealt to shards by the smallest hash of the word grams they hold, so equal windows meet. A first pass
    finds minimizers of two documents or more and keeps them as a filter of bounded size; only spans under those travel.
    Each shard's distinct spans make a suffix automaton, in order of documents, and stream through it for matching
    statistics.
    """
    docs = docs.drop("kept", "n_words", "n_removed")
    places = repeated_windows(docs, length)
    rows = docs.join(places, (docs["doc_id"].cast("long") == places["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == places["th"]), "left")
    name = "_places"
    while name in docs.columns:
        name = "_" + name
    rows = rows.select(*[docs[c] for c in docs.columns], places["places"].alias(name))
    at = docs.columns.index("text")
    schema = T.StructType(list(docs.schema.fields) + [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()),
                                                      T.StructField("n_removed", T.LongType())])

    def run(batches):
        for part in by_bytes(batches, at, BATCH_BYTES):
            kept, n_words, n_removed = [], [], []
            for raw, where in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(part.num_columns - 1)):
                words = (raw or b"").split()
                n_words.append(len(words))
                if where.is_valid and len(where):
                    edges = np.zeros(len(words) + 1, np.int64)
                    places = np.unique(where.values.to_numpy())
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + length, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(kept, pa.string()), pa.array(n_words, pa.int64()),
                                              pa.array(n_removed, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
