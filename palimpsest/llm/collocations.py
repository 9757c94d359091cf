"""Phrase collocations: frequent word sequences counted by vertical partitioning of a truncated suffix tree.

The texts are never sorted as a whole. Prefixes of one and two words are counted first; those that occur often enough are
packed into groups of about ``BUDGET`` suffixes; each group gets the suffixes that begin with its prefixes and builds its
subtrees on its own.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import by_bytes, stored
from palimpsest.llm.substrings import _filter, _hits
from palimpsest.llm.words import Words, mixed

#: suffixes that one group of prefixes holds; a prefix with more is dealt out by the word after it
BUDGET = 250_000
#: UTF-8 bytes of text whose equal sequences are combined before they are shuffled
_SLICE = 2 << 20
#: prefixes are packed by slots of their hash: this many at least and at most
_SLOT_BITS = 10, 22
#: rows that one step of building subtrees takes up
_STEP = 200_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


class _Pieces:
    """Words ``[^\\x20\\x09]+`` of the pieces of texts; sequences never leave their piece."""

    def __init__(self, langs: list, texts: list):
        self.words = Words(texts, lower=True, space=_BLANK | _BREAK)
        self.langs = np.array([x.encode() for x in langs], object)
        seed = np.array([xxhash.xxh64_intdigest(x) for x in self.langs.tolist()], np.uint64)
        hard = np.flatnonzero(_BREAK[self.words.data])
        row = self.words.row
        self.lang = seed[row]
        self.piece = np.searchsorted(hard, self.words.start) + (row.astype(np.int64) << 40)
        self._names = pa.array(self.langs.tolist(), pa.binary())
        # words and what is between them as one array over the buffer: word i is cell 2i
        edges = np.column_stack([self.words.start, self.words.end]).ravel().astype(np.int32)
        self._cells = pa.Array.from_buffers(pa.binary(), max(0, len(edges) - 1), [None, pa.py_buffer(edges), pa.py_buffer(self.words.buffer)])

    def __len__(self):
        return len(self.words)

    def keys(self, n: int) -> np.ndarray:
        """Hash of language and the ``n`` words from each word on."""
        return mixed(self.words.grams(n) ^ self.lang[:max(0, len(self) - n + 1)])

    def inside(self, n: int) -> np.ndarray:
        count = max(0, len(self) - n + 1)
        return self.piece[:count] == self.piece[n - 1:n - 1 + count]

    def word(self, at: np.ndarray) -> pa.Array:
        return self._cells.take(pa.array(2 * at))

    def phrase(self, at: np.ndarray, n: int) -> pa.Array:
        """The ``n`` words from each place on, joined by a space."""
        return pc.binary_join_element_wise(*[self.word(at + k) for k in range(n)], pa.scalar(b" ")) if n > 1 else self.word(at)

    def lang_of(self, at: np.ndarray) -> pa.Array:
        return self._names.take(pa.array(self.words.row[at]))


def _scan(docs: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches):
        for part in by_bytes(batches, 1, _SLICE):
            yield fn(_Pieces(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()))

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, schema)


def _texts(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


def words(docs: DataFrame) -> DataFrame:
    """(lang, phrase, n, key) of single words; a NULL phrase has the number of all words of the language."""
    def fn(p):
        keys, at, n = np.unique(p.keys(1), return_index=True, return_counts=True)
        langs, first, total = np.unique(p.lang, return_index=True, return_counts=True)
        where = np.concatenate([at, first]).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            p.lang_of(where), pa.concat_arrays([p.word(at), pa.nulls(len(first), pa.binary())]),
            pa.array(np.concatenate([n, total])), pa.array(np.concatenate([keys, langs]).view(np.int64))],
            names=["lang", "phrase", "n", "key"])

    return _scan(docs, fn, "lang binary, phrase binary, n long, key long").groupBy("lang", "phrase", "key").agg(
        F.sum("n").alias("n")).select(*_texts("lang", "phrase"), "n", "key")


def pairs(docs: DataFrame, frequent) -> DataFrame:
    """(lang, phrase, n, key) of pairs of words that are both in the filter ``frequent``."""
    def fn(p):
        good = _hits(frequent.value, p.keys(1))
        at = np.flatnonzero(p.inside(2) & good[:-1] & good[1:]) if len(p) else np.empty(0, np.int64)
        keys, first, n = np.unique(p.keys(2)[at], return_index=True, return_counts=True)
        at = at[first]
        return pa.RecordBatch.from_arrays([p.lang_of(at), p.phrase(at, 2), pa.array(n),
                                           pa.array(keys.view(np.int64))], names=["lang", "phrase", "n", "key"])

    return _scan(docs, fn, "lang binary, phrase binary, n long, key long").groupBy("lang", "phrase", "key").agg(
        F.sum("n").alias("n")).select(*_texts("lang", "phrase"), "n", "key")


def groups(prefixes: DataFrame, budget: int) -> np.ndarray:
    """The group of each slot of hashes: consecutive slots are packed until a group holds about ``budget`` suffixes.

    What the driver sees is one number a slot, and slots are bounded.
    """
    total = prefixes.agg(F.sum("n")).first()[0] or 0
    bits = min(_SLOT_BITS[1], max(_SLOT_BITS[0], (16 * total // budget).bit_length()))
    sums = prefixes.where(F.col("n") <= budget).groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slot")).agg(F.sum("n").alias("n")).toArrow()
    weight = np.zeros(1 << bits, np.int64)
    weight[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    # hot prefixes are spread over all slots
    weight += (int(total) - int(weight.sum())) >> bits
    return (np.cumsum(weight) // budget).astype(np.int32)


def suffixes(docs: DataFrame, longest: int, frequent, hot, slots) -> DataFrame:
    """(part, lang, w0, w1, .., n): the suffixes of up to ``longest`` words that begin with a frequent pair, those of a slice that are
    equal once, cut where the pair that ends them is not frequent; w0 is the pair. Suffixes of two words are left out."""
    names = [f"w{k}" for k in range(longest - 1)]

    def fn(p):
        count = len(p)
        pair = np.zeros(count, bool)
        two = p.keys(2)
        pair[:len(two)] = p.inside(2)
        at = np.flatnonzero(pair)
        pair[at] = _hits(frequent.value, two[at])
        depth = np.where(pair, 2, 0)
        for k in range(1, longest - 1):
            ahead = np.zeros(count, bool)
            ahead[:count - k] = pair[k:]
            depth[(depth == k + 1) & ahead] = k + 2
        size, out = np.uint64(64 - (len(slots.value).bit_length() - 1)), []
        for d in range(3, longest + 1):
            at = np.flatnonzero(depth == d)
            _, first, n = np.unique(p.keys(d)[at], return_index=True, return_counts=True)
            at = at[first]
            many = _hits(hot.value, two[at])
            part = slots.value[np.where(many, p.keys(3)[at], two[at]) >> size]
            rest = [p.word(at + k) if k < d else pa.nulls(len(at), pa.binary()) for k in range(2, longest)]
            out.append(pa.RecordBatch.from_arrays([pa.array(part), p.lang_of(at), p.phrase(at, 2), *rest, pa.array(n)], names=["part", "lang", *names, "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(map(len, out)) else out[0]

    return _scan(docs, fn, "part int, lang binary, " + ", ".join(f"{x} binary" for x in names) + ", n long")


def subtrees(rows: DataFrame, longest: int, support: int) -> DataFrame:
    """(lang, phrase, n) of the nodes below the prefixes, from three words on, with at least ``support`` suffixes below them.

    A group's suffixes arrive sorted: they are the leaves of its subtrees from left to right. How many columns neighbours
    share says where a node of each depth begins and ends, and its number is the sum of its leaves. No prefix is split
    between two steps, so a step holds what it takes up and the leaves of one prefix.
    """
    names = ["lang", *[f"w{k}" for k in range(longest - 1)]]

    def nodes(table: pa.Table):
        n = table.column("n").to_numpy()
        cols = [table.column(c).combine_chunks() for c in names]
        differs = np.zeros(len(n), bool)
        differs[0] = True
        langs, phrases, counts = [], [], []
        codes = [c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in cols]
        for depth, code in enumerate(codes):
            differs[1:] |= code[1:] != code[:-1]
            if depth < 2:  # the prefix itself is known
                continue
            begin = np.flatnonzero(differs)
            total = np.add.reduceat(n, begin)
            begin, total = begin[(total >= support) & (code[begin] >= 0)], total[(total >= support) & (code[begin] >= 0)]
            found = [cols[k].take(pa.array(begin)) for k in range(depth + 1)]
            langs.append(found[0])
            phrases.append(pc.binary_join_element_wise(*found[1:], pa.scalar(b" ")))
            counts.append(pa.array(total))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in (langs, phrases, counts)], names=["lang", "phrase", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= _STEP:
                table = pa.Table.from_batches(held).combine_chunks()
                lang, prefix = (table.column(c).combine_chunks() for c in ("lang", "w0"))
                codes = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in (lang, prefix)]
                other = np.flatnonzero((codes[0] != codes[0][-1]) | (codes[1] != codes[1][-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield nodes(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield nodes(pa.Table.from_batches(held))

    return rows.repartition("part").sortWithinPartitions("part", *names).mapInArrow(
        run, "lang binary, phrase binary, n long").select(*_texts("lang", "phrase"), "n")


def frequencies(docs: DataFrame, longest: int = 4, support: int = 30, budget: int = BUDGET) -> DataFrame:
    """(lang, phrase, size, n): every sequence of 1 to ``longest`` words with at least ``support`` occurrences, and for each language a
    row of size 0 with the number of all its words. A part of a frequent sequence is frequent, so what is cut away is never in one."""
    send = docs.sparkSession.sparkContext.broadcast
    single = stored(words(docs).where((F.col("n") >= support) | F.col("phrase").isNull()), "words")
    good = send(_filter(single.where("phrase is not null").select(F.col("key").alias("m"))))
    double = stored(pairs(docs, good).where(F.col("n") >= support), "pairs")
    found = [single.select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(1).alias("size"), "n"),
             double.select("lang", "phrase", F.lit(2).alias("size"), "n")]
    if longest > 2:
        frequent = send(_filter(double.select(F.col("key").alias("m"))))
        hot = send(_filter(double.where(F.col("n") > budget).select(F.col("key").alias("m"))))
        below = subtrees(suffixes(docs, longest, frequent, hot, send(groups(double, budget))), longest, support)
        found.append(below.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "n"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out, "frequencies")


def collocations(docs: DataFrame, longest: int = 4, support: int = 30, cover: int = 80, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A candidate is a
    sequence of 2 to ``longest`` words inside a piece with a >= ``support`` occurrences, overlaps counted. Cut after its first k
    words it scores floor(2000000 * a / (l + r)), l and r the occurrences of both parts; the lowest cut counts, of ties
    the smallest k. Candidates whose words lie inside any longer candidate with at least ``cover`` percent of their occurrences
    are left out. Order: score, then a, both descending, then the phrase by its bytes. n: all words of the language.

    A NULL lang is ``und``; a NULL text has no words. Repeated rows count as often; ids and other columns are not read. Empty
    input, or no candidate: empty. All arithmetic is on whole numbers.
    """
    counted = frequencies(docs, longest, support, budget)
    known = counted.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    candidates = counted.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    split = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(split, start, length), " ")

    sides = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("left"), part(F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("left"), part(k + 1, F.col("size") - k).alias("part")))))).alias("s")
    asked = candidates.select("lang", "phrase", "size", "a", sides).select("lang", "phrase", "size", "a", "s.*")
    # parts in longer candidates: as far as they are candidates themselves, that is from two words on
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda w: F.transform(
        F.sequence(F.lit(1), F.col("size") - w + 1), lambda i: part(i, w))))).alias("phrase")
    covered = candidates.where("size > 2").select("lang", inner, F.col("a").alias("longer")).groupBy("lang", "phrase").agg(
        F.max("longer").alias("longer"))
    number = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "size", "a").agg(*[
        F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("count"))).alias(f"{'l' if left else 'r'}{k}")
        for k in range(1, longest) for left in (True, False)])
    floors = [F.when(F.col("size") > k, F.struct(
        F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0)))").alias("score"),
        F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    best = F.array_min(F.filter(F.array(*floors), lambda x: x.isNotNull()))
    kept = cuts.join(covered, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * number("longer") < cover * number("a"))).select("lang", "phrase", "a", best.alias("b")).select(
        "lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counted.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
