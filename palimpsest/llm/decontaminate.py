"""Test items inside documents: size-partitioned MinHash containment search, verified on the shingles themselves."""

from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import by_bytes, map_texts
from palimpsest.llm.words import Words

#: hashes of sketches that one broadcast may hold (about 100 MB with the item texts); more items are searched in blocks
BLOCK = 2_000_000


def _needed(size: int, threshold: Fraction) -> int:
    """Shingles that an item of ``size`` shingles must share with a document."""
    return -(-threshold.numerator * size // threshold.denominator)


def _shingles(tokens: list[bytes], words: int) -> set[bytes]:
    width = min(words, len(tokens))
    return {b" ".join(tokens[i:i + width]) for i in range(len(tokens) - width + 1)} if width else set()


def sketches(rows: list[tuple[object, bytes | None]], words: int, threshold: Fraction):
    """(ids, shingle sets, widths, partitions) of the items of one block; a partition has the items of one shingle
    length and one size class [low, 2 low).

    An item of q shingles that shares at least ``need`` of them with a document shares one of any q - need + 1. So the
    q - need + 1 smallest hashes, its bottom-k MinHash, meet every document that contains it: no match is lost, and
    how much of a long document lies outside the item has no influence.
    """
    ids, sets, widths, parts = [], [], [], {}
    for item, text in rows:
        found = Words([text], lower=True)
        if not len(found):
            continue
        width = min(words, len(found))
        shingles = _shingles(found.bytes_of(0), words)
        hashes = np.unique(found.grams(width))
        keep = hashes[:len(shingles) - _needed(len(shingles), threshold) + 1]
        parts.setdefault((width, len(shingles).bit_length()), []).append((len(ids), keep))
        ids.append(item)
        sets.append(shingles)
        widths.append(width)
    made = []
    for (width, power), members in sorted(parts.items()):
        hashes = np.concatenate([k for _, k in members])
        items = np.repeat([i for i, _ in members], [len(k) for _, k in members])
        order = np.argsort(hashes, kind="stable")
        table = np.zeros(1 << 16, bool)
        table[hashes >> np.uint64(48)] = True
        made.append(SimpleNamespace(width=width, low=1 << (power - 1), ceiling=hashes.max(), hashes=hashes[order], items=items[order],
                                    table=table))
    return ids, sets, widths, made


def search(texts: list, block, threshold: Fraction) -> list[tuple[int, object, int, int]]:
    """(row, item id, item shingles, shared shingles) of the items that the texts contain."""
    ids, sets, widths, parts = block
    found = Words(texts, lower=True)
    pairs = [np.empty((0, 2), np.int64)]
    counts = np.bincount(found.row, minlength=len(texts))
    for width in sorted({p.width for p in parts}):
        grams, inside = found.grams(width), found.inside(width)
        for p in (p for p in parts if p.width == width):
            # a document with fewer shingles than the smallest item needs holds none of this partition
            able = counts - width + 1 >= _needed(p.low, threshold)
            at = np.flatnonzero((grams <= p.ceiling) & inside)
            at = at[p.table[grams[at] >> np.uint64(48)]]
            at = at[able[found.row[at]]]
            lo, hi = np.searchsorted(p.hashes, grams[at], "left"), np.searchsorted(p.hashes, grams[at], "right")
            many = hi - lo
            hit = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(at) else lo
            pairs.append(np.stack([np.repeat(found.row[at], many), p.items[hit]], axis=1))
    out, row, own = [], -1, {}
    for r, i in np.unique(np.concatenate(pairs), axis=0).tolist():
        if r != row:
            row, own, tokens = r, {}, found.bytes_of(r)
        width = widths[i]
        if width not in own:
            own[width] = {b" ".join(tokens[k:k + width]) for k in range(len(tokens) - width + 1)}
        shared = len(sets[i] & own[width])
        if shared >= _needed(len(sets[i]), threshold):
            out.append((r, ids[i], len(sets[i]), shared))
    return out


def _blocks(items: DataFrame, words: int, threshold: Fraction):
    """The benchmark as broadcasts of bounded size, one after the other."""
    spark = items.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK * 20)))
    for b in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text.encode() if r.text is not None else None) for r in part.toLocalIterator()]
        yield spark.sparkContext.broadcast(sketches(rows, words, threshold))


def contained(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment): items with at least ``threshold`` of their
    distinct ``words``-word shingles in a document.

    Texts are lower-cased (A-Z), words are ``[^\\x20\\x09-\\x0D]+``; an item of fewer words is one shingle of all its
    words. NULL, empty or blank items are contained in nothing, such documents contain nothing. NULL ids stay NULL;
    repeated rows give repeated results; other columns are not read. Whole documents are streamed once for each block of
    items; nothing is shuffled.
    """
    share = Fraction(str(threshold))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()),
                           T.StructField("item_shingles", T.IntegerType()), T.StructField("shared_shingles", T.IntegerType())])
    out = None
    for block in _blocks(items, words, share):
        def run(ids, texts, block=block):
            rows = search(texts, block.value, share)
            return {"doc_id": [ids[r[0]] for r in rows], **{n: [r[k] for r in rows] for k, n in enumerate(schema.names) if k}}

        found = map_texts(docs, "doc_id", "text", run, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def clean(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no item, all columns as they are; rules as in :func:`contained`."""
    share = Fraction(str(threshold))
    place = docs.columns.index("text")
    for block in _blocks(items, words, share):
        def run(batches, block=block):
            for batch in batches:
                for part in by_bytes([batch], place):
                    texts = part.column(place).cast(pa.binary()).to_pylist()
                    keep = np.ones(part.num_rows, bool)
                    keep[[r[0] for r in search(texts, block.value, share)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
