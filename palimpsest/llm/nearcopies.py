"""Near copies by exact similarity of shingles; fingerprints and bands only say which texts are compared."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import by_bytes, components, map_texts, stored
from palimpsest.llm.simhash import _SEED, links
from palimpsest.llm.substrings import _filter, _hits
from palimpsest.llm.words import _FACTORS, Words, mixed

#: values hashed at once; bounds the memory of one very long text
_BLOCK = 8_192
#: shingles of the sets that one task compares at once; larger groups are taken apart
_SHINGLES = 2_000_000


def _shingles(texts: list, words: int) -> tuple[Words, list[np.ndarray]]:
    """The words of texts (A-Z lower-cased), and for each the sorted distinct hashes of its ``words``-word shingles; fewer words are one
    shingle, none are no shingle."""
    found = Words(texts, lower=True)
    grams, out = found.grams(words), []
    for a, b in zip(found.first.tolist(), found.first.tolist()[1:]):
        if b - a >= words:
            out.append(np.unique(grams[a:b - words + 1]))
        elif b > a:
            few = (found.hash[a:b] * _FACTORS[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(few + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return found, out


def _majority(h: np.ndarray) -> int:
    """The SimHash of distinct hashes, as a signed 64-bit number."""
    votes = np.zeros(64, np.int64)
    for start in range(0, len(h), _BLOCK):
        votes += np.unpackbits(h[start:start + _BLOCK].byteswap().view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h)).view(">u8").astype(np.uint64).view(np.int64)[0])


def _bands(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of ``bands`` bands of ``rows`` MinHash values each; none without shingles."""
    if not len(h) or not bands:
        return np.empty(0, np.int64)
    rng = np.random.default_rng(_SEED)
    factor, more, mix = (rng.integers(0, 1 << 64, bands * rows, np.uint64) | np.uint64(1) for _ in range(3))
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(h), _BLOCK):
        least = np.minimum(least, (h[None, start:start + _BLOCK] * factor[:, None] + more[:, None]).min(axis=1))
    least ^= least >> np.uint64(32)
    return (least * mix).reshape(bands, rows).sum(axis=1, dtype=np.uint64).view(np.int64)


def text_hash():
    """Tells apart rows that repeat a doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash")).alias("key"), "text")


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, content, n, fp, check, bands) of whole texts: ``content`` is a 128-bit hash of the n distinct
    ``words``-word shingles, ``check`` their SimHash, ``bands`` keys of their minima, ``fp`` the SimHash of the distinct words."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("content", T.BinaryType()),
        T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("check", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(keys, texts):
        found, sets = _shingles(texts, words)
        cut = found.first.tolist()
        return {"doc_id": [k["doc_id"] for k in keys], "text_hash": [k["text_hash"] for k in keys],
                "content": [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], "n": [len(h) for h in sets],
                "fp": [_majority(np.unique(found.hash[a:b])) for a, b in zip(cut, cut[1:])], "check": [_majority(h) for h in sets],
                "bands": [_bands(h, bands, rows) for h in sets]}

    return map_texts(_keyed(docs), "key", "text", run, schema)


def forest(ids: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Edges between sets with a Jaccard similarity of 0.8 or more that connect all such pairs; set i is values[starts[i]:starts[i + 1]].

    A set that is similar to x has one of the rarest fifth of x's values among its own rarest fifth. An index of these finds
    whom x is compared with; what has been reached is not compared again.
    """
    size = np.diff(starts)
    owner = np.repeat(np.arange(len(ids)), size)
    _, code, often = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    rarity = rank[code]
    rarity = rarity[np.lexsort((rarity, owner))]
    shared = np.empty(len(often), bool)
    shared[rank] = often > 1
    prefix = (np.arange(len(values)) - starts[owner] < (size - (4 * size + 4) // 5 + 1)[owner]) & shared[rarity]
    key, holder = rarity[prefix], owner[prefix]
    order = np.argsort(key, kind="stable")
    key, holder = key[order], holder[order]
    begin, end = np.searchsorted(key, np.arange(len(often))), np.searchsorted(key, np.arange(len(often)), side="right")
    left, flag = np.ones(len(ids), bool), np.zeros(len(often), bool)
    remaining, heads, tails = int(size.sum()), [], []
    for first in range(len(ids)):
        if not left[first]:
            continue
        left[first] = False
        remaining -= int(size[first])
        stack = [first]
        while stack and remaining:
            x = stack.pop()
            mine = rarity[starts[x]:starts[x + 1]]
            asked = mine[:size[x] - (4 * size[x] + 4) // 5 + 1]
            if int((end[asked] - begin[asked]).sum()) > remaining:
                near = np.flatnonzero(left)
            else:
                near = [holder[a:b] for a, b in zip(begin[asked].tolist(), end[asked].tolist()) if b - a > 1]
                near = np.unique(np.concatenate(near)) if near else np.empty(0, np.int64)
                near = near[left[near]]
            near = near[(5 * np.minimum(size[near], size[x]) >= 4 * np.maximum(size[near], size[x])) & (size[near] > 0)]
            if not len(near):
                continue
            flag[mine] = True
            both = np.add.reduceat(flag[np.concatenate([rarity[starts[c]:starts[c + 1]] for c in near.tolist()])].astype(np.int64),
                                   np.concatenate([[0], np.cumsum(size[near])[:-1]]))
            flag[mine] = False
            near = near[9 * both >= 4 * (size[near] + size[x])]
            left[near] = False
            remaining -= int(size[near].sum())
            heads += [ids[x]] * len(near)
            tails += ids[near].tolist()
            stack.extend(near.tolist())
    return heads, tails


def _buckets(classes: DataFrame) -> DataFrame:
    """(id, n, band, value) of classes (id, n, bands)."""
    return classes.select("id", "n", F.posexplode("bands").alias("band", "value"))


def _candidate_edges(classes: DataFrame, distance: int, count: int, check_distance: int) -> DataFrame:
    """Edges (a, b) that connect what shares a band, and what has near fingerprints; as many as there are such memberships."""
    rows = _buckets(classes)
    shared = rows.groupBy("band", "value").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("band", "value", "a")
    stars = rows.join(shared, ["band", "value"]).where("a < id").select("a", F.col("id").alias("b"))
    return stars.unionByName(links(classes.select("id", "fp", "check"), distance, count, check_distance)).distinct()


def _dealt(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, part, id): who is compared with whom. A component of candidates is one group if its sets are not too many; else each of its
    buckets is, equal ones once, and each near pair of fingerprints; fuller buckets go as pairs of blocks."""
    found = stored(components(edges).join(classes.select("id", "n", "bands"), F.col("node") == F.col("id")), "candidates")
    weight = found.groupBy("root").agg(F.sum("n").alias("weight"))
    small = found.join(weight.where(F.col("weight") <= _SHINGLES), "root").select(F.col("root").alias("key"), F.lit(0).cast("long").alias("part"), "id")
    large = weight.where(F.col("weight") > _SHINGLES)
    if large.isEmpty():
        return small
    rows = stored(_buckets(found.join(large, "root")), "large-groups")
    kinds = rows.groupBy("band", "value").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("id")).alias("who")).where("m > 1")
    once = kinds.groupBy("who", "m", "weight").agg(F.min(F.struct("band", "value")).alias("k")).select(
        "k.*", F.ceil(2 * F.col("weight") / _SHINGLES).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != mine)
    pairs = F.when(F.col("blocks") <= 2, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(others, lambda j: F.least(mine, j).cast("long") * (1 << 20) + F.greatest(mine, j)))
    parted = rows.join(once, ["band", "value"]).select(F.xxhash64("band", "value").alias("key"), F.explode(pairs).alias("part"), "id")
    inside = large.join(found.select("root", "node"), "root").select(F.col("node").alias("a"))
    near = edges.join(inside, "a").select(F.xxhash64("a", "b").alias("key"), F.lit(-1).cast("long").alias("part"), F.explode(F.array("a", "b")).alias("id"))
    return small.unionByName(parted).unionByName(near)


def similar(docs: DataFrame, classes: DataFrame, dealt: DataFrame, words: int) -> DataFrame:
    """Edges (a, b) of similarity 0.8 or more, a forest for each group of ``dealt``; sets are made again from the texts of those that
    are in a group, and no pair leaves its task unless it is an edge."""
    rows = stored(dealt.join(classes.select("id", "head"), "id").select("key", "part", "id", "head.*"), "dealt")
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(rows.select(F.col("text_hash").alias("m")).distinct()))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches):
        for part in by_bytes(batches, 1):
            key = part.column(0).flatten()
            at = np.flatnonzero(_hits(wanted.value, key[1].to_numpy().view(np.uint64)))
            if len(at):
                part = part.take(pa.array(at))
                doc_id, hashes = part.column(0).flatten()
                _, found = _shingles(part.column(1).cast(pa.binary()).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([doc_id, hashes, pa.array([h.view(np.int64) for h in found], schema.field(2).type)], schema=schema)

    def decided(batches):
        held, place, out = [], None, ([], [])

        def finish():
            ids = np.array([i for i, _ in held])
            _, one = np.unique(ids, return_index=True)  # rows that repeat doc_id and text
            chosen = [held[i][1] for i in one.tolist()]
            starts = np.concatenate([[0], np.cumsum([len(c) for c in chosen])])
            a, b = forest(ids[one], starts, np.concatenate(chosen))
            out[0].extend(a)
            out[1].extend(b)
            held.clear()

        for batch in batches:
            key, part, ids, shingles = batch.columns
            for k, p, i, row in zip(key.to_pylist(), part.to_pylist(), ids.to_pylist(), range(batch.num_rows)):
                if (k, p) != place and held:
                    finish()
                place = k, p
                held.append((i, shingles[row].values.to_numpy().copy()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
            out = [], []
        if held:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    texts = _keyed(docs).select("key", F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(sets, "doc_id long, text_hash long, shingles array<long>")
    return made.join(rows, ["doc_id", "text_hash"]).select("key", "part", "id", "shingles").repartition("key", "part").sortWithinPartitions(
        "key", "part").mapInArrow(decided, "a long, b long").where("a <> b")


def heads(docs: DataFrame, words: int, distance: int, count: int, check_distance: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash) of the row that stays of each group of near copies: the smallest by doc_id and text hash.

    Texts are linked if the Jaccard similarity of their distinct ``words``-word shingles is at least 0.8, and groups are
    what links connect. A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, fewer words than ``words`` are one
    shingle; shingles count as equal if their 64-bit hashes are. NULL and empty texts have none and are copies of each other.
    Texts of equal sets are one class before anything is compared. Candidates are classes with one of ``bands`` bands of ``rows``
    minima in common, which at similarity s has a chance of 1 - (1 - s^rows)^bands wherever texts differ, and those whose fingerprints
    are within ``distance`` bits and whose check fingerprints within ``check_distance``, found by multi-index hashing. Every candidate
    pair is decided on the sets: the sets are brought to their group, and only edges of a forest leave it, so a large group of near
    copies, linked or just below the similarity, costs no more rows than it has members. Rows without a doc_id take no part. Other columns
    are not read. Empty input: empty.
    """
    made = stored(sketches(docs, words, bands, rows), "sketches")
    classes = stored(made.groupBy("content").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("head"), *[F.first(c).alias(c) for c in ("n", "fp", "check", "bands")]).select(
        F.monotonically_increasing_id().alias("id"), "head", "n", "fp", "check", "bands"), "classes")
    edges = stored(_candidate_edges(classes, distance, count, check_distance), "candidate-edges")
    found = stored(similar(docs, classes, _dealt(classes, edges), words), "links")
    grouped = classes.join(components(found), F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("root", "id"))
    return grouped.groupBy("group").agg(F.min("head").alias("head")).select("head.*")
