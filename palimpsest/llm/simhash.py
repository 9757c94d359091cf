"""Near-duplicate documents by SimHash fingerprints and multi-index hashing."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import components, map_texts, stored

#: shingles hashed at once; bounds the memory of one very long text
_BLOCK = 65_536
#: rows of one bucket that a single task compares; fuller buckets are dealt out as pairs of blocks
_BUCKET = 20_000
_SEED = 42


def _simhash(tokens: list[bytes], words: int, distinct: bool) -> int:
    """The SimHash of the ``words``-word shingles of a text, as a signed 64-bit number; 0 without words."""
    n = max(1, len(tokens) - words + 1) if tokens else 0
    if distinct:
        shingles = list({b" ".join(tokens[i:i + words]) for i in range(n)})
        n = len(shingles)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _BLOCK):
        part = shingles[start:start + _BLOCK] if distinct else (
            b" ".join(tokens[i:i + words]) for i in range(start, min(n, start + _BLOCK)))
        h = np.fromiter((digest(x, _SEED) for x in part), np.uint64).byteswap()
        votes += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n).view(">u8").astype(np.uint64).view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, distinct: bool = False, check_words: int = 0) -> DataFrame:
    """(doc_id, fp, check) of whole texts. A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. ``check`` is a second
    fingerprint, of shingles of ``check_words`` words with repeats, or 0."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()),
                           T.StructField("check", T.LongType())])

    def run(ids, texts):
        tokens = [(t or b"").lower().split() for t in texts]
        return {"doc_id": ids, "fp": [_simhash(t, words, distinct) for t in tokens],
                "check": [_simhash(t, check_words, False) if check_words else 0 for t in tokens]}

    return map_texts(docs, "doc_id", "text", run, schema)


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of ``count`` segments of 64 bits.

    If two fingerprints differ in at most ``distance`` = count * s + a bits (a < count), then one of the first a + 1
    segments differs in at most s bits, or one of the others in at most s - 1. Segments of radius -1 are not needed.
    """
    s, a = divmod(distance, count)
    out, shift = [], 0
    for k in range(count):
        width = 64 // count + (k < 64 % count)
        out.append((shift, width, s if k <= a else s - 1))
        shift += width
    if max(r for *_, r in out) > 1:
        raise ValueError("take more segments: balls of radius 2 and more are not enumerated")
    return [x for x in out if x[2] >= 0]


def _probes(distance: int, count: int):
    """Keys of a fingerprint: its own segment value, and those with one more bit set.

    Two values one bit apart meet in the bucket of the larger, so only half of each ball needs to be sent.
    """
    def keys(shift: int, width: int, radius: int):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        mine = F.array(value)
        if radius:
            clear = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(width)]), lambda bit: value.bitwiseAND(bit) == 0)
            mine = F.concat(mine, F.transform(clear, lambda bit: value.bitwiseOR(bit)))
        return F.transform(mine, lambda key: F.struct(F.lit(shift).alias("segment"), key.alias("value")))

    return F.concat(*[keys(*s) for s in segments(distance, count)])


def _forest(fp: np.ndarray, check: np.ndarray, ids: np.ndarray, distance: int, check_distance: int):
    """Edges that connect what is linked within one bucket, not more than a few per row.

    Most buckets hold few links: all pairs are compared, and links are the result as long as there are no more than four
    per row. Else a spanning forest is: each row reached is compared with what is still unreached.
    """
    heads, tails, count = [], [], 0
    step = max(1, (1 << 21) // len(fp))
    for s in range(0, len(fp), step):
        near = np.bitwise_count(fp[s:s + step, None] ^ fp[None, s:]) <= distance
        if check_distance < 64:
            near &= np.bitwise_count(check[s:s + step, None] ^ check[None, s:]) <= check_distance
        a, b = np.nonzero(near)
        a, b = a[a < b], b[a < b]
        heads.append(ids[s + a])
        tails.append(ids[s + b])
        count += len(a)
        if count > 4 * len(fp):
            break
    else:
        return heads, tails
    left = np.arange(len(fp))
    heads, tails = [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = (np.bitwise_count(fp[left] ^ fp[x]) <= distance) & (np.bitwise_count(check[left] ^ check[x]) <= check_distance)
            if near.any():
                new = left[near]
                left = left[~near]
                heads.append(np.full(len(new), ids[x]))
                tails.append(ids[new])
                stack.extend(new.tolist())
    return heads, tails


def _linked(fp, check, ids, starts, ends, distance, check_distance):
    """Links inside each run [start, end): small runs all at once by shifts, larger ones by a forest of their own."""
    heads, tails = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    sizes = ends - starts
    small = (sizes > 1) & (sizes <= 16)
    at = np.concatenate([np.arange(s, e) for s, e in zip(starts[small], ends[small])]) if small.any() else np.empty(0, np.int64)
    stop = np.repeat(ends[small], sizes[small])
    for shift in range(1, 16):
        keep = at + shift < stop
        at, stop = at[keep], stop[keep]
        if not len(at):
            break
        near = (np.bitwise_count(fp[at] ^ fp[at + shift]) <= distance) & (
            np.bitwise_count(check[at] ^ check[at + shift]) <= check_distance)
        heads.append(ids[at[near]])
        tails.append(ids[at[near] + shift])
    for s, e in zip(starts[sizes > 16], ends[sizes > 16]):
        h, t = _forest(fp[s:e], check[s:e], ids[s:e], distance, check_distance)
        heads += h
        tails += t
    return np.concatenate(heads), np.concatenate(tails)


def links(classes: DataFrame, distance: int, count: int, check_distance: int = 64) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at most ``distance`` bits apart; input (id, fp, check), ids unique.

    Every fingerprint is sent to the table of each segment under its own value and the values of a small Hamming ball.
    Tables are sorted inside partitions and compared bucket by bucket on complete distances. A bucket gives a spanning
    forest, never all its pairs. Buckets above a fixed size are cut into blocks, and each pair of blocks is a bucket.
    """
    rows = classes.select("id", "fp", "check", F.explode(_probes(distance, count)).alias("k")).select(
        "id", "fp", "check", "k.segment", "k.value")
    full = rows.groupBy("segment", "value").count().where(F.col("count") > _BUCKET).select(
        "segment", "value", F.ceil(F.col("count") / _BUCKET).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != mine)
    dealt = rows.join(stored(full, "full-buckets"), ["segment", "value"], "left").select(
        "id", "fp", "check", "segment", "value", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(others, lambda j: F.least(mine, j).cast("long") * (1 << 20) + F.greatest(mine, j)))).alias("part"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def flush(last: bool):
            table = pa.Table.from_batches(held)
            cols = [table.column(n).to_numpy() for n in ("id", "fp", "check", "segment", "value", "part")]
            ids, fp, check = cols[0], cols[1].view(np.uint64), cols[2].view(np.uint64)
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[3:]], axis=0)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(ids)]])
            held.clear()
            if not last:  # the last run may go on in the next batch
                held.extend(table.slice(int(starts[-1])).to_batches())
                starts, ends = starts[:-1], ends[:-1]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(fp, check, ids, starts, ends, distance, check_distance)],
                                              schema=schema)

        rows_held = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows_held += batch.num_rows
            if rows_held > 200_000:
                yield flush(False)
                rows_held = sum(b.num_rows for b in held)
        if held:
            yield flush(True)

    return dealt.repartition("segment", "value", "part").sortWithinPartitions("segment", "value", "part").mapInArrow(
        run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, count: int = 3, distinct: bool = False,
                    check_words: int = 0, check_distance: int = 64) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Texts become ``words``-word shingles, with repeats unless ``distinct`` (fewer words: the whole sequence); a fingerprint
    bit is set if it is set in over half of the shingles' XXH64. Fingerprints link at ``distance`` or fewer differing
    bits; with ``check_words``, only if fingerprints of shingles of so many words also differ in at most
    ``check_distance`` bits. NULL and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one
    class before anything is compared. A row without doc_id gets its fingerprint and a NULL component_id; rows that repeat
    a doc_id are kept and share links. Other columns are not read. Empty input: empty.
    """
    made = stored(fingerprints(docs, words, distinct, check_words), "fingerprints")
    classes = stored(made.where("doc_id is not null").groupBy("fp", "check").agg(F.min("doc_id").alias("id")), "classes")
    roots = components(links(classes, distance, count, check_distance))
    found = classes.join(roots, classes.id == roots.node, "left").select("fp", "check", F.coalesce("root", "id").alias("component_id"))
    same = (F.col("d.fp") == F.col("c.fp")) & (F.col("d.check") == F.col("c.check")) & F.col("d.doc_id").isNotNull()
    return made.alias("d").join(found.alias("c"), same, "left").select(
        "d.doc_id", F.lower(F.lpad(F.hex("d.fp"), 16, "0")).alias("fingerprint"), "component_id")
