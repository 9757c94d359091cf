"""SimHash, substring dedup, neighbours and components against brute force."""

import random

import numpy as np
import pytest

from palimpsest.llm import ann, common, simhash, substrings

DOCS = "doc_id long, text string, fp string, places string, kept string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    edges = spark.createDataFrame(pairs + [(None, 3), (5, 5)], "a long, b long")
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    want = joined(pairs, {n for p in pairs for n in p})
    assert {r.node: r.root for r in common.components(edges).collect()} == {n: want[n] for n in nodes}
    assert common.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("bucket,distance,count", [(20_000, 4, 3), (7, 4, 3), (20_000, 8, 6)])
def test_near_duplicates(spark, monkeypatch, bucket, distance, count):
    monkeypatch.setattr(simhash, "_BUCKET", bucket)
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (60, "a\x85b c"), (61, "A\x85B  c")]
    for g in range(12):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(40, 400))]
        for _ in range(rng.randint(1, 12)):
            some = list(words)
            for _ in range(rng.randint(0, 3)):
                some[rng.randrange(len(some))] = "new"
            rows.append((100 + len(rows), " ".join(some)))
    rows.append((100 + len(rows), "word " * 70_000))
    got = simhash.near_duplicates(made(spark, rows + rows[:6] + [(None, "one")]), distance=distance, count=count).collect()

    import xxhash
    prints = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    want = joined([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= distance], ids)
    assert len(got) == len(rows) + 7
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {(i, f"{prints[i]:016x}", want[i]) for i in ids}
    assert [(r.fingerprint, r.component_id) for r in got if r.doc_id is None] == [(f"{prints[3]:016x}", None)]
    assert simhash.near_duplicates(made(spark, [])).count() == 0


def test_segments_cover_all_distances():
    rng = random.Random(3)
    for distance, count in ((4, 3), (8, 6), (3, 2)):
        parts = simhash.segments(distance, count)
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance)))
            assert any((diff >> shift & ((1 << width) - 1)).bit_count() <= radius for shift, width, radius in parts)
    with pytest.raises(ValueError):
        simhash.segments(8, 2)


def brute_removal(rows, length):
    first = {}
    for i, t in rows:
        w = (t or "").split(" ")
        for k in range(len(w) - length + 1):
            s = tuple(w[k:k + length])
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").split()
        gone = {p for k in range(len(w) - length + 1) if first[tuple(w[k:k + length])] < i for p in range(k, k + length)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("length,hot,bits", [(13, 5_000, 1 << 28), (5, 2, 1 << 28), (13, 3, 1 << 16), (50, 5_000, 1 << 28)])
def test_substring_dedup(spark, monkeypatch, length, hot, bits):
    monkeypatch.setattr(substrings, "_HOT", hot)
    monkeypatch.setattr(substrings, "_MOST_BITS", bits)
    rng = random.Random(length)
    passages = [" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(n)) for n in (4, 12, 13, 14, 30, 60, 120)]
    rows = [(0, None), (1, ""), (2, "a a a a a a a a a a a a a a a a"), (3, "a " * 400 + "b")]
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice("abcdefg") * rng.randint(1, 4) for _ in range(rng.randint(1, 40)))
                 for _ in range(rng.randint(0, 5))]
        rows.append((10 + i, " ".join(parts)))
    rows += [(100 + i, rows[20][1]) for i in range(6)]
    want = brute_removal([(i, " ".join((t or "").split())) for i, t in rows], length)
    got = substrings.deduplicated(made(spark, rows + [rows[30], (None, rows[20][1])]), length)
    assert got.columns == ["doc_id", "text", "fp", "places", "kept", "n_words", "n_removed"]
    for r in got.collect():
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
        else:
            assert r.n_removed == 0 and r.text == rows[20][1]
    assert substrings.deduplicated(made(spark, []), length).count() == 0


def test_automaton_finds_first_documents():
    rng = random.Random(5)
    shard, first = substrings.Automaton(3), {}
    for doc in range(60):
        words = [rng.choice("ab") for _ in range(rng.randint(1, 12))]
        grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        assert shard.first(words) == [first.get(g) for g in grams]
        shard.add(words, doc)
        for g in grams:
            first.setdefault(g, doc)


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[300:500] = x[300]  # one common vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] + [1.0] * 15, 1), (5300, [None] * 16, 1), (None, [1.0] * 16, 1),
             (5400, [], 1), (5500, [1.0, 2.0], 1), (5501, [1.0, 3.0], 1), (100, x[100].tolist(), 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(table, every=50, k=10, shard=300).collect()
    queries = sorted({r.query_id for r in got})
    assert queries == list(range(0, 1200, 50)) + [5500]
    hits = 0
    for q in range(0, 1200, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [r.score for r in mine] == sorted(r.score for r in mine)
        assert all(r.score == pytest.approx(d[r.vec_id], rel=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(want))
    assert hits / 240 >= 0.9
    assert [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 5500] == [(1, 5501, 1.0)]
    assert ann.nearest(table.limit(0)).count() == 0


def similarity(a, b):
    def shingles(t):
        w = t.split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def copies():
    """Texts of near copies by four kinds of edits, similarity 0.5 to 1, some of them copies of copies."""
    rng, rows = random.Random(11), []
    new = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(3000)) for _ in range(n)]
    for _ in range(60):
        words = new(rng.randint(40, 500))
        rows.append((len(rows), " ".join(words)))
        for kind in ("append", "truncate", "replace", "scatter"):
            n = max(1, int(len(words) * rng.uniform(0.01, 0.3)))
            some, at = list(words), rng.randrange(len(words) - n)
            if kind == "append":
                some += new(n)
            elif kind == "truncate":
                some = some[:-n]
            elif kind == "replace":
                some[at:at + n] = new(n)
            else:
                for k in rng.sample(range(len(some)), max(1, n // 5)):
                    some[k] = "other"
            rows.append((len(rows), " ".join(some)))
    return rows


def grouped(spark, rows):
    import corpus_pipeline
    return {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, made(spark, rows), "").collect()}


def test_documents_below_the_similarity_stay(spark, copies):
    links = [(a, b) for k in range(0, len(copies), 5) for (a, s) in copies[k:k + 5] for (b, t) in copies[k:k + 5] if a < b and similarity(s, t) >= 0.8]
    alone = {i for i, _ in copies} - {x for p in links for x in p}
    root = joined(links, [i for i, _ in copies])
    kept = grouped(spark, copies)
    assert len(alone) > 20 and alone <= kept
    # no text goes that exact links alone would not remove
    assert {i for i in root if root[i] == i} <= kept


def test_candidates_of_one_bucket_are_all_decided(spark):
    """The first pairs of a full bucket fail, and links between others are still found."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(40):  # similar to its twin only
        some = list(words)
        for k in rng.sample(range(400), 25):
            some[k] = f"x{rng.randrange(5000)}"
        rows += [(2 * i, " ".join(some)), (2 * i + 1, " ".join(some[:200] + ["twin"] + some[201:]))]
    root = joined([(a, b) for a, s in rows for b, t in rows if a < b and similarity(s, t) >= 0.8], [i for i, _ in rows])
    assert grouped(spark, rows) == {i for i in root if root[i] == i}


def test_copies_are_found_wherever_they_differ(spark, copies):
    root = joined([(a, b) for k in range(0, len(copies), 5) for (a, s) in copies[k:k + 5] for (b, t) in copies[k:k + 5]
                   if a < b and similarity(s, t) >= 0.8], [i for i, _ in copies])
    assert grouped(spark, copies) == {i for i in root if root[i] == i}


def test_texts_that_share_an_id_stay_apart(spark):
    """3 ~ 5 (first text) and 5 (second text) ~ 9: one row of each pair stays."""
    import corpus_pipeline
    one, two, three = (" ".join(f"{c}{i}" for i in range(200)) for c in "abc")
    rows = [(3, one), (5, one + " more"), (5, two), (9, two + " more"), (7, three), (7, three), (7, "other text here")]
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, made(spark, rows), "").collect())
    assert got == [(3, one), (5, two), (7, three), (7, "other text here")]


def test_forest_connects_what_is_similar():
    from palimpsest.llm.nearcopies import forest
    rng = random.Random(13)
    for share in (0.02, 0.06, 0.11, 0.15, 0.3):
        common = rng.sample(range(1 << 60), 120)
        sets = [set(), {1}, {1}]
        for _ in range(60):
            some = common[:rng.randint(60, 120)]
            sets.append({rng.randrange(1 << 60) if rng.random() < share else x for x in some})
        values = [np.array(sorted(s), np.uint64) for s in sets]
        starts = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        ids = np.array(rng.sample(range(1000), len(sets)))
        a, b = forest(ids, starts, np.concatenate(values))
        assert len(a) < len(sets)
        want = [(ids[i], ids[j]) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and
                5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        assert joined(list(zip(a, b)), ids.tolist()) == joined(want, ids.tolist())


@pytest.mark.parametrize("shingles", [2_000_000, 20_000, 1_500])
def test_large_group_below_the_similarity_stays(spark, monkeypatch, shingles):
    """Texts of one template with 0.6 to 0.79 in common share many bands; none is a copy of another but for its own twin."""
    from palimpsest.llm import nearcopies
    monkeypatch.setattr(nearcopies, "_SHINGLES", shingles)
    rng = random.Random(14)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(2000 if shingles > 100_000 else 150):
        some = list(words)
        for k in range(2, 120, 30):  # four of five-word spans of its own
            some[k] = f"x{i}-{k}"
        rows.append((i, " ".join(some)))
    rows += [(10_000 + i, t + " end") for i, t in rows[:20]]
    found = [similarity(rows[0][1], t) for _, t in rows[1:9]]
    assert all(0.6 < s < 0.8 for s in found)
    assert grouped(spark, rows) == {i for i, _ in rows if i < 10_000}


def test_large_groups_are_taken_apart(spark, monkeypatch, copies):
    from palimpsest.llm import nearcopies
    want = grouped(spark, copies)
    monkeypatch.setattr(nearcopies, "_SHINGLES", 600)
    assert grouped(spark, copies) == want
