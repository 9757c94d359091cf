"""Phrases, importance weights and quality rules against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash

from palimpsest.llm import collocations, importance, quality

EXTRA = "doc_id long, text string, lang string, n long, bucket string, rank string, score string, _u string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "b", "r", "s", "u") for i, t, g in rows], EXTRA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, names="abcdef"):
    return "".join(rng.choice(names) * rng.randint(1, 2) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(n))


def brute_collocations(rows, longest, support, cover, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    found = {k: v for k, v in f.items() if v >= support and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if any(len(q) > len(p) and g == lang and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (g, q), b in found.items()):
            continue
        score, k, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((g, r + 1, p.decode(), -a, x, y, n[g], -s) for g, v in out.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


@pytest.mark.parametrize("longest,support,budget,step", [(4, 6, 2_000_000, 200_000), (4, 3, 20, 5), (3, 4, 200, 200_000), (2, 4, 50, 9), (5, 5, 40, 30)])
def test_collocations(spark, monkeypatch, longest, support, budget, step):
    monkeypatch.setattr(collocations, "_STEP", step)
    rng = random.Random(longest)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["en", "en", "de", None])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, " \t\n", "fr"), (103, "É É é É É é É É é, A B\x01 A B\x01 A B\x02 c " * 9, "fr"), (104, "the end " * 300, "en"),
             (105, "x." * 50, "en"), (None, "a b c d", None)] + [(7, "a b c d e " * 4, "de")] * 5
    got = collocations.collocations(made(spark, rows), longest, support, 80, 12, budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, longest, support, 80, 12)


def test_collocations_without_candidates(spark):
    assert collocations.collocations(made(spark, [])).count() == 0
    assert collocations.collocations(made(spark, [(1, "one two three", "en"), (2, None, None)])).count() == 0


def test_groups_respect_the_budget(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-1 << 63, 1 << 63), rng.randint(1, 50)) for _ in range(3000)] + [(5, 10_000)]
    slots = collocations.groups(spark.createDataFrame(rows, "key long, n long"), 500)
    shift = 64 - (len(slots).bit_length() - 1)
    held = collections.Counter()
    for key, n in rows[:-1]:
        held[slots[(key % (1 << 64)) >> shift]] += n
    assert max(held.values()) <= 2 * 500 and len(held) > 100 and (slots[1:] >= slots[:-1]).all()


def brute_resampled(rows, target, longest, buckets, percent, least):
    def features(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t).encode())
        return len(w), [zlib.crc32(b" ".join(w[i:i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    found = [(i, *features(t)) for i, t in rows]
    s, t = collections.Counter(b for *_, f in found for b in f), collections.Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out, able = [], []
    for i, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                able.append((-score, i, weight, len(f), len(out)))
        out.append([i, len(f), weight, score, None])
    for r, x in enumerate(sorted(able)[:len(able) * percent // 100]):
        out[x[-1]][-1] = r + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("longest,buckets,step", [(1, 10_000, 200_000), (1, 7, 3), (3, 500, 5), (2, 10_000, 200_000)])
def test_resampling(spark, monkeypatch, longest, buckets, step):
    monkeypatch.setattr(importance, "_STEP", step)
    monkeypatch.setattr(importance, "_MEMO", 4)
    rng = random.Random(longest * buckets)
    rows = [(i, prose(rng, rng.randint(0, 60), "abcXYZé9") + rng.choice(["", "\x00", "!a\x00b", "ß"])) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \x00 "), (103, "long é " * 5000), (None, "a b c " * 9), (None, None), (5, rows[7][1]), (5, rows[7][1]), (5, "other " * 30)]
    target = ["a b c é", None, "", "XyZ 9 9 9\x00a", "a b c é"]
    table = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    for percent, least in ((10, 20), (100, 1), (0, 0)):
        got = importance.resampled(made(spark, [(i, t, None) for i, t in rows]), table, longest, buckets, percent=percent, least_words=least)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(str(list(r)) for r in got.collect()) == brute_resampled(rows, target, longest, buckets, percent, least)
    assert importance.resampled(made(spark, []), table).count() == 0
    assert importance.resampled(made(spark, [(i, t, None) for i, t in rows]), table.limit(0)).count() == len(rows)


def brute_quality(rows, trusted, longest, buckets, mix=0.2, threshold=-0.4):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def hashed(w):
        x = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        return [(h - (1 << 64) if h >> 63 else h) % buckets for h in x]

    words = [word.findall(t or "") for _, t in rows]
    s, t = collections.Counter(), collections.Counter()
    for (i, _), w in zip(rows, words):
        s.update(hashed(w))
        if i in trusted:
            t.update(hashed(w))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: round(1e6 * math.log((t[b] / all_t) / (s[b] / all_s) * (1 - mix) + mix)) if all_t else 0 for b in s}
    out = []
    for (i, text), w in zip(rows, words):
        windows = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if word.search(x)]
        g = hashed(w)
        total = sum(gain[b] for b in g)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed,
                    round(total / len(g) / 1e6, 9) if g else 0.0, not failed and total >= threshold * 1e6 * len(g)))
    return sorted(map(str, out))


@pytest.mark.parametrize("longest,long,few,broadcast", [(1, 1 << 20, 64, 1_000_000), (1, 500, 1, 0), (3, 1 << 20, 0, 1_000_000), (2, 100, 64, 0)])
def test_quality_rules(spark, monkeypatch, longest, long, few, broadcast):
    monkeypatch.setattr(quality, "_LONG", long)
    monkeypatch.setattr(quality, "_FEW", few)
    monkeypatch.setattr(quality, "_BROADCAST", broadcast)
    rng = random.Random(longest + long)
    rows = [(i, prose(rng, rng.randint(0, 900), "abcdefghijklm" if i % 3 else "#$é") + rng.choice(["", "\n", "\x0c\n\n"])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n\r\n"), (103, "same line\n" * 30 + " same line\n"), (104, "𝄞 é| <b> " * 400), (105, "one two three " * 30), (106, "x" * 3000),
             (None, rows[4][1]), (4, rows[4][1]), (4, rows[4][1]), (107, "\n".join(rng.choice("abc") * 4 for _ in range(700)))]
    good = [1, 2, 4, 5, 7, 8, 8, 100, 500, None]
    docs = made(spark, [(i, t, None) for i, t in rows])
    key = lambda r: str((*r[:7], round(r.llr, 9), r.kept))
    for ids in (good, []):
        got = quality.judged(docs, spark.createDataFrame([(i, "x") for i in ids], "doc_id long, good string"), longest, 1 << 12)
        assert sorted(map(key, got.collect())) == brute_quality(rows, {i for i in ids if i is not None}, longest, 1 << 12)
    assert quality.judged(made(spark, []), docs.select("doc_id")).count() == 0


def test_quality_uses_no_python_worker(spark):
    made_ = quality.judged(made(spark, [(1, "a b", None)]), spark.createDataFrame([(1,)], "doc_id long"))
    assert not re.search("Python|Pandas|Arrow", made_._jdf.queryExecution().toString())
