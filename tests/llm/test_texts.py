"""Token counts, SentencePiece, toxicity and containment against libraries and brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm import decontaminate, sentencepieces, token_counts, toxicity
from palimpsest.llm.words import Words, window_min

DOCS = "doc_id long, text string, kept string"
ODD = [None, "", " ", "a  b", " lead", "trail ", "\n\ttabs\r\nand  more", "x<|endoftext|>y <|startoftext|>", "é ́a", "ΑΣ ΟΔΟΣ", "日本語 テキスト",
       "don't 's 12ab", "▁a b", "😀😀", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a b\x85c d", "<s> </s> <0x0A>"]


def made(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], schema)


def test_words():
    found = Words([b"a  b\n", None, b"", b"\xc3\xa9 a"])
    assert [found.buffer[s:e] for s, e in zip(found.start, found.end)] == [b"a", b"b", b"\xc3\xa9", b"a"]
    assert found.row.tolist() == [0, 0, 3, 3] and found.hash[0] == found.hash[3] != found.hash[1]
    assert found.inside(2).tolist() == [True, False, True]
    assert window_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]


def test_token_counts(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdeé'12,") for _ in range(rng.randint(1, 12))) for _ in range(400))
    texts = ODD + [long, "z" * 900, "ab " * 90 + "q" * 700 + " z" * 90, long.replace(" ", "\n\n")]
    library = Tokenizer.from_file(path)
    rows = token_counts.token_counts(made(spark, texts), path, limit=100, chunk=200, overlap=8).orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (want, len((text or "").encode()), want > 100)
    assert token_counts.token_counts(made(spark, []), path).count() == 0


def test_words_are_learned_without_the_punctuation_after_them():
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    learned, learn = [], counter._learn
    counter._learn = lambda words: learned.extend(words) or learn(words)
    text = "House, house. HOUSE! (house) house; don't x<|endoftext|> H\u0331, end|> A\u00e9. 3a: 's,"
    texts = [text, text.lower(), "house,"]
    assert counter.count([t.encode() for t in texts]) == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert learned.count(b"house") == 1 and not {b"House,", b"house.", b"HOUSE!", b"house;"} & set(learned)
    assert token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json")).tails == b""


def test_overlaps_widen():
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"), chunk=100, overlap=4)
    text = ("word " * 30 + "x" * 300 + " ") * 3
    assert counter.count([text.encode()]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)]
    assert counter.widened > 0


def test_long_runs_without_blanks_are_encoded_a_few_times():
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"), chunk=100, overlap=4)
    encoded, encode = [], counter._encoded
    counter._encoded = lambda text, a, b: encoded.append(b - a) or encode(text, a, b)
    text = "start " + "日本語x" * 3000 + " end" + " word" * 300
    assert counter.count([text.encode()]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)]
    assert sum(encoded) < 6 * len(text)


def test_chunks_by_token_offsets():
    counter = token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"), chunk=120, overlap=16)
    assert not counter.independent
    text = "Some words, then  more;\nand a longwordwithoutanyspaceatall " * 20
    assert counter.count([text.encode(), b"", None]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids), 0, 0]


def test_sentencepieces(spark):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("the in on re \n▁é日x_") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for row, text in zip(sentencepieces.encoded(made(spark, texts), path).orderBy("doc_id").collect(), texts):
        want = library.encode(text or "")
        assert row.ids == want and row.n_pieces == len(want) and row.round_trip
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
    assert sentencepieces.encoded(made(spark, []), path).count() == 0


def test_unigram_forward_scores():
    """Without merges the forward pass is Viterbi; every segmentation of short words is tried."""
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(30)} | {"a", "b"})
    model = object.__new__(sentencepieces.Pieces)
    model.piece, model.id = pieces, {p: i for i, p in enumerate(pieces)}
    model.score = [-rng.random() * 5 - len(p) for p in pieces]
    model.bpe, model.root, model.byte, model.unknown, model.memo, model.follows = False, None, None, 99, {}, {}
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["aXb"]
    model.encode_words(words)

    def best(word):
        if not word:
            return 0.0
        return max(model.score[model.id[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in model.id)

    for word in words[:-1]:
        ids = np.frombuffer(model.memo[word], "<i4").tolist()
        assert "".join(pieces[i] for i in ids) == word and sum(model.score[i] for i in ids) == pytest.approx(best(word))
    assert 99 in np.frombuffer(model.memo["aXb"], "<i4").tolist()


def test_containment(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 12, 30, 60) for _ in range(3)] + [None, "", "  "]
    texts = [None, "", "a"]
    for _ in range(80):
        parts = [" ".join(word() for _ in range(rng.randint(0, 200)))]
        if rng.random() < 0.7:
            item = (rng.choice(items) or "").split()
            for _ in range(rng.randint(0, len(item) // 8)):
                item[rng.randrange(len(item))] = "other"
            parts.insert(rng.randint(0, 1), " ".join(item).upper())
        texts.append("\n".join(parts))

    def shingles(text, k):
        w = (text or "").lower().split()
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, item in enumerate(items):
        k = min(5, len((item or "").split()))
        own = shingles(item, k) if k else set()
        want |= {(d, i, len(own & shingles(t, k)) / len(own)) for d, t in enumerate(texts) if own and 5 * len(own & shingles(t, k)) >= 4 * len(own)}
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.contained(made(spark, texts), benchmark)
    assert {(r.doc_id, r.item_id, r.containment) for r in found.collect()} == want and want
    clean = decontaminate.clean(made(spark, texts), benchmark)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want} and clean.columns == ["doc_id", "text", "kept"]
    assert decontaminate.contained(made(spark, texts), benchmark.limit(0)).count() == 0
    assert decontaminate.contained(made(spark, []), benchmark).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        words, poor, toxic = [rng.choice(vocabulary) for _ in range(30)], rng.random() < 0.4, False
        if poor:
            words += ["spam"] * 2
            toxic = rng.random() < 0.5
        if toxic:
            words[3] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(poor), int(toxic)))
    rows += [(2000, None, "x"), (2001, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rejected string")
    table = spark.createDataFrame(labels[:900] + labels[:5] + [(3000, 1, None), (None, 1, 1)], "doc_id long, low_quality int, toxic int")
    made_ = toxicity.scored(docs, table, sample=600).collect()
    by = {r.doc_id: r for r in made_}
    assert len(made_) == len(rows) and not by[2000].rejected and by[2001].p_toxic == 0
    held = [by[i].rejected == bool(labels[i][2]) for i in range(900, 1200)]
    assert sum(held) / len(held) > 0.97
    assert not any(r.rejected for r in toxicity.scored(docs, table.limit(0)).collect())
    assert toxicity.scored(docs.limit(0), table).count() == 0


def test_chain_is_fed_by_out_of_fold_probabilities(monkeypatch):
    """What the second model sees of the first is what models say that were not fitted on the row."""
    rng = np.random.default_rng(6)
    n = 600
    row = np.repeat(np.arange(n), 3)
    feature = rng.integers(0, 40, 3 * n)
    first = (np.bincount(row, feature < 12, n) + rng.normal(size=n) > 1).astype(int)
    labels, fold = np.column_stack([first, rng.integers(0, 2, n)]), rng.integers(0, 3, n)
    seen, fit = [], toxicity.fit

    def watched(*args, **options):
        seen.append(args)
        return fit(*args, **options)

    monkeypatch.setattr(toxicity, "fit", watched)
    chain = toxicity.fit_chain(row, feature, n, labels, fold, 40)
    assert [len(m.dense) for m in chain] == [0, 1]
    given = seen[-1][3][:, 0]
    inside = fit(row, feature, n, np.zeros((n, 0)), labels[:, 0].astype(float), 40).probability(row, feature, n, np.zeros((n, 0)))
    for f in range(3):
        rest = np.flatnonzero(fold != f)
        place = np.full(n, -1)
        place[rest] = np.arange(len(rest))
        part = fold[row] != f
        model = fit(place[row[part]], feature[part], len(rest), np.zeros((len(rest), 0)), labels[rest, 0].astype(float), 40)
        held = fold == f
        assert given[held] == pytest.approx(model.probability(row, feature, n, np.zeros((n, 0)))[held])
        assert np.abs(given[held] - inside[held]).max() > 1e-3
