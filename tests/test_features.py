"""Worked examples and invariants of the change features."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.editops import count_edits
from palimpsest.functions.jsontext import number_text, scalar_text
from palimpsest.functions.labels import blank_unchanged, parse_labels, pick_labels
from palimpsest.functions.text import adjacent_swap, mean_word_distance, tokens
from palimpsest.operators.pairs import pair_features
from palimpsest.operators.text_features import similarity_features, text_features
from palimpsest.operators.value_features import geo_features, quantity_features, time_features


@lru_cache(None)
def fewest_edits(old, new):
    """(edits, insertions, deletions, substitutions) that turn one text into the other, from the definition: an equal
    last character stays; else the last character is replaced, inserted or removed, whichever costs least in all, and
    in this order where costs tie."""
    if not old or not new:
        return len(old) + len(new), len(new), len(old), 0
    if old[-1] == new[-1]:
        return fewest_edits(old[:-1], new[:-1])
    ways = [(fewest_edits(old[:-1], new[:-1]), (1, 0, 0, 1)), (fewest_edits(old, new[:-1]), (1, 1, 0, 0)), (fewest_edits(old[:-1], new), (1, 0, 1, 0))]
    rest, step = min(ways, key=lambda w: w[0][0])
    return tuple(x + y for x, y in zip(rest, step))


def test_edit_counts_against_brute_force():
    rnd = random.Random(3)
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("cat", "dog"), ("tent", "tetn"), ("né😀", "ne😀😀")]
    pairs += [("".join(rnd.choices("abcÉ 😀", k=rnd.randint(0, 30))), "".join(rnd.choices("abcÉ 😀", k=rnd.randint(0, 30)))) for _ in range(500)]
    got = count_edits(*zip(*pairs)).tolist()
    assert got == [list(fewest_edits(a, b)[1:]) for a, b in pairs]


def test_edit_counts_of_long_texts():
    rnd = random.Random(4)
    a = "".join(rnd.choices("abcdefgh ", k=3000))
    b = a[:1000] + "xyz" + a[1200:]
    ins, dele, sub = count_edits([a], [b])[0]
    assert ins - dele == len(b) - len(a) and ins + dele + sub == 200


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "old_value string, new_value string")


def one(df):
    return df.first().asDict()


def test_text_features(spark):
    rows = [r.asDict() for r in text_features(texts(
        spark, ('"tent"', '"tetn"'), ('"cat"', '"dog"'), ('"a b"', '"a b c"'), ('"x"', "{}"), (None, '"x"'), ('""', '""')), extras=True).collect()]
    by = {r["old_value"]: r for r in rows}
    assert len(rows) == 4
    assert by['"tent"']["adjacent_char_swap"] == 1
    assert by['"cat"']["edit_distance_ratio"] == 1.0 and by['"cat"']["levenshtein_distance"] == 3 and by['"cat"']["complete_replacement"] == 1
    assert by['"a b"']["token_overlap"] == pytest.approx(2 / 3) and by['"a b"']["old_in_new"] == 1 and by['"a b"']["has_significant_prefix"] == 1
    assert by['"a b"']["char_insertions"] == 2
    empty = by['""']
    assert empty["token_overlap"] == 0 and empty["old_in_new"] == 1 and empty["structure_similarity"] is None and empty["avg_word_similarity"] == 0


def test_no_valid_rows_gives_an_empty_frame(spark):
    assert text_features(texts(spark, ("{}", '"a"'))).count() == 0


def test_adjacent_swap_and_words_on_random_texts(spark):
    rnd = random.Random(5)

    def swap(a, b):
        d = [i for i in range(len(a)) if a[i] != b[i]] if len(a) == len(b) else []
        return int(len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])

    pairs = []
    for _ in range(200):
        a = "".join(rnd.choices("aé😀b ", k=rnd.randint(1, 6)))
        i = rnd.randrange(len(a))
        b = a[:i] + a[i:i + 2][::-1] + a[i + 2:] if rnd.random() < 0.7 else "".join(rnd.choices("aé😀b ", k=len(a)))
        pairs.append((a, b))
    out = texts(spark, *pairs).select("old_value", "new_value", adjacent_swap(F.col("old_value"), F.col("new_value")).alias("s")).collect()
    assert [r["s"] for r in out] == [swap(r["old_value"], r["new_value"]) for r in out]
    words = texts(spark, ("ab cd", "ab xyz"), ("", "a")).select(
        mean_word_distance(tokens(F.col("old_value")), tokens(F.col("new_value"))).alias("w")).collect()
    assert [r["w"] for r in words] == [(0 + 3 + 2 + 3) / 4, 0.0]


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r["c"] for r in similarity_features(df, {"c": ("a", "b")}).collect()]
    assert got[0] == pytest.approx(2 ** -0.5) and got[1] is None


def date(spark, a, b):
    return one(time_features(texts(spark, (f'"{a}"', f'"{b}"')), extras=True))


def test_time_features(spark):
    r = date(spark, "+1910-02-10T00:00:00Z", "+1910-00-00T00:00:00Z")
    assert r["day_removed"] == 1 and r["month_removed"] == 1 and r["different_year"] == 0
    r = date(spark, "+1764-01-01T00:00:00Z", "+1764-00-00T00:00:00Z")
    assert r["placeholder_to_zero"] == 1
    r = date(spark, "+1950-00-00T00:00:00Z", "+1950-07-00T00:00:00Z")
    assert r["month_added"] == 1 and r["different_month"] == 0 and r["date_diff_days"] == 213
    r = date(spark, "-0100-00-00T00:00:00Z", "+0100-00-00T00:00:00Z")
    assert r["sign_change"] == 1 and r["different_year"] == 0 and r["date_diff_days"] == 73050
    r = date(spark, "somevalue", "+1950-00-00T00:00:00Z")
    assert r["date_diff_days"] == 1000 and r["different_year"] == 1 and r["different_day"] == 1 and r["day_added"] == 0
    r = date(spark, "+1950-07T", "+1951-07-01T00:00:00Z")
    assert r["date_diff_days"] == 1000 and r["different_year"] == 0


def quantity(spark, a, b, **options):
    return one(quantity_features(texts(spark, (f'"{a}"', f'"{b}"')), extras=True, **options))


def test_quantity_features(spark):
    r = quantity(spark, "+98", "+98.0")
    assert r["same_float_value"] == 1 and r["precision_change"] == 0 and r["precision_added"] == 1
    r = quantity(spark, "+222", "+222.4")
    assert r["precision_change"] == 1 and r["length_increase"] == 1 and r["old_is_prefix_of_new"] == 1
    r = quantity(spark, "-1", "+1")
    assert r["sign_change"] == 1 and r["whole_number_change"] == 0
    r = quantity(spark, "+222.4", "+222")
    assert r["length_decrease"] == 0 and r["precision_removed"] == 1
    assert quantity(spark, "+222.4", "+222", compat=False)["length_decrease"] == 1
    r = quantity(spark, "somevalue", "+1")
    assert r["sign_change"] == 0 and r["same_float_value"] == 0
    assert quantity(spark, "1d", "1")["same_float_value"] == 0


def test_geo_features(spark):
    r = one(geo_features(texts(spark, ('{"latitude":14,"longitude":121.917}', '{"latitude":14,"longitude":121.91666666667}'))))
    assert r["latitude_same_float_value"] == 1 and r["longitude_precision_change"] == 1 and r["longitude_length_increase"] == 0
    r = one(geo_features(texts(spark, ('{"latitude":14.55,"longitude":1}', '{"latitude":14.5,"longitude":-1}'))))
    assert r["latitude_length_decrease"] == 1 and r["longitude_sign_change"] == 1
    r = one(geo_features(texts(spark, ('"somevalue"', '{"latitude":14.5,"longitude":-1}'))))
    assert not any(v for k, v in r.items() if "tude_" in k)


def test_number_and_scalar_text(spark):
    df = spark.createDataFrame([('{"latitude": 14.10, "longitude": -3.0}', '"a"'), ("{}", "12.50"), (None, "{}")], "o string, s string")
    got = df.select(number_text(F.col("o"), "latitude").alias("a"), number_text(F.col("o"), "longitude").alias("b"),
                    scalar_text(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("14.1", "-3.0", "a"), (None, None, "12.50"), (None, None, None)]


def test_labels(spark):
    df = spark.createDataFrame([("a, b,c ", 0.2, 0.3), ("  ", 0.6, 0.5), (None, 0.4, 0.4)], "t string, p double, q double")
    got = df.select(parse_labels(F.col("t")).alias("l"), pick_labels([F.col("p"), F.col("q")], ["x", "y"]).alias("k")).collect()
    assert [(r["l"], r["k"]) for r in got] == [(["a", "b", "c"], "y"), ([], "x, y"), ([], "x")]
    axis = spark.createDataFrame([("1", "1.0"), ("", ""), ("1", "2")], "a string, b string")
    assert [r[0] for r in axis.select(blank_unchanged(F.lit("z"), F.col("a"), F.col("b"))).collect()] == [None, "z", "z"]


def test_pair_features(spark):
    rows = [(1, "DELETE", 10, 5, "u", [1.0, 0.0]), (1, "CREATE", 12, 6, "u", [1.0, 0.0]), (1, "CREATE", 99, 7, "x", [0.0, 1.0]),
            (2, "CREATE", 10, 5, "u", [1.0, 0.0]), (2, "DELETE", 10, 5, "v", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "pair_id long, action string, s long, revision_id long, username string, v array<double>").withColumn(
        "timestamp", F.timestamp_seconds("s"))
    got = {r["pair_id"]: r for r in pair_features(df, vector="v").collect()}
    assert (got[1]["time_diff"], got[1]["same_hour"], got[1]["same_user"], got[1]["delete_before_create"]) == (2.0, 0, 1, 1)
    assert got[1]["property_label_similarity"] == pytest.approx(1.0)
    assert (got[2]["same_hour"], got[2]["same_revision"], got[2]["same_user"], got[2]["delete_before_create"]) == (1, 1, 0, 0)
