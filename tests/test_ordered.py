"""Cut keys give the plain-window result, checked against brute force with tiny limits."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.ordered import CHUNK, Fold, Split, adjacent, position, running, with_chunk
from palimpsest.operators.reversion import (
    first_reversion, keyword_in_next, reversion_pairs, reverted_features, time_to_neighbour, trailing_count,
)

TINY = Split(floor=15)
SPLITS = [pytest.param(None, id="plain"), pytest.param(TINY, id="cut")]
KEY = ("entity_id", "property_id", "value_id")


def log_rows(n=240, seed=1):
    """One statement holds a third of all rows and half of those fall into one burst; instants repeat."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.4
        entity, prop, value = (1, 1, "a") if hot else (rnd.randint(1, 4), rnd.randint(1, 2), rnd.choice("ab"))
        us = 10**15 + (rnd.randint(0, 40) if hot and rnd.random() < 0.5 else rnd.randint(0, 150) * 3_600_000_000)
        old, new = rnd.sample(["", "h1", "h2", "h3"], 2)
        rows.append((i, entity, prop, value, us, rnd.choice(["u1", "u2", "Bot1", "", None]),
                     rnd.choice(["Undo it", "fine", None, "rv"]) if rnd.random() < 0.2 else "fine", old, new,
                     rnd.randint(0, 1), rnd.randint(0, 1), rnd.choice(["CREATE", "UPDATE", "DELETE"])))
    return rows


COLUMNS = ["revision_id", *KEY, "us", "username", "comment", "old_hash", "new_hash", "is_reverted", "reversion", "action"]


@pytest.fixture(scope="module")
def rows():
    return [dict(zip(COLUMNS, r)) for r in log_rows()]


@pytest.fixture(scope="module")
def df(spark, rows):
    frame = spark.createDataFrame(
        [tuple(r[c] for c in COLUMNS) for r in rows],
        "revision_id long, entity_id long, property_id int, value_id string, us long, username string, comment string, "
        "old_hash string, new_hash string, is_reverted int, reversion int, action string")
    return frame.withColumn("timestamp", F.timestamp_micros("us")).repartition(2).cache()


def later(rows, r, keys=KEY):
    found = [x for x in rows if all(x[k] == r[k] for k in keys) and x["us"] > r["us"]]
    return sorted(found, key=lambda x: (x["us"], x["revision_id"]))


def earlier(rows, r, keys=KEY):
    return [x for x in rows if all(x[k] == r[k] for k in keys) and x["us"] < r["us"]]


def inverts(r, x):
    return (r["old_hash"] == x["new_hash"] != "") or (r["old_hash"] == "" == x["new_hash"] and r["new_hash"] == x["old_hash"])


def by_id(frame, *columns):
    return {r["revision_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_hot_keys_and_bursts_are_cut(df):
    cut, split = with_chunk(df, KEY, "us", TINY)
    assert split is TINY
    sizes = cut.groupBy(*KEY, CHUNK).count()
    hot = sizes.where("entity_id = 1 and property_id = 1 and value_id = 'a'")
    assert hot.count() > 10
    assert hot.agg(F.max("count")).first()[0] <= TINY.floor
    bounds = cut.groupBy(*KEY, CHUNK).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    spans = sorted((r[CHUNK], r["lo"], r["hi"]) for r in bounds.collect() if (r["entity_id"], r["property_id"], r["value_id"]) == (1, 1, "a"))
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_no_hot_key_means_plain_windows(df):
    same, split = with_chunk(df, KEY, "us", Split(floor=10_000))
    assert split is None and CHUNK not in same.columns


@pytest.mark.parametrize("split", SPLITS)
def test_running(df, rows, split):
    cut, split = with_chunk(df, KEY, "us", split)
    got = running(cut, "us", [
        Fold("s", "sum", "is_reverted", KEY), Fold("n", "min", "us", KEY, True), Fold("m", "max", "us", KEY[:3])], split)
    want = {r["revision_id"]: (
        sum(x["is_reverted"] for x in earlier(rows, r)), min((x["us"] for x in later(rows, r)), default=None),
        max((x["us"] for x in earlier(rows, r)), default=None)) for r in rows}
    assert by_id(got, "s", "n", "m") == want


@pytest.mark.parametrize("split", SPLITS)
def test_position_and_adjacent(df, rows, split):
    cut, split = with_chunk(df, KEY, "us", split)
    got = by_id(position(cut, KEY, "us", ["revision_id"], "p", split), "p")
    near = by_id(adjacent(cut, KEY, "us", ["revision_id"], {"a": (-1, "revision_id"), "b": (1, "old_hash"), "c": (1, "username")}, split), "a", "b", "c")
    groups = {}
    for r in sorted(rows, key=lambda r: (r["us"], r["revision_id"])):
        groups.setdefault(tuple(r[k] for k in KEY), []).append(r)
    for g in groups.values():
        for i, r in enumerate(g):
            nxt = g[i + 1] if i + 1 < len(g) else {"old_hash": None, "username": None}
            assert got[r["revision_id"]] == (i + 1,)
            assert near[r["revision_id"]] == (g[i - 1]["revision_id"] if i else None, nxt["old_hash"], nxt["username"])


@pytest.mark.parametrize("split", SPLITS)
def test_first_reversion(df, rows, split):
    want = {r["revision_id"]: (min((x["us"] for x in later(rows, r) if inverts(r, x)), default=None),) for r in rows}
    assert by_id(first_reversion(df, split=split), "first_reversion_us") == want


@pytest.mark.parametrize("split", SPLITS)
def test_reversion_pairs(df, rows, split):
    want = {}
    for r in rows:
        hits = [x["us"] - r["us"] for x in later(rows, r) if x["reversion"] == 1 and inverts(r, x)]
        if r["is_reverted"] == 1 and hits:
            want[r["revision_id"]] = (len(hits), sum(hits))
    got = by_id(reversion_pairs(df, split=split), "pairs", "wait_micros")
    assert {k: (a, int(b)) for k, (a, b) in got.items()} == want


@pytest.mark.parametrize("split", SPLITS)
def test_keyword_in_next(df, rows, split):
    words = ("revert", "rv", "undid", "restore", "rvv", "vandal", "undo")
    want = {r["revision_id"]: (int(any(w in (x["comment"] or "").lower() for x in later(rows, r)[:10] for w in words)),) for r in rows}
    assert by_id(keyword_in_next(df, split=split), "rv_keyword_in_comment_next_10") == want


@pytest.mark.parametrize("split", SPLITS)
def test_time_to_neighbour(df, rows, split):
    def nearest(r, find, pick, sign):
        found = find(rows, r) or find(rows, r, KEY[:2])
        return sign * (pick(x["us"] for x in found) - r["us"]) / 1e6 if found else -1.0

    want = {r["revision_id"]: (nearest(r, earlier, max, -1), nearest(r, later, min, 1)) for r in rows}
    assert by_id(time_to_neighbour(df, split=split), "time_to_prev_change_seconds", "time_to_next_change_seconds") == want


@pytest.mark.parametrize("split", SPLITS)
def test_trailing_count(df, rows, split):
    want = {r["revision_id"]: (sum(
        x["username"] == r["username"] is not None and x["us"] >= r["us"] - 86_400_000_000 for x in earlier(rows, r)),) for r in rows}
    assert by_id(trailing_count(df, split=split), "num_changes_same_user_last_24h") == want


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("compat", [True, False])
def test_reverted_features(df, rows, split, compat):
    got = by_id(reverted_features(df, compat=compat, split=split), "is_reverted_within_day", "hash_reversion_next_10")
    for r in rows:
        after = later(rows, r)
        hits = [x for x in after if inverts(r, x)]
        near = any(inverts(r, x) for x in after[:10])
        want = (int(any(x["us"] - r["us"] <= 86_400_000_000 for x in hits)), int(bool(hits) if compat else near))
        assert got[r["revision_id"]] == want


def test_reverted_exactly_a_day_later(spark):
    day = 86_400_000_000
    rows = [(1, 0, "", "h"), (2, day, "h", ""), (3, 5, "", "h2"), (4, 6 + day, "h2", "")]
    df = spark.createDataFrame([(i, 1, 1, str(i > 2), u, "x", "", o, n, "UPDATE") for i, u, o, n in rows],
                               "revision_id long, entity_id long, property_id int, value_id string, us long, username string, "
                               "comment string, old_hash string, new_hash string, action string").withColumn(
                                   "timestamp", F.timestamp_micros("us"))
    got = by_id(reverted_features(df), "is_reverted_within_day", "user_type_encoded")
    assert [got[i][0] for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
