"""Reachability, evaluation, prompts and histograms against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.calendar import age
from palimpsest.operators import evaluation as ev
from palimpsest.operators import graph, prompts
from palimpsest.operators.histogram import histogram
from palimpsest.operators.latest import keep_last, latest_per_key, no_later_row
from palimpsest.operators.reversion import sample_training_set


def random_edges(seed=2):
    rnd = random.Random(seed)
    return [(rel, f"Q{rnd.randint(0, 14)}", f"Q{rnd.randint(0, 14)}") for rel in ("subclass", "part_of") for _ in range(18)]


def brute_closure(edges):
    found = set(edges)
    while True:
        more = {(r, a, d) for (r, a, b), (r2, c, d) in itertools.product(found, edges) if r == r2 and b == c} - found
        if not more:
            return {(r, a, b) for r, a, b in found if a != b}
        found |= more


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(random_edges(), "relation string, src string, dst string")


def test_closure(edges):
    assert {tuple(r) for r in graph.closure(edges).collect()} == brute_closure(random_edges())


def test_closure_of_a_long_chain_and_depth(spark):
    chain = spark.createDataFrame([("subclass", f"Q{i}", f"Q{i + 1}") for i in range(9)], "relation string, src string, dst string")
    assert graph.closure(chain).count() == 45
    assert graph.closure(chain, max_depth=2).count() == 17


def test_closure_from_seeds(spark, edges):
    seeds = spark.createDataFrame([("Q1",), ("Q2",)], "src string")
    want = {x for x in brute_closure(random_edges()) if x[1] in ("Q1", "Q2")}
    assert {tuple(r) for r in graph.closure(edges, seeds=seeds).collect()} == want


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_reachable_pairs(spark, seed):
    rows = random_edges(seed) + [("subclass", None, "Q1"), ("part_of", "Q3", "Q3")]
    table = spark.createDataFrame(rows, "relation string, src string, dst string")
    asked = {(r, f"Q{a}", f"Q{b}") for r in ("subclass", "part_of", "none") for a in range(17) for b in range(15)}
    got = [tuple(r) for r in graph.reachable_pairs(spark.createDataFrame(sorted(asked) + sorted(asked)[:50], table.schema), table).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_closure([x for x in rows if None not in x]) & asked
    assert graph.reachable_pairs(table.limit(0), table).count() == 0


def test_pairs_of_a_graph_whose_closure_is_much_larger(spark, monkeypatch):
    """50 layers of 30 nodes: 2,900 edges, a closure of over 300,000 pairs, of which nothing is made but the way between the pairs."""
    rng, rows = random.Random(7), set()
    for layer in range(49):
        for i in range(30):
            rows |= {(f"Q{layer}-{i}", f"Q{layer + 1}-{i}"), (f"Q{layer}-{i}", f"Q{layer + 1}-{(i + 1) % 30}")}
    table = spark.createDataFrame([("subclass", *r) for r in rows], "relation string, src string, dst string")
    pairs = [(f"Q{a}-{rng.randrange(30)}", f"Q{b}-{rng.randrange(30)}") for a, b in ((rng.randrange(50), rng.randrange(50)) for _ in range(60))]
    df = spark.createDataFrame(pairs, "old_value string, new_value string")

    def path(x, y):  # one step goes down a layer, and 0 or 1 to the side
        (a, i), (b, j) = (tuple(map(int, t[1:].split("-"))) for t in (x, y))
        return int(b > a and (j - i) % 30 <= b - a)

    found = graph.reachable_pairs(graph.asked_pairs(df, ["subclass"]), table)
    for r in graph.reach_flags(df, found, {"subclass": "subclass"}).collect():
        assert r["old_value_subclass_new_value"] == path(r["old_value"], r["new_value"])
        assert r["new_value_subclass_old_value"] == path(r["new_value"], r["old_value"])


@pytest.mark.parametrize("steps", [[("subclass", "+"), ("part_of", "+")], [("subclass", "?"), ("part_of", "*")], [("part_of", "1"), ("subclass", "*"), ("part_of", "?")]])
def test_paths_by_expression(spark, edges, steps):
    rows = random_edges()

    def brute(node, rest):
        """Nodes that the rest of the steps lead to."""
        seen, todo = set(), [(node, 0)]
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            n, s = x
            if s < len(rest) and rest[s][1] in "?*":
                todo.append((n, s + 1))
            if s < len(rest):
                for r, a, b in rows:
                    if a == n and r == rest[s][0]:
                        todo.append((b, s + 1))
                        if rest[s][1] in "+*":
                            todo.append((b, s))
        return {n for n, s in seen if s == len(rest)}

    want = {(a, b) for a in {x for _, x, _ in rows} for b in brute(a, steps) if a != b}
    assert {tuple(r) for r in graph.paths(edges, steps).collect()} == want
    seeds = spark.createDataFrame([("Q1",), ("Q2",), ("Q99",)], "src string")
    assert {tuple(r) for r in graph.paths(edges, steps, seeds).collect()} == {x for x in want if x[0] in ("Q1", "Q2")}


def test_reach_flags(spark, edges):
    closed = brute_closure(random_edges())
    pairs = [(f'"Q{a}"', f"Q{b}") for a in range(6) for b in range(6)]
    df = spark.createDataFrame(pairs, "old_value string, new_value string")
    for r in graph.reach_flags(df, graph.closure(edges), {"subclass": "subclass", "has_part": "has_parts"}).collect():
        o, n = r["old_value"].strip('"'), r["new_value"]
        assert r["old_value_subclass_new_value"] == int(("subclass", o, n) in closed)
        assert r["new_value_subclass_old_value"] == int(("subclass", n, o) in closed)
        assert r["old_value_has_parts_new_value"] == 0


def test_types_and_paths(spark):
    edges = spark.createDataFrame([("instance_of", "Q1", "Q9"), ("instance_of", "Q1", "Q8"), ("a", "Q1", "Q2"), ("b", "Q2", "Q1"), ("b", "Q2", "Q3")],
                                  "relation string, src string, dst string")
    df = spark.createDataFrame([("Q1",), ("Q5",)], "e string")
    assert [r["types"] for r in graph.entity_types(df, edges, "e").orderBy("e").collect()] == [["Q8", "Q9"], []]
    got = graph.composite_path(edges.where("relation = 'a'"), edges.where("relation = 'b'")).collect()
    assert [tuple(r) for r in got] == [("Q1", "Q3")]


def test_answer_metrics(spark):
    rows = [("a, b", "a"), ("a", "a, c"), ("", "b"), ("b", None), (None, "a")]
    got = {r["label"]: r for r in prompts.evaluate_answers(spark.createDataFrame(rows, "label string, predicted_class string")).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["accuracy"]) == (2 / 3, 1.0, 4 / 5)
    assert (got["b"]["precision"], got["b"]["f1"], got["b"]["accuracy"]) == (0.0, 0.0, 2 / 5)


METRICS = [("kn", "time", "a", 0.5), ("random_forest", "time", "a", 0.5), ("xgboost", "time", "a", 0.4),
           ("kn", "text", "b", 0.1), ("random_forest", "text", "b", 0.2), ("xgboost", "text", "b", 0.3),
           ("kn", "globecoordinate_latitude", "a", 0.2), ("kn", "globecoordinate_longitude", "a", 0.4)]


def test_model_comparison(spark):
    df = spark.createDataFrame([(m, d, l, f, f, f, f) for m, d, l, f in METRICS],
                               "model string, datatype string, label string, precision double, recall double, accuracy double, f1 double")
    best = {(r["datatype"], r["label"]): (r["best_model"], r["best_f1"]) for r in ev.best_per_task(df).collect()}
    assert best[("time", "a")] == ("kn, random_forest", 0.5) and best[("text", "b")] == ("xgboost", 0.3)
    assert {r["model"]: r["wins"] for r in ev.win_counts(df).collect()} == {"kn": 3, "random_forest": 1, "xgboost": 1}
    even = df.where("datatype = 'time' and model <> 'xgboost'")
    assert ev.best_model(even).first()["model"] == "kn"
    means = {r["datatype"]: r["accuracy"] for r in ev.macro_means(df.where("model = 'kn'")).collect()}
    assert means["globecoordinate"] == pytest.approx(0.3)


def test_prompt_text(spark):
    df = spark.createDataFrame([(1, "Q5", "P1", '"x"', "y")], "revision_id long, entity_label string, property_label string, old_value string, new_value string")
    row = prompts.prompt_table(df, "text", prompts.class_table(spark), ("revision_id",)).first()
    assert "textual_change, re_formatting" in row["system"] and 'Old value: "x"\nNew value: y' in row["user"]


def test_histogram(spark):
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 40, 500).tolist()
    got = [r["count"] for r in histogram(spark.createDataFrame([(v,) for v in values], "v int"), "v").orderBy("bin").collect()]
    assert got == np.histogram(values, bins=50)[0].tolist()
    same = histogram(spark.createDataFrame([(7,), (7,)], "v int"), "v").where("count > 0").collect()
    assert len(same) == 1 and same[0]["bin_start"] <= 7 <= same[0]["bin_end"]
    assert histogram(spark.createDataFrame([], "v int"), "v").count() == 0


def test_latest_rows(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("l", 1, "d")], "k string, t int, v string")
    assert sorted(r["v"] for r in keep_last(df, ["k"], ["t", "v"]).collect()) == ["c", "d"]
    assert sorted(r["v"] for r in latest_per_key(df, ["k"], ["t", "v"], ["v"]).collect()) == ["c", "d"]
    assert sorted(r["v"] for r in no_later_row(df, ["k"], "t").collect()) == ["b", "c", "d"]


def test_age_borrows_from_the_earlier_month(spark):
    df = spark.sql("select timestamp'2024-03-01 00:00:00' a, timestamp'2024-01-31 12:00:00' b")
    got = df.select(age(F.col("a"), F.col("b")).alias("x"), age(F.col("b"), F.col("a")).alias("y")).first()
    assert tuple(got["x"]) == (0, 1, 0, 43_200_000_000) and tuple(got["y"]) == (0, -1, 0, -43_200_000_000)


def test_training_sample(spark):
    df = spark.createDataFrame([(i % 3, i, "reverted_edit" if i % 5 == 0 else None) for i in range(30)], "anchor_revision_id int, revision_id int, label string")
    got = sample_training_set(df).collect()
    assert sum(r["label"] == "reverted_edit" for r in got) == 6
    assert sorted(r["anchor_revision_id"] for r in got if r["label"] is None) == [0, 1, 2]
    assert sorted(map(tuple, got)) == sorted(map(tuple, sample_training_set(df.repartition(5)).collect()))
