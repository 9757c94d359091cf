"""Training, scoring, storage, nearest neighbours, CSV sources, write-back, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.domain import GOLD_SCHEMA
from palimpsest.learn import classifiers, prepare
from palimpsest.learn import neighbours
from palimpsest.learn.neighbours import neighbour_shares, shares_by, weighted_points
from palimpsest.operators.ordered import Split
from palimpsest.operators.reversion import first_reversion
from palimpsest.operators.routing import features_for
from palimpsest.operators.value_features import TIME_COLUMNS, time_features
from palimpsest.sources import csvfiles
from palimpsest.sources.store import load_or_compute, write_back, write_metrics
from palimpsest.streaming.classify import change_stream, classify_stream
from palimpsest.streaming.reversions import first_reversion_stream, first_reversions, reversion_stream


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(300, 3)).round(1)
    values[100:200] = values[0]  # a third of the points are copies
    labels = rng.integers(0, 2, size=(300, 2))
    rows = [(i, [float(x) for x in v], float(a), float(b)) for i, (v, (a, b)) in enumerate(zip(values, labels))]
    return spark.createDataFrame(rows, "id int, features array<double>, a double, b double")


def brute_shares(points, k):
    rows = weighted_points(points, ["a", "b"]).orderBy("h").collect()
    known = [(np.array(r["features"]), r["ys"], r["w"]) for r in rows]
    out = {}
    for q in {tuple(r["features"]) for r in points.collect()}:
        order = sorted(range(len(known)), key=lambda i: (np.sqrt(((known[i][0] - q) ** 2).sum()), i))
        left, sums = k, np.zeros(2)
        for i in order:
            take = min(left, known[i][2])
            sums += take * np.array(known[i][1])
            left -= take
            if not left:
                break
        out[q] = tuple((sums / (k - left)).round(9))
    return out


def search(way, points, k):
    known = weighted_points(points, ["a", "b"])
    return shares_by(known, k)(points, "s") if way == "sent" else neighbour_shares(points, known, k, "s", per_cell=way)


# by cells: one cell, about ten, about a hundred with fewer points than k in most of them
@pytest.mark.parametrize("way,k", [("sent", 7), (5_000, 7), (20, 7), (2, 7), (2, 40), (20, 500)])
def test_neighbours_are_exact(points, monkeypatch, way, k):
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    want = brute_shares(points, min(k, 300))
    rows = search(way, points, k).collect()
    assert len(rows) == 300
    assert all(tuple(round(x, 9) for x in r["s"]) == want[tuple(r["features"])] for r in rows)


def test_many_training_points_are_searched_by_cells(points, monkeypatch):
    monkeypatch.setattr(neighbours, "SMALL_BYTES", 1000)
    sent = {tuple(r["features"]): r["s"] for r in neighbour_shares(points, weighted_points(points, ["a", "b"]), 7, "s").collect()}
    for r in search("sent", points, 7).collect():
        assert r["s"] == pytest.approx(sent[tuple(r["features"])])


def test_cells_are_ruled_out(spark, monkeypatch):
    """Clusters far apart: what is compared is a small part of all pairs."""
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.normal(size=(60, 4)) + 100 * c for c in range(20)])
    table = spark.createDataFrame([(v.tolist(), float(i % 2)) for i, v in enumerate(values)], "features array<double>, y double")
    seen, search_ = [], neighbours._searched

    def counted(visits, *rest):
        seen.append(visits.count())
        return search_(visits, *rest)

    monkeypatch.setattr(neighbours, "_searched", counted)
    assert neighbour_shares(table, weighted_points(table, ["y"]), 5, "s", per_cell=20).count() == 1200
    assert seen[0] == 1200 and seen[1] < 1200 * 12


@pytest.mark.parametrize("dims,k", [(3, 5), (3, 700), (20, 5)])
def test_neighbours_inside_a_task_are_those_of_all_pairs(dims, k):
    rng = np.random.default_rng(7)
    points, asked = rng.normal(size=(600, dims)).round(1), rng.normal(size=(90, dims)).round(1)
    points[3], points[5, 1], asked[2, 0] = np.nan, np.inf, np.nan
    bounds = np.where(np.arange(90) % 3 == 0, np.nan, 1.0)
    for limit in (None, bounds):
        q, p, d = neighbours._nearest(asked, points, k, limit)
        for i, row in enumerate(asked):
            far = np.sqrt(((points - row) ** 2).sum(axis=1))
            want = [j for j in np.argsort(far, kind="stable")[:k] if limit is None or np.isnan(limit[i]) or far[j] <= limit[i]]
            assert p[q == i].tolist() == want and np.array_equal(d[q == i], far[want], equal_nan=True)


def test_few_of_all_pairs_are_compared_inside_a_task(monkeypatch):
    rng, seen, nonzero = np.random.default_rng(8), [], np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: (seen.append(x.size), nonzero(x))[1])
    looked = []
    for n in (10_000, 40_000):
        values = rng.normal(size=(n, 1)) @ np.ones((1, 4)) + rng.normal(size=(n, 4)) / 10
        neighbours._nearest(values[:2_000], values, 5)
        looked.append(sum(seen))
        seen.clear()
    assert looked[0] < 2_000 * 10_000 / 8 and looked[1] < 2_000 * 40_000 / 12


def test_depths_beyond_the_limit_are_one_or_refused():
    combos = [{"trees": 5, "depth": d} for d in (None, 5, 30, 40, 100)]
    assert classifiers._trainable(combos) == [{"trees": 5, "depth": 30}, {"trees": 5, "depth": 5}]
    with pytest.raises(ValueError):
        classifiers._depth(31)


def test_one_prediction_per_key(spark):
    facts = spark.createDataFrame([(1, 1, "v", "", "old"), (1, 1, "w", "", "old"), (1, 1, "x", None, "old")],
                                  "revision_id long, property_id int, value_id string, change_target string, label string")
    said = spark.createDataFrame([(1, 1, "v", "", "b"), (1, 1, "v", "", "c"), (1, 1, "v", "", None), (1, 1, "x", "", None)],
                                 "revision_id long, property_id int, value_id string, change_target string, predicted_labels string")
    got = write_back(facts, said).orderBy("value_id").collect()
    assert [(r.value_id, r.label) for r in got] == [("v", "c"), ("w", "old"), ("x", None)]


def test_unfinished_folder_is_computed_again(spark, tmp_path):
    path = str(tmp_path / "cached")
    spark.range(3).write.parquet(path)
    (tmp_path / "cached" / "_SUCCESS").unlink()
    assert load_or_compute(spark, path, lambda: spark.range(5)).count() == 5
    assert load_or_compute(spark, path, lambda: spark.range(7)).count() == 5


def test_scaler_uses_the_population_deviation(spark):
    df = prepare.numeric(spark.createDataFrame([(1.0, 5), (None, 5), (float("nan"), 5)], "a double, b int"), ["a", "b"])
    scaler = prepare.fit_scaler(df, ["a", "b"])
    assert scaler.mean["a"] == pytest.approx(1 / 3) and scaler.scale["a"] == pytest.approx(np.std([1, 0, 0]))
    assert scaler.scale["b"] == 1.0


@pytest.mark.parametrize("split", [None, Split(floor=30)])
def test_folds_are_stratified(spark, split):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("label"))
    got = prepare.stratified_folds(df, ["id"], 5, split=split).groupBy("label", "fold").count().collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in sizes.values())


def test_label_columns(spark):
    df = spark.createDataFrame([("a, b",), (None,), ("b",)], "label string")
    assert prepare.label_classes(df) == ["", "a", "b"]
    got = prepare.binarise(df, ["", "a", "b"]).select("y_none", "y_a", "y_b").collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0, 1.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)]
    single = prepare.binarise_single(df.limit(2), "reverted_edit").collect()
    assert [r["label"] for r in single] == ["a, b", "non_reverted_edit"]


@pytest.mark.parametrize("algo,params", [("random_forest", {"trees": 3, "depth": 4}), ("xgboost", {"trees": 2, "depth": 3}), ("kn", {"k": 3})])
def test_train_store_and_classify(spark, log, tmp_path, algo, params):
    df = time_features(log.features_time)
    labelled = df.where("label <> ''")
    bundle, predictions = classifiers.train(labelled, "time", TIME_COLUMNS, algo, params, folds=2)
    assert predictions.count() == labelled.count()
    pooled = classifiers.fold_metrics(predictions, bundle.classes, pooled=True)
    assert pooled.count() == 3 and pooled.where("label = 'unrefinement' and f1 > 0.9").count() == 1
    classifiers.save(bundle, spark, str(tmp_path))
    again = classifiers.load(spark, str(tmp_path), "time", algo)
    once = classifiers.classify_pending(df, again)
    assert once.where("label = ''").count() == 0 and once.count() == df.count()
    assert once.join(labelled.select("value_id"), "value_id").select("value_id", "label").exceptAll(labelled.select("value_id", "label")).count() == 0
    if algo == "kn":  # a second pass changes nothing
        assert classifiers.classify_pending(once, again).select("value_id", "label").exceptAll(once.select("value_id", "label")).count() == 0


def test_grid_search_and_known_parameters(spark, log):
    df = time_features(log.features_time.where("label <> ''"))
    best = classifiers.grid_search(df, "time", TIME_COLUMNS, "kn", {"k": [3, 400]}, folds=2, known={})
    assert best == {"k": 3}
    assert classifiers.grid_search(df, "time", TIME_COLUMNS, "kn") == {"k": 15}


def test_unchanged_axis_gets_no_label(spark, log):
    df = log.features_globecoordinate.withColumn("datatype", F.lit("globecoordinate"))
    rows, columns = features_for(df, "globecoordinate_latitude")
    bundle, _ = classifiers.train(rows, "globecoordinate_latitude", columns, "kn", {"k": 3}, folds=2)
    everything, _ = features_for(df.drop("label_latitude"), "globecoordinate_latitude")
    scored = classifiers.score(everything, bundle)
    same = F.col("latitude_old").cast("double") == F.col("latitude_new").cast("double")
    assert scored.where(same & F.col("predicted_labels").isNotNull()).count() == 0
    assert scored.where(~same & F.col("predicted_labels").isNull()).count() == 0


def test_write_back_keeps_three_states(spark):
    facts = spark.createDataFrame([(1, 1, "a", None, ""), (2, 1, "a", "", ""), (3, 1, "a", "", "x"), (4, 1, "a", "", None)],
                                  "revision_id long, property_id int, value_id string, change_target string, label string")
    predictions = spark.createDataFrame([(1, 1, "a", "", "new"), (2, 1, "a", None, None)],
                                        "revision_id long, property_id int, value_id string, change_target string, predicted_labels string")
    got = {r["revision_id"]: r["label"] for r in write_back(facts, predictions).collect()}
    assert got == {1: "new", 2: None, 3: "x", 4: None}


def test_csv_sources(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text('revision_id;old_value;new_value\n1;"say ""hi"";\nthen";plain\n2;"";NULL\n')
    csvfiles.normalise_csv(spark, str(src), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"', multiLine=True, emptyValue="").orderBy("revision_id").collect()
    assert back[0]["old_value"] == 'say "hi";\nthen' and back[0]["new_value"] == "plain"
    dirty = tmp_path / "dirty.csv"
    dirty.write_text("k,seq,new_value,note\n1,1,NULL,NULL\n1,2,b,y\n1,2,b,y\n2,1,,NULL\n")
    got = csvfiles.load_clean(spark, str(dirty), ["k", "seq", "new_value", "note"], ["k"], ["seq"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("1", "2", "b", "y"), ("2", "1", "", None)]
    gold = tmp_path / "gold.csv"
    gold.write_text(",".join(GOLD_SCHEMA.names) + "\n" + ",".join(["7", "31", "v"] + [""] * 11 + ['"a, b"']) + "\n")
    assert csvfiles.labelled_csv(spark, str(gold)).first()["label"] == "a, b"


def test_cached_results_and_metric_files(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for reload in (False, False, True):
        assert load_or_compute(spark, str(tmp_path / "x"), compute, reload).count() == 3
    assert len(calls) == 2
    write_metrics(spark.createDataFrame([("kn", 0.5)], "model string, f1 double"), str(tmp_path / "m"), "csv")
    assert spark.read.csv(str(tmp_path / "m"), header=True).first()["model"] == "kn"


@pytest.mark.parametrize("salts", [1, 3])
def test_stream_finds_the_reversions_of_the_batch(spark, log, tmp_path, salts):
    source = str(tmp_path / "log")
    log.value_change.orderBy("timestamp").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(source)
    stream = reversion_stream(change_stream(spark, source, log.value_change.schema), salts=salts, lateness="40 days")
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    got = first_reversions(spark.read.parquet(out)).where("first_reversion is not null").select(
        "revision_id", F.unix_micros("first_reversion").alias("at"))
    batch = first_reversion(log.value_change).withColumn("us", F.unix_micros("timestamp"))
    want = batch.where(F.col("first_reversion_us") - F.col("us") <= 28 * 86_400_000_000).select("revision_id", F.col("first_reversion_us").alias("at"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("salts", [1, 3])
def test_stream_finds_the_first_reversion_in_one_row(spark, log, tmp_path, salts):
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    log.value_change.orderBy("timestamp").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(source)
    stream = first_reversion_stream(change_stream(spark, source, log.value_change.schema, 1), salts=salts, lateness="40 days")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    got = first_reversions(spark.read.parquet(out)).select("revision_id", F.unix_micros("first_reversion").alias("at"))
    batch = first_reversion(log.value_change).withColumn("us", F.unix_micros("timestamp"))
    want = batch.where(F.col("first_reversion_us") - F.col("us") <= 28 * 86_400_000_000).select("revision_id", F.col("first_reversion_us").alias("at"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_rows_do_not_grow_with_returns_of_a_state(spark, tmp_path):
    """A statement that swings 200 times: a row a change, not a row a pair; the order of arrival is corrected within the lateness."""
    rows = [(i, 1, 1, "v", "", "ab"[i % 2], "ba"[i % 2], 1_700_000_000 + 60 * i) for i in range(400)]
    rows[7], rows[390] = rows[390], rows[7]  # in another file, late
    schema = "revision_id long, entity_id long, property_id long, value_id string, change_target string, old_hash string, new_hash string, timestamp long"
    table = spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_seconds("timestamp"))
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    for i in range(4):
        spark.createDataFrame(table.collect()[100 * i:100 * (i + 1)], table.schema).coalesce(1).write.mode("append").parquet(source)
    stream = first_reversion_stream(change_stream(spark, source, table.schema, 1), lateness="10 hours")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() < 410
    assert {(r["revision_id"], r["at"]) for r in first_reversions(got).selectExpr("revision_id", "unix_seconds(first_reversion) as at").collect()} == {
        (i, 1_700_000_000 + 60 * (i + 1)) for i in range(399)}


def test_stream_labels_pending_changes(spark, log, tmp_path):
    df = log.features_time
    bundle, _ = classifiers.train(time_features(df.where("label <> ''")), "time", TIME_COLUMNS, "kn", {"k": 3}, folds=2)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3).write.parquet(source)
    classify_stream(change_stream(spark, source, df.schema, 1), bundle, time_features, out, str(tmp_path / "state")).awaitTermination()
    done = spark.read.parquet(out)
    pending = df.where("label = ''")
    assert done.count() == pending.count() and done.where("label = '' or label is null").count() == 0
    assert done.select("value_id").exceptAll(pending.select("value_id")).count() == 0


def test_commits(spark, tmp_path):
    from palimpsest.sources.committed import CommittedFacts, Conflict
    schema = "revision_id long, property_id int, value_id string, change_target string, label string"
    rows = [(i, i % 3, str(i % 2), None if i % 5 == 0 else "rank", "") for i in range(60)]
    table = CommittedFacts.create(spark.createDataFrame(rows, schema), str(tmp_path / "t"), buckets=6)
    predictions = lambda ids, text: spark.createDataFrame([(*rows[i][:3], rows[i][3] or "", text) for i in ids], schema).withColumnRenamed("label", "predicted_labels")

    def labels():
        return {r.revision_id: r.label for r in table.read().collect()}

    assert table.commit(predictions([3, 4, 5], "a"), "one") and labels() == {i: "a" if i in (3, 4, 5) else "" for i in range(60)}
    before = table.manifest()
    with pytest.raises(KeyError):  # data written, manifest not
        table.commit(predictions(range(60), "b"), "two", before_publish=lambda: {}["lost"])
    assert table.manifest() == before and set(labels().values()) == {"a", ""}
    # only touched buckets get a new version
    assert table.commit(predictions([7], None), "three") and not table.commit(predictions(range(60), "c"), "three")
    assert sum(a != b for a, b in zip(before["data"].values(), table.manifest()["data"].values())) == 1 and labels()[7] is None
    # of two commits on the same version one is valid, the other can be repeated
    with pytest.raises(Conflict):
        table.commit(predictions([1], "x"), "four", before_publish=lambda: CommittedFacts(spark, str(tmp_path / "t")).commit(predictions([2], "y"), "five"))
    assert labels()[1] == "" and labels()[2] == "y" and table.commit(predictions([1], "x"), "four") and (labels()[1], labels()[2]) == ("x", "y")
    assert len(labels()) == 60 and table.read().schema.simpleString() == spark.createDataFrame(rows, schema).schema.simpleString()
    assert table.commit(predictions([], "z"), "none") and len(labels()) == 60


def test_apportionment_is_even_for_every_label():
    import random
    rng = random.Random(8)
    for trial in range(200):
        names, k = "abcdef"[:rng.randint(1, 6)], rng.randint(2, 7)
        sets = {tuple(sorted(rng.sample(names, rng.randint(1, min(3, len(names)))))): rng.choice([1, 2, 3, 10, 101]) for _ in range(rng.randint(1, 9))}
        quota = prepare.apportion(sets, k)
        assert {s: sum(q) for s, q in quota.items()} == sets and all(max(q) - min(q) <= 1 for q in quota.values())
        off = [abs(sum(q[f] for s, q in quota.items() if x in s) - sum(n for s, n in sets.items() if x in s) / k) for x in names for f in range(k)]
        assert max(off) < 2


def test_multilabel_folds(spark):
    rows = [(i, label) for i, label in enumerate(["a"] * 7 + ["a, b"] * 2 + ["b, a"] * 3 + ["c"] * 1 + ["b, c"] * 1 + [""] * 6 + [None] * 2)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = prepare.multilabel_folds(df, ["id"], 3).collect()
    assert sorted((r.id, r.label or "") for r in got) == [(i, t or "") for i, t in rows] and {r.fold for r in got} == {0, 1, 2}
    for label in ("a", "b", "c", ""):
        n = [sum(label in [x.strip() for x in (r.label or "").split(",")] for r in got if r.fold == f) for f in range(3)]
        assert max(n) - min(n) <= 1, (label, n)
    assert {r.id: r.fold for r in got} == {r.id: r.fold for r in prepare.multilabel_folds(df.repartition(5), ["id"], 3).collect()}


def test_folds_by_spans_are_those_of_numbering_all_rows(spark, monkeypatch):
    texts = ["a", "b, a", "a, b", "c", " ", "b,c", None]
    rows = [(i if i % 50 else None, texts[i % 7]) for i in range(3000)] + [(i, "a") for i in range(0, 300, 7)] + [(None, "c")] * 40
    df = spark.createDataFrame(rows, "id long, label string")
    want = prepare.multilabel_folds(df, ["id"], 3)
    monkeypatch.setattr(prepare, "_NUMBERED", 10)
    monkeypatch.setattr(prepare, "_SPAN_BITS", 58)  # few spans, so that folds share some
    for split in (Split(), Split(20)):
        got = prepare.multilabel_folds(df, ["id"], 3, split=split)
        assert got.count() == len(rows) and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Window" not in plan.split("\n+- ")[0].split("\n:- ")[1]  # most rows are not moved


def test_features_of_a_class_are_computed_once(spark, log, monkeypatch):
    from palimpsest.registry import queries as q
    seen, class_changes = spark.sparkContext.accumulator(0), q.class_changes

    def counted(*args):
        features, columns, key = class_changes(*args)

        @F.udf("int")
        def told(x):
            seen.add(1)
            return x

        return features.withColumn(columns[0], told(columns[0])), columns, key

    monkeypatch.setattr(q, "class_changes", counted)
    assert q.classify_held_back(log, "quantity").count() > 0
    rows = class_changes(log, "quantity")[0].count()
    assert seen.value == rows


def test_forests_grown_on_distinct_rows(spark, monkeypatch):
    rows = [(i, float(i % 4), float(i % 3), "up" if i % 4 > 1 else "up, odd" if i % 3 else "down") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label string")
    want = classifiers.train(df, "d", ["x", "y"], "random_forest", {"trees": 3, "depth": 4}, 2, key=["id"])[1]
    fitted, fit_one = [], classifiers._fit_one
    monkeypatch.setattr(classifiers, "_MANY_ROWS", 1)
    monkeypatch.setattr(classifiers, "_LOTS", 7)
    monkeypatch.setattr(classifiers, "_fit_one", lambda rows, *rest: (fitted.append(rows), fit_one(rows, *rest))[1])
    for bootstrap in (True, False):
        params = {"trees": 3, "depth": 4, "bootstrap": bootstrap}
        got = classifiers.train(df, "d", ["x", "y"], "random_forest", params, 2, key=["id"])[1]
        assert got.select("id", "predicted_labels").exceptAll(want.select("id", "predicted_labels")).count() == 0
    for part in fitted:
        lots = classifiers._lots(part, True)
        assert part.count() <= 12 and lots.agg(F.sum("_number")).first()[0] == 300 == part.agg(F.sum("_number")).first()[0]
        assert lots.groupBy("features", "y_up", "y_odd").count().agg(F.max("count")).first()[0] == 7


def test_one_search_scores_every_k(spark, points):
    known = weighted_points(points, ["a", "b"])
    several = {tuple(r["features"]): r["s"] for r in neighbour_shares(points, known, [3, 7, 25], "s", per_cell=40).collect()}
    sent = {tuple(r["features"]): r["s"] for r in shares_by(known, [3, 7, 25])(points, "s").collect()}
    for j, k in enumerate((3, 7, 25)):
        for q, share in brute_shares(points, k).items():
            assert several[q][2 * j:2 * j + 2] == pytest.approx(share, abs=1e-8) == sent[q][2 * j:2 * j + 2]


def test_grid_of_k_picks_what_separate_runs_pick(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(160, 2))
    rows = [(i, *map(float, v), "up" if v[0] + rng.normal() * 0.8 > 0 else "down") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label string")
    ks = [1, 9, 21]
    best = classifiers.grid_search(df, "d", ["x", "y"], "kn", {"k": ks}, 3, key=["id"])
    scores = []
    for k in ks:
        bundle, predictions = classifiers.train(df, "d", ["x", "y"], "kn", {"k": k}, 3, key=["id"])
        scores.append(classifiers.exact_match(predictions, bundle.classes))
    assert best == {"k": ks[scores.index(max(scores))]}


def test_trained_models_are_compared_on_their_held_out_predictions(log):
    from palimpsest.registry import queries as q
    rows = q.trained_predictions(log).collect()
    split = lambda t: {x for x in (t or "").split(", ") if x}
    assert {r.model for r in rows} == {"kn", "random_forest", "xgboost"} and len({(r.model, r.doc_id) for r in rows}) == len(rows)
    got = {(r.model, r.datatype, r.label): (r.precision, r.recall, r.accuracy, r.f1) for r in q.trained_metrics(log).collect()}
    want = {}
    for m, d in {(r.model, r.datatype) for r in rows}:
        part = [(split(r.label), split(r.predicted_labels)) for r in rows if (r.model, r.datatype) == (m, d)]
        for x in set().union(*(t for t, _ in part)):
            tp, fp, fn = (sum((x in t, x in p) == c for t, p in part) for c in ((True, True), (False, True), (True, False)))
            want[m, d, x] = (tp / (tp + fp) if tp + fp else 0, tp / (tp + fn), (len(part) - fp - fn) / len(part), 2 * tp / (2 * tp + fp + fn))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_trained_models_share_one_table_of_features(log, monkeypatch):
    from palimpsest.registry import queries as q
    seen = []
    monkeypatch.setattr(q, "load_or_compute", lambda spark, path, compute: compute())
    monkeypatch.setattr(q.classifiers, "train", lambda df, *args, **options: (seen.append(df), df.withColumn("predicted_labels", F.col("label"))))
    assert q.trained_predictions(log).count() == 3 * q.labelled_documents(log).count()
    assert len(seen) == 3 and not any("documents.parquet" in f for df in seen for f in df.inputFiles())


def test_held_out_rows_are_only_searched_when_asked_for(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(classifiers, "shares_by", lambda points, k: searched.append(k) or shares_by(points, k))
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), "a" if i % 3 else "b") for i in range(60)], "id long, x double, y double, label string")
    bundle, predictions = classifiers.train(df, "d", ["x", "y"], "kn", {"k": 3}, 2, key=["id"], predict=False)
    assert predictions is None and not searched
    asked = df.withColumn("label", F.lit(""))
    alone = {r["id"]: r["predicted_labels"] for r in classifiers.score(asked, bundle).collect()}
    assert alone == {r["id"]: r["predicted_labels"] for r in classifiers.score(asked, classifiers.train(df, "d", ["x", "y"], "kn", {"k": 3}, 2, key=["id"])[0]).collect()}


def test_boxes_of_wide_vectors_are_not_compared_one_by_one(monkeypatch):
    """Where no leaf is ruled out for a group, its queries are not compared with the boxes; the result is that of brute force."""
    rng = np.random.default_rng(3)
    known, asked = rng.normal(size=(3_000, 32)), rng.normal(size=(700, 32))
    distance = np.sqrt(((asked[:, None] - known[None]) ** 2).sum(axis=2))
    bounds = np.sort(distance, axis=1)[:, 4]
    boxes, to_boxes = [], neighbours._to_boxes
    monkeypatch.setattr(neighbours, "_to_boxes", lambda least, *rest: boxes.append(len(least)) or to_boxes(least, *rest))
    for limits in (None, bounds):
        q, p, d = neighbours._nearest(asked, known, 5, limits)
        order = np.lexsort((p, d, q))
        assert (p[order].reshape(700, 5) == np.argsort(distance, axis=1, kind="stable")[:, :5]).all()
    assert max(boxes) == 1
