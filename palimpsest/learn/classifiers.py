"""Multi-label classifiers: training over folds, scoring, classification of pending rows, storage."""

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.domain import AXES, CHANGE_KEY
from palimpsest.functions.labels import blank_unchanged, is_pending, pick_labels
from palimpsest.learn.neighbours import shares_by, weighted_points
from palimpsest.learn.prepare import FOLD, Scaler, binarise, fit_scaler, label_classes, multilabel_folds, numeric, truth_column
from palimpsest.operators.evaluation import label_metrics
from palimpsest.sources.store import store_once, write_back

# Best parameters found so far per algorithm and class (fixed values).
KNOWN_PARAMS = {
    "random_forest": {
        "globecoordinate_latitude": {"trees": 50, "depth": 5}, "globecoordinate_longitude": {"trees": 50, "depth": 5},
        "quantity": {"trees": 50, "depth": None}, "time": {"trees": 50, "depth": None},
        "text": {"trees": 150, "depth": 20, "bootstrap": False}, "entity": {"trees": 50, "depth": 10, "bootstrap": False},
    },
    "kn": {
        "globecoordinate_latitude": {"k": 3}, "globecoordinate_longitude": {"k": 3}, "quantity": {"k": 25}, "time": {"k": 15},
        "text": {"k": 3}, "entity": {"k": 5},
    },
    "xgboost": {
        "globecoordinate_latitude": {"trees": 100, "depth": 3}, "globecoordinate_longitude": {"trees": 150, "depth": 5},
        "quantity": {"trees": 50, "depth": 3}, "time": {"trees": 50, "depth": 3}, "text": {"trees": 50, "depth": 5},
        "entity": {"trees": 50, "depth": 3},
    },
}
# Values tried by the parameter search (fixed values).
GRIDS = {
    "random_forest": {"trees": [50, 100, 150, 200], "depth": [None, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100], "bootstrap": [True, False]},
    "kn": {"k": [3, 5, 7, 10, 15, 20, 25, 30]},
    "xgboost": {"trees": [50, 100, 150, 200], "depth": [3, 5, 7, 10]},
}
_DEEPEST = 30  # Spark's limit
# Forests are grown on distinct rows with their numbers from this many rows on, if that leaves one in so many; a bootstrap draws
# equal rows in at most so many lots.
_MANY_ROWS, _FEWER, _LOTS = 1_000_000, 8, 16_384
_NUMBER = "_number"
_READERS = {"random_forest": RandomForestClassificationModel, "xgboost": GBTClassificationModel}


@dataclass
class Bundle:
    """Everything scoring needs: one model per (fold, class), or training points per fold for ``kn``."""

    dt_class: str
    algo: str
    params: dict
    columns: list
    classes: list
    scaler: Scaler
    models: dict = field(default_factory=dict)
    points: dict = field(default_factory=dict)
    held: dict = field(default_factory=dict)  # the rows of each fold as prepared for training
    voters: dict = field(default_factory=dict)  # how each fold's points are searched, made once

    @property
    def folds(self) -> list[int]:
        return sorted(self.points or {fold for fold, _ in self.models})


def _depth(asked: int | None) -> int:
    """None is as deep as Spark can; more than that is refused."""
    if asked is not None and not 0 <= asked <= _DEEPEST:
        raise ValueError(f"a depth of {asked}: Spark builds trees of up to {_DEEPEST} levels")
    return _DEEPEST if asked is None else asked


def _trainable(combos: list[dict]) -> list[dict]:
    """Without combinations that Spark cannot tell apart: depths beyond its limit are its limit, once."""
    seen, out = [], []
    for c in combos:
        same = c | ({"depth": min(c["depth"] or _DEEPEST, _DEEPEST)} if "depth" in c else {})
        if same not in seen:
            seen.append(same)
            out.append(same)
    return out


def _fit_one(rows: DataFrame, algo: str, params: dict, label: str, positives: int, total: int, seed: int):
    """A model for one class, or its constant probability where only one outcome occurs."""
    if positives in (0, total):
        return float(positives > 0)
    truth = truth_column(label)
    depth = _depth(params.get("depth"))
    shared = {"featuresCol": "vector", "labelCol": truth, "seed": seed, "maxDepth": depth}
    if algo == "random_forest":
        weight = F.when(F.col(truth) == 1, total / (2 * positives)).otherwise(total / (2 * (total - positives)))
        if _NUMBER in rows.columns:
            rows, weight = _lots(rows, params.get("bootstrap", True)), weight * F.col(_NUMBER)
        return RandomForestClassifier(
            **shared, numTrees=params.get("trees", 50), bootstrap=params.get("bootstrap", True), weightCol="_weight"
        ).fit(rows.withColumn("_weight", weight))
    return GBTClassifier(**shared, maxIter=params.get("trees", 50)).fit(rows)


def _distinct(rows: DataFrame, truths) -> DataFrame:
    """Rows that are equal in fold, truths and features once, with their number; in a fixed order, which draws depend on."""
    counted = rows.groupBy(FOLD, *truths, "features").agg(F.count(F.lit(1)).alias(_NUMBER))
    return store_once(counted.sortWithinPartitions(FOLD, *truths, "features")).withColumn("vector", array_to_vector("features"))


def _lots(rows: DataFrame, bootstrap: bool) -> DataFrame:
    """Each distinct row as lots of equal rows, which a bootstrap draws one by one: a row a lot, up to ``_LOTS``."""
    if not bootstrap:
        return rows
    lots = F.least(F.lit(_LOTS).cast("long"), F.col(_NUMBER))
    cut = rows.select("*", lots.alias("_all"), F.explode(F.sequence(F.lit(1).cast("long"), lots)).alias("_lot"))
    size = F.expr(f"{_NUMBER} div _all") + (F.col("_lot") <= F.expr(f"{_NUMBER} % _all")).cast("long")
    return cut.withColumn(_NUMBER, size).drop("_all", "_lot")


def _prepared(df: DataFrame, scaler: Scaler, columns) -> DataFrame:
    scaled = scaler.apply(numeric(df, columns), columns)
    return scaled.withColumn("vector", array_to_vector("features"))


def _probability(df: DataFrame, model, out: str) -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    model = model.copy()
    model.setFeaturesCol("vector").setRawPredictionCol("_raw").setProbabilityCol("_prob").setPredictionCol("_pred")
    return model.transform(df).withColumn(out, vector_to_array("_prob")[1]).drop("_raw", "_prob", "_pred")


def _fold_probabilities(df: DataFrame, bundle: Bundle, fold: int) -> DataFrame:
    """Add p_{fold}_{i} for every class i."""
    names = [f"p_{fold}_{i}" for i in range(len(bundle.classes))]
    if bundle.algo == "kn":
        if fold not in bundle.voters:
            bundle.voters[fold] = shares_by(bundle.points[fold], bundle.params.get("k", 5))
        shares = bundle.voters[fold](df, "_shares")
        return shares.select("*", *[F.col("_shares")[i].alias(n) for i, n in enumerate(names)]).drop("_shares")
    for i, label in enumerate(bundle.classes):
        df = _probability(df, bundle.models[(fold, label)], names[i])
    return df


def train(df: DataFrame, dt_class: str, columns, algo: str = "random_forest", params: dict | None = None, folds: int = 5,
          key=CHANGE_KEY, label: str = "label", threshold: float = 0.5, seed: int = 42, parallelism: int = 4,
          classes=None, partitions: int | None = None, predict: bool = True) -> tuple[Bundle, DataFrame | None]:
    """Fit one model per fold and class; returns the bundle and the held-out predictions.

    The predictions hold key, fold, the label, the 0/1 truths and ``predicted_labels``; without ``predict`` they are None, which
    saves a neighbour search of all rows that nobody asked for. The
    scaler is fitted on all rows of all folds. Features and folds are computed once and stored in
    the shared folder, in ``partitions`` parts if that is given: each fit scans what it needs of them.
    """
    params = params or KNOWN_PARAMS.get(algo, {}).get(dt_class, {})
    columns, key = list(columns), list(key)
    classes = list(classes or label_classes(df, label))
    rows = multilabel_folds(binarise(numeric(df, columns), classes, label), key, folds, label, seed)
    truths = [truth_column(c) for c in classes]
    rows = rows.select(*dict.fromkeys([*key, label, FOLD, *truths, *columns]))
    rows = store_once(rows.repartition(partitions) if partitions else rows)
    scaler = fit_scaler(rows, columns)
    rows = _prepared(rows, scaler, columns).select(*key, label, FOLD, *truths, "features", "vector")
    bundle = Bundle(dt_class, algo, params, columns, classes, scaler)

    # one small row of counts per fold
    per_fold = rows.groupBy(FOLD).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("features", *truths)).alias("distinct"),
                                        *[F.sum(t).alias(t) for t in truths]).collect()
    totals = {t: sum(r[t] for r in per_fold) for t in truths}
    whole = sum(r["n"] for r in per_fold)

    if algo == "kn":
        bundle.points = {r[FOLD]: weighted_points(rows.where(F.col(FOLD) != r[FOLD]), truths) for r in per_fold}
    else:
        tasks, fitted = [(r, c) for r in per_fold for c in classes], rows
        if algo == "random_forest" and whole >= _MANY_ROWS and _FEWER * sum(r["distinct"] for r in per_fold) <= whole:
            fitted = _distinct(rows, truths)

        def fit(task):
            r, c = task
            positives = int(totals[truth_column(c)] - r[truth_column(c)])
            model = _fit_one(fitted.where(F.col(FOLD) != r[FOLD]), algo, params, c, positives, whole - r["n"], seed)
            return (r[FOLD], c), model

        with ThreadPoolExecutor(parallelism) as pool:
            bundle.models = dict(pool.map(fit, tasks))

    held, bundle.held = [], {fold: rows.where(F.col(FOLD) == fold) for fold in bundle.folds}
    if not predict:
        return bundle, None
    for fold in bundle.folds:
        scored = _fold_probabilities(bundle.held[fold], bundle, fold)
        picked = pick_labels([F.col(f"p_{fold}_{i}") for i in range(len(classes))], classes, threshold)
        held.append(scored.select(*key, FOLD, label, *truths, picked.alias("predicted_labels")))
    predictions = held[0]
    for more in held[1:]:
        predictions = predictions.unionByName(more)
    return bundle, predictions


def fold_metrics(predictions: DataFrame, classes, pooled: bool = False) -> DataFrame:
    """precision, recall, accuracy, f1 per class, by fold or pooled over the held-out rows of all folds."""
    chosen = F.split("predicted_labels", ", ")
    cells = F.array(*[F.struct(F.lit(c).alias("label"), F.col(truth_column(c)).alias("y"),
                               F.array_contains(chosen, c).cast("int").alias("p")) for c in classes])
    by = [] if pooled else [FOLD]
    flat = predictions.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    y, p = F.col("y") == 1, F.col("p") == 1
    counts = flat.groupBy(*by, "label").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                                            F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return label_metrics(counts, by)


def exact_match(predictions: DataFrame, classes) -> float:
    """Share of rows whose whole label set is right."""
    chosen = F.split("predicted_labels", ", ")
    right = F.lit(True)
    for c in classes:
        right = right & (F.array_contains(chosen, c) == (F.col(truth_column(c)) == 1))
    return predictions.agg(F.avg(right.cast("double"))).first()[0] or 0.0


def grid_search(df: DataFrame, dt_class: str, columns, algo: str, grid: dict | None = None, folds: int = 3, known=None, **options) -> dict:
    """Parameters with the best exact-match share over the inner folds; known ones are returned as they are."""
    found = (KNOWN_PARAMS if known is None else known).get(algo, {}).get(dt_class)
    if found:
        return found
    if algo == "kn":
        return _best_k(df, dt_class, columns, list((grid or GRIDS[algo])["k"]), folds, **options)
    combos = [{}]
    for name, values in (grid or GRIDS[algo]).items():
        combos = [c | {name: v} for c in combos for v in values]
    best, best_score = None, -1.0
    for params in _trainable(combos):
        bundle, predictions = train(df, dt_class, columns, algo, params, folds, **options)
        score = exact_match(predictions, bundle.classes)
        if score > best_score:
            best, best_score = params, score
    return best


def _best_k(df: DataFrame, dt_class: str, columns, ks: list[int], folds: int, threshold: float = 0.5, **options) -> dict:
    """One search per fold for the largest k: the neighbours of a smaller one are a prefix, so all are scored together."""
    bundle, _ = train(df, dt_class, columns, "kn", {"k": max(ks)}, folds, threshold=threshold, predict=False, **options)
    truths, count = [truth_column(c) for c in bundle.classes], len(bundle.classes)
    total = None
    for fold, rows in bundle.held.items():
        rows = shares_by(bundle.points[fold], ks)(rows, "_shares")
        right = []
        for j, k in enumerate(ks):
            picked = F.split(pick_labels([F.col("_shares")[j * count + i] for i in range(count)], bundle.classes, threshold), ", ")
            same = F.lit(True)
            for c, t in zip(bundle.classes, truths):
                same = same & (F.array_contains(picked, c) == (F.col(t) == 1))
            right.append(F.coalesce(F.sum(same.cast("long")), F.lit(0)).alias(f"k{k}"))
        got = rows.agg(*right).first()
        total = [a + b for a, b in zip(total, got)] if total else list(got)
    return {"k": ks[max(range(len(ks)), key=lambda j: (total[j], -j))]}


def store_best(spark: SparkSession, path: str, algo: str, dt_class: str, params: dict) -> None:
    """Keep the parameters of a search as JSON below ``path``."""
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{algo}/{dt_class}")


def read_best(spark: SparkSession, path: str, algo: str, dt_class: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{algo}/{dt_class}").first()["value"])


def score(df: DataFrame, bundle: Bundle, threshold: float = 0.5) -> DataFrame:
    """Add ``predicted_labels``: the mean probability of the fold models, then the threshold rule.

    A coordinate axis whose number did not change gets NULL.
    """
    scored = _prepared(df, bundle.scaler, bundle.columns)
    for fold in bundle.folds:
        scored = _fold_probabilities(scored, bundle, fold)
    labels = pick_labels([_mean(bundle, i) for i in range(len(bundle.classes))], bundle.classes, threshold)
    axis = bundle.dt_class.removeprefix("globecoordinate_")
    if axis in AXES:
        labels = blank_unchanged(labels, F.col(f"{axis}_old"), F.col(f"{axis}_new"))
    return scored.select(*df.columns, labels.alias("predicted_labels"))


def _mean(bundle: Bundle, i: int) -> Column:
    total = F.lit(0.0)
    for fold in bundle.folds:
        total = total + F.col(f"p_{fold}_{i}")
    return total / len(bundle.folds)


def classify_pending(facts: DataFrame, bundle: Bundle, label: str = "label", key=CHANGE_KEY, threshold: float = 0.5,
                     limit: int | None = None) -> DataFrame:
    """Facts with every pending row (label '') labelled, in one pass; ``limit`` takes only so many of them."""
    pending = facts.where(is_pending(F.col(label)))
    if limit is not None:
        pending = pending.limit(limit)
    predictions = score(pending, bundle, threshold).select(*key, "predicted_labels")
    return write_back(facts, predictions, label, key=key)


def save(bundle: Bundle, spark: SparkSession, path: str) -> None:
    """Store below {path}/{algo}/{dt_class}; other bundles at the path stay."""
    root = f"{path}/{bundle.algo}/{bundle.dt_class}"
    constants = {}
    for (fold, label), model in bundle.models.items():
        if isinstance(model, float):
            constants[f"{fold}/{label}"] = model
        else:
            model.write().overwrite().save(f"{root}/label={label}/fold={fold}")
    for fold, points in bundle.points.items():
        points.write.mode("overwrite").parquet(f"{root}/points/fold={fold}")
    manifest = {
        "dt_class": bundle.dt_class, "algo": bundle.algo, "params": bundle.params, "columns": bundle.columns, "classes": bundle.classes,
        "mean": bundle.scaler.mean, "scale": bundle.scaler.scale, "folds": bundle.folds, "constants": constants,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")


def load(spark: SparkSession, path: str, dt_class: str, algo: str) -> Bundle:
    root = f"{path}/{algo}/{dt_class}"
    m = json.loads(spark.read.text(f"{root}/manifest").first()["value"])
    bundle = Bundle(m["dt_class"], m["algo"], m["params"], m["columns"], m["classes"], Scaler(m["mean"], m["scale"]))
    for fold in m["folds"]:
        if algo == "kn":
            bundle.points[fold] = spark.read.parquet(f"{root}/points/fold={fold}")
            continue
        for label in bundle.classes:
            constant = m["constants"].get(f"{fold}/{label}")
            bundle.models[(fold, label)] = constant if constant is not None else _READERS[algo].load(f"{root}/label={label}/fold={fold}")
    return bundle
