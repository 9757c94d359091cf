"""Per-label quality of multi-label predictions and comparison of models."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palimpsest.domain import METRIC_COLUMNS, MODELS
from palimpsest.functions.labels import merged_source


def long_labels(df: DataFrame, truth: Column, predicted: Column, by=()) -> DataFrame:
    """Counts (by, label, truth, predicted) for every label that some truth carries.

    A row mentions only its own labels; the rows that mention a label neither way are
    known from the group size, so no row is multiplied by the number of classes.
    """
    by = list(by)
    base = df.select(*by, F.array_distinct(truth).alias("_t"), F.array_distinct(predicted).alias("_p"))
    seen = base.select(*by, "_t", "_p", F.explode(F.array_union("_t", "_p")).alias("label"))
    counted = seen.groupBy(*by, "label").agg(
        F.count_if(F.array_contains("_t", F.col("label")) & F.array_contains("_p", F.col("label"))).alias("tp"),
        F.count_if(~F.array_contains("_t", F.col("label"))).alias("fp"),
        F.count_if(~F.array_contains("_p", F.col("label"))).alias("fn"))
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where(F.col("tp") + F.col("fn") > 0)
    joined = kept.join(sizes, by) if by else kept.select("*", sizes.scalar().alias("n"))
    return joined.select(*by, "label", "tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def confusion(df: DataFrame, by, truth: str, predicted: str) -> DataFrame:
    """Confusion counts of a long frame with 0/1 truth and prediction columns."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                               F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def label_metrics(counts: DataFrame, by=(), label: str = "label") -> DataFrame:
    """precision, recall, accuracy, f1 per label; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    return counts.select(
        *by, label, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def pivot_metrics(metrics: DataFrame, metric: str = "f1", models=MODELS) -> DataFrame:
    """One row per (datatype, label), one column per model."""
    return metrics.groupBy("datatype", "label").pivot("model", list(models)).agg(F.first(metric))


def best_per_task(metrics: DataFrame, models=MODELS) -> DataFrame:
    """The model(s) with the greatest F1 per (datatype, label); ties share, in the order of ``models``."""
    top = F.rank().over(Window.partitionBy("datatype", "label").orderBy(F.desc("f1")))
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    winners = metrics.withColumn("_rank", top).where("_rank = 1").groupBy("datatype", "label").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "model"))).alias("w"), F.max("f1").alias("best_f1"))
    return winners.select("datatype", "label", F.concat_ws(", ", F.transform("w", lambda x: x["model"])).alias("best_model"), "best_f1")


def win_counts(metrics: DataFrame) -> DataFrame:
    """How many tasks each model wins, ties counting for each; models without a win have 0."""
    best = F.max("f1").over(Window.partitionBy("datatype", "label"))
    return metrics.withColumn("_best", best).groupBy("model").agg(F.count_if(F.col("f1") == F.col("_best")).alias("wins"))


def model_summary(metrics: DataFrame) -> DataFrame:
    """Mean of each metric per model over all tasks."""
    return metrics.groupBy("model").agg(*[F.avg(c).alias(f"mean_{c}") for c in METRIC_COLUMNS])


def best_model(metrics: DataFrame, models=MODELS) -> DataFrame:
    """The model with the greatest mean F1; on a tie the first in ``models``."""
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    best = F.max_by(F.struct("model", "mean_f1"), F.struct("mean_f1", (-place).alias("place"))).alias("b")
    return model_summary(metrics).agg(best).select("b.*")


def macro_means(metrics: DataFrame, by=("datatype",)) -> DataFrame:
    """Mean of each metric over the labels of a datatype; the two coordinate axes are then averaged."""
    by = list(by)
    per = metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in METRIC_COLUMNS])
    merged = per.withColumn("datatype", merged_source(F.col("datatype")))
    return merged.groupBy(*by).agg(*[F.avg(c).alias(c) for c in METRIC_COLUMNS])


def compare_systems(ours: DataFrame, theirs: DataFrame, metric: str = "accuracy") -> DataFrame:
    """The macro mean of one metric of two systems side by side per datatype."""
    a = macro_means(ours).select("datatype", F.col(metric).alias("left"))
    b = macro_means(theirs).select("datatype", F.col(metric).alias("right"))
    return a.join(b, "datatype").withColumn("difference", F.col("left") - F.col("right"))
