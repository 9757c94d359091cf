"""Writing results: cached frames, label write-back, metric files."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.domain import CHANGE_KEY
from palimpsest.session import shared_dir


def load_or_compute(spark: SparkSession, path: str, compute, reload: bool = False, partition_by=()) -> DataFrame:
    """Read a stored parquet result, or compute and store it when absent or ``reload`` is set.

    Only a folder whose write was finished counts: Spark marks it with ``_SUCCESS``.
    """
    if not reload and _finished(spark, path):
        return spark.read.parquet(path)
    compute().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def store_once(df: DataFrame) -> DataFrame:
    """The rows as a table of their own in the shared folder: computed once, columns read as they are needed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}/once/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def write_back(facts: DataFrame, predictions: DataFrame, label: str = "label", predicted: str = "predicted_labels",
               key=CHANGE_KEY) -> DataFrame:
    """Facts with the label replaced where a prediction with the same key exists.

    A prediction of NULL means "nothing to report" and replaces the label too, so a marker
    tells it from an absent prediction. A NULL in the last key column equals ''. Of several
    predictions for one key the greatest counts, and NULL only if there is no other.
    """
    def keyed(df):
        return [F.coalesce(F.col(k), F.lit("")) if k == key[-1] else F.col(k) for k in key]

    tags = [f"_k{i}" for i in range(len(key))]
    right = predictions.groupBy(*[c.alias(t) for c, t in zip(keyed(predictions), tags)]).agg(
        F.max(predicted).alias("_new"), F.lit(True).alias("_hit"))
    cond = [c == F.col(t) for c, t in zip(keyed(facts), tags)]
    chosen = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(label)).alias(label)
    return facts.join(right, cond, "left").select(*[chosen if c == label else F.col(c) for c in facts.columns])


def write_metrics(metrics: DataFrame, path: str, form: str = "json") -> None:
    """Metric frames are small; one file per write."""
    writer = metrics.coalesce(1).write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)
