"""Labelling of changes as they land in a folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.labels import is_pending
from palimpsest.learn.classifiers import Bundle, score


def change_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def classify_stream(changes: DataFrame, bundle: Bundle, prepare, out: str, checkpoint: str, label: str = "label",
                    available_now: bool = True):
    """Start a query that labels pending changes and writes each micro-batch to ``{out}/batch=<id>``.

    ``prepare`` turns a batch of changes into its feature frame. Rewriting a batch's own
    folder makes a repeated batch harmless.
    """
    def label_batch(batch: DataFrame, batch_id: int) -> None:
        pending = prepare(batch.where(is_pending(F.col(label))))
        labelled = score(pending, bundle).select(*[
            F.col("predicted_labels").alias(label) if c == label else F.col(c) for c in batch.columns])
        labelled.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = changes.writeStream.foreachBatch(label_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
