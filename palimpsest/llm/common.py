"""Helpers shared by the operators of this package."""

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import shared_dir

#: UTF-8 bytes of text handled at once inside a task
BATCH_BYTES = 2 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new table in the folder that all executors share."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, spark: SparkSession | None = None, home: SparkSession | None = None) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read back: cuts lineage, survives lost executors.

    They may be read by another session ``spark``; ``home`` knows the shared folder, if the session of the rows does not.
    """
    path = scratch(home or df.sparkSession, name)
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose text column holds about ``limit`` bytes; one row is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column_bytes = batch.column(column).nbytes
        if column_bytes <= limit:
            yield batch
            continue
        step = max(1, batch.num_rows * limit // column_bytes)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_texts(df: DataFrame, id_column: str, text_column: str, fn: Callable[[list, list], dict], schema: T.StructType,
              limit: int = BATCH_BYTES) -> DataFrame:
    """``fn(ids, texts)`` over slices of bounded size; texts are UTF-8 bytes or None, the result a dict of columns."""
    names = schema.fieldNames()

    def run(batches):
        target = _arrow(schema)
        for part in by_bytes(batches, 1, limit):
            out = fn(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(out[n], target.field(n).type) for n in names], schema=target)

    return df.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text")).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of an undirected edge table (a, b) of longs; the root is the smallest node reachable.

    Alternates the large-star and small-star steps: every node hooks its neighbours onto its smallest neighbour until
    nothing moves. Minima combine before the shuffle, so a hub costs no task more than its share; the joins give a
    hub's rows once and are split by AQE where it holds most rows. Each round is a checkpoint. NULLs and loops are
    dropped; an empty table gives an empty result.
    """
    shared_dir(edges.sparkSession)
    def down(a, b):
        return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")

    now = edges.where("a is not null and b is not null and a <> b").select(*down("a", "b")).distinct().checkpoint()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(*down("v", "m")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(*down("u", "m")), F.struct(*down("v", "m")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = small.checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
