"""Equal-width histograms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histograms(df: DataFrame, columns, bins: int = 50) -> DataFrame:
    """(metric, bin, bin_start, bin_end, count) per column: equal-width bins over [min, max].

    The last bin is closed, empty bins are listed with 0. A column with a single value
    gets the range value-0.5 .. value+0.5. ``df`` is read twice: for the ranges, of which one
    row comes to the driver, and for the counts, which combine before they are shuffled.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = numbers.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    bounds = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns) if row[f"lo{i}"] is not None}
    bounds = {c: (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for c, (lo, hi) in bounds.items()}
    cells = []
    for c, (lo, hi) in bounds.items():
        at = F.least(F.floor((F.col(c) - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * bins), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("metric"), at.alias("bin")))
    every = F.array(*cells) if cells else F.array().cast("array<struct<metric:string,bin:int>>")
    counted = numbers.select(F.explode(every).alias("x")).select("x.metric", "x.bin").where("bin is not null").groupBy("metric", "bin").agg(
        F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.createDataFrame([(c, lo, hi) for c, (lo, hi) in bounds.items()], "metric string, lo double, hi double").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return edges.join(counted, ["metric", "bin"], "left").select(
        "metric", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    return histograms(df, [column], bins).drop("metric")
