"""Latest or earliest row per key as aggregates, which combine before the shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys, order, columns=None) -> DataFrame:
    """The row with the greatest ``order`` columns per key (ties: list a unique column last)."""
    keys = list(keys)
    kept = [c for c in (columns or df.columns) if c not in keys]
    row = F.max_by(F.struct(*kept), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, "_r.*")


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """Drop duplicates of a primary key, keeping the row that is last by ``order``."""
    return latest_per_key(df, keys, order).select(*df.columns)


def no_later_row(df: DataFrame, keys, ts: str) -> DataFrame:
    """Rows with no later row of the same key; rows tied at the last instant all stay."""
    keys = list(keys)
    tags = [f"_l{i}" for i in range(len(keys))]
    last = df.groupBy(*[F.col(k).alias(t) for k, t in zip(keys, tags)]).agg(F.max(ts).alias("_last"))
    cond = [F.col(k) == F.col(t) for k, t in zip(keys, tags)] + [F.col(ts) == F.col("_last")]
    return df.join(last, cond, "left_semi")
