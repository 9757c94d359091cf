"""Features of a property replacement: a DELETE and a CREATE that belong together."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import flag
from palimpsest.functions.vectors import cosine

PAIR_COLUMNS = ["time_diff", "same_hour", "property_label_similarity", "same_revision", "same_user", "delete_before_create"]


def _first(action: str, columns, order) -> Column:
    wanted = F.col("action") == action
    return F.min_by(F.when(wanted, F.struct(*columns)), F.when(wanted, F.struct(*order)))


def pair_features(df: DataFrame, pair: str = "pair_id", order=("timestamp", "revision_id"),
                  vector: str | None = None, compat: bool = True, vectors: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """One row per pair, from its first CREATE and first DELETE row (one aggregate, no self-join).

    ``vector`` names the embedding column of the property label, or, with a table ``vectors``
    (key, vector), the column that holds its key there: vectors are then looked up per pair,
    after the aggregate, and never travel with the changes. ``complete`` leaves out pairs of
    which one side is missing. ``compat`` keeps same_hour as equality of the exact timestamps.
    """
    columns = ["timestamp", "revision_id", "username"] + ([vector] if vector else [])
    both = df.groupBy(pair).agg(_first("CREATE", columns, order).alias("c"), _first("DELETE", columns, order).alias("d"))
    if complete:
        both = both.where("c is not null and d is not null")
    if vectors is not None:
        for side in ("c", "d"):
            found = vectors.toDF(f"_key_{side}", f"_vector_{side}")
            both = both.join(found, F.col(f"{side}.{vector}") == F.col(f"_key_{side}"), "left")
    c, d = F.col("c.timestamp").cast("timestamp"), F.col("d.timestamp").cast("timestamp")
    same = (c == d) if compat else (F.date_trunc("hour", c) == F.date_trunc("hour", d))
    if vectors is not None:
        similarity = cosine(F.col("_vector_c"), F.col("_vector_d"))
    else:
        similarity = cosine(F.col(f"c.{vector}"), F.col(f"d.{vector}")) if vector else F.lit(None).cast("double")
    return both.select(
        pair, (F.abs(F.unix_micros(c) - F.unix_micros(d)) / 1_000_000).alias("time_diff"), flag(same).alias("same_hour"),
        similarity.alias("property_label_similarity"),
        flag(F.col("c.revision_id") == F.col("d.revision_id")).alias("same_revision"),
        flag(F.col("c.username") == F.col("d.username")).alias("same_user"),
        flag(d < c).alias("delete_before_create"))


def first_values(df: DataFrame, key: str, columns, order) -> DataFrame:
    """First non-null value per column and key, in the given order."""
    at = F.struct(*order)
    return df.groupBy(key).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])
