"""Deletions, reverted edits and time until reversion."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.calendar import age
from palimpsest.operators.ordered import DEFAULT_SPLIT, Split
from palimpsest.operators.reversion import reversion_pairs

_LASTING = "is_reverted = 0 and reversion = 0"


def soft_vs_hard_deletions(value_change: DataFrame, qualifier_change: DataFrame, full: bool = False) -> DataFrame:
    """Soft and hard deletions per entity; entities without a hard deletion only with ``full``.

    Both tables become (entity, soft, hard) counters, so one aggregate replaces two outer joins.
    """
    lasting = value_change.where(_LASTING).select(
        "entity_id", F.when(F.col("label") == "soft_deletion", 1).otherwise(0).alias("soft"),
        F.when(F.col("action") == "DELETE", 1).otherwise(0).alias("hard"))
    notes = qualifier_change.where(F.col("label") == "soft_deletion").select(
        "entity_id", F.lit(1).alias("soft"), F.lit(0).alias("hard"))
    both = lasting.where("soft + hard > 0").unionByName(notes).groupBy("entity_id").agg(
        F.sum("soft").alias("soft_deletions"), F.sum("hard").alias("hard_deletion_count"))
    return both if full else both.where("hard_deletion_count > 0")


def reverted_edits_by_month(value_change: DataFrame, revision: DataFrame) -> DataFrame:
    """Reverted edits per (month, user type); changes meet their revision in one shuffle."""
    rows = value_change.where("is_reverted = 1").select("revision_id", F.date_format("timestamp", "yyyy-MM").alias("year_month"))
    joined = rows.join(revision.select("revision_id", "user_type"), "revision_id")
    return joined.groupBy("year_month", "user_type").agg(F.count(F.lit(1)).alias("count_reverted_edit"))


def time_until_reversion(value_change: DataFrame) -> DataFrame:
    """Per property: mean calendar age of the reverted edits when they were reverted, by part.

    The mean interval itself is three columns, as its parts do not convert into each other.
    """
    aged = value_change.where("is_reverted = 1").select(
        "property_id", "property_label",
        age(F.col("reversion_timestamp").cast("timestamp"), F.col("timestamp").cast("timestamp")).alias("a"))
    return aged.groupBy("property_id", "property_label").agg(
        F.avg(F.col("a.years") * 12 + F.col("a.months")).alias("avg_age_months"),
        F.avg("a.days").alias("avg_age_days"),
        F.try_divide(F.sum(F.col("a.micros").cast("decimal(38,0)")).cast("double"), F.count("a")).alias("avg_age_micros"),
        F.avg("a.years").alias("avg_year_until_reversion"), F.avg("a.months").alias("avg_month_until_reversion"),
        F.avg("a.days").alias("avg_day_until_reversion"), F.count(F.lit(1)).alias("num_reverted_edits"))


def properties_by_days(until_reversion: DataFrame, at_least: int = 10) -> DataFrame:
    """How many properties (with enough reverted edits) have each whole mean number of days."""
    kept = until_reversion.where((F.col("num_reverted_edits") >= at_least) & F.col("avg_day_until_reversion").isNotNull())
    return kept.groupBy(F.col("avg_day_until_reversion").cast("int").alias("avg_day_until_reversion")).agg(
        F.count(F.lit(1)).alias("num_properties"))


def hash_matched_reversions(value_change: DataFrame, split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """Per property: all (reverted change, later reversion) pairs with inverse hashes, and their mean hours."""
    pairs = reversion_pairs(value_change.select(
        "entity_id", "property_id", "value_id", "property_label", "timestamp", "old_hash", "new_hash", "is_reverted", "reversion"
    ).where("is_reverted = 1 or reversion = 1"), split=split)
    sums = pairs.groupBy("property_id", "property_label").agg(
        F.sum("pairs").alias("reversion_count"), F.sum("wait_micros").alias("w"))
    return sums.select("property_id", "property_label", "reversion_count",
                       (F.col("w").cast("double") / F.col("reversion_count") / 3_600_000_000).alias("avg_hours_to_reversion"))
