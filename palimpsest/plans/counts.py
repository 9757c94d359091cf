"""Table sizes and per-entity statistics."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.histogram import histograms
from palimpsest.session import shared_dir

# metric name -> summed column, in report order (fixed values; one name occurs twice)
STAT_METRICS = (
    ("number value changes", "num_value_changes"),
    ("number of revisions", "num_revisions"),
    ("number value change creates", "num_value_change_creates"),
    ("number value change deletes", "num_value_change_deletes"),
    ("number value change updates", "num_value_change_updates"),
    ("number rank changes", "num_rank_changes"),
    ("number qualifier changes", "num_qualifier_changes"),
    ("number reference changes", "num_reference_changes"),
    ("number bot changes", "num_bot_edits"),
    ("number bot changes", "num_anonymous_edits"),
    ("number human changes", "num_human_edits"),
    ("number reverted edits", "num_reverted_edits"),
    ("number of reversions", "num_reversions"),
    ("number of reverted creates", "num_reverted_edits_create"),
    ("number of reverted deletes", "num_reverted_edits_delete"),
    ("number of reverted updates", "num_reverted_edits_update"),
)
HISTOGRAM_COLUMNS = ("num_revisions", "num_value_change_creates", "num_value_change_deletes", "num_value_change_updates")
STAT_COLUMNS = tuple(c for _, c in STAT_METRICS)


def table_counts(tables: dict) -> DataFrame:
    """(metric, count): number of rows per named table."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(metric).alias("metric"), "count") for metric, df in tables.items()])


def subset_counts(tables: dict, subset, subsets) -> DataFrame:
    """(subset, metric, count): rows of each named table by subset, one scan a table; a subset without rows counts 0."""
    def one(metric, df):
        cells = F.array(*[F.struct(F.lit(s).alias("subset"), F.col(f"_{i}").alias("count")) for i, s in enumerate(subsets)])
        sums = df.select(subset.alias("_subset")).agg(*[F.count_if(F.col("_subset") == s).alias(f"_{i}") for i, s in enumerate(subsets)])
        return sums.select(F.explode(cells).alias("c")).select("c.subset", F.lit(metric).alias("metric"), "c.count")

    return reduce(DataFrame.unionByName, [one(metric, df) for metric, df in tables.items()])


def feature_table_counts(features: dict) -> DataFrame:
    names = {"globecoordinate": "globe"}
    return table_counts({f"number of {names.get(n, n)} changes": df for n, df in features.items()})


def general_counts(stats: DataFrame, features: dict) -> DataFrame:
    """All entity sums from one scan of the statistics, followed by the feature-table sizes."""
    one = stats.agg(F.count(F.lit(1)).alias("_entities"), *[F.sum(c).alias(c) for c in STAT_COLUMNS])
    cells = [("number of entities", "_entities"), *STAT_METRICS]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("bigint").alias("count")) for m, c in cells])
    sums = one.select(F.explode(rows).alias("r")).select("r.*")
    names = {"globecoordinate": "globe-coordinate"}
    sizes = table_counts({f"number of features for datatype {names.get(n, n)}": df for n, df in features.items()})
    return sums.unionByName(sizes)


def entity_stats(value_change: DataFrame, revision: DataFrame, qualifier_change: DataFrame, reference_change: DataFrame | None = None) -> DataFrame:
    """Per-entity counters, rolled up from the logs.

    Each log is counted on its own and the counters are added up in one aggregate; user
    types count revisions.
    """
    def counters(df, **sums):
        return df.groupBy("entity_id").agg(*[s.alias(n) for n, s in sums.items()])

    action, undone = F.col("action"), F.col("is_reverted") == 1
    value = F.col("change_target") == ""
    parts = [
        counters(
            value_change,
            num_value_changes=F.count_if(value), num_rank_changes=F.count_if(F.col("change_target") == "rank"),
            num_value_change_creates=F.count_if(value & (action == "CREATE")),
            num_value_change_deletes=F.count_if(value & (action == "DELETE")),
            num_value_change_updates=F.count_if(value & (action == "UPDATE")),
            num_reverted_edits=F.count_if(undone), num_reversions=F.count_if(F.col("reversion") == 1),
            num_reverted_edits_create=F.count_if(undone & (action == "CREATE")),
            num_reverted_edits_delete=F.count_if(undone & (action == "DELETE")),
            num_reverted_edits_update=F.count_if(undone & (action == "UPDATE"))),
        counters(
            revision, num_revisions=F.count(F.lit(1)), num_bot_edits=F.count_if(F.col("user_type") == "bot"),
            num_anonymous_edits=F.count_if(F.col("user_type") == "anonymous"),
            num_human_edits=F.count_if(F.col("user_type") == "human")),
        counters(qualifier_change, num_qualifier_changes=F.count(F.lit(1))),
    ]
    if reference_change is not None:
        parts.append(counters(reference_change, num_reference_changes=F.count(F.lit(1))))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    known = [c for c in STAT_COLUMNS if c in stacked.columns]
    summed = stacked.groupBy("entity_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in known])
    return summed.select("entity_id", *[F.col(c) if c in known else F.lit(0).cast("bigint").alias(c) for c in STAT_COLUMNS])


def entity_histograms(stats: DataFrame, max_revisions: int | None = None, bins: int = 50) -> DataFrame:
    """(metric, bin, bin_start, bin_end, count) for the main counters, large entities optionally left out."""
    if max_revisions is not None:
        stats = stats.where(F.col("num_revisions") < max_revisions)
    # read twice below, but added up from the logs once
    shared_dir(stats.sparkSession)
    return histograms(stats.select(*HISTOGRAM_COLUMNS).checkpoint(), HISTOGRAM_COLUMNS, bins)
