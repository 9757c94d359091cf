"""Change-type distributions: overall, per user type, over the years, and their rollups."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.domain import AXES
from palimpsest.functions.labels import explode_labels, is_labelled, merged_source, short_label

FEATURE_SOURCES = ("entity", "text", "quantity", "time", "globecoordinate")


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _labels(features: dict, columns, labels_on_entity: bool = True) -> DataFrame:
    """(source, label, columns) of all labelled rows, one scan per table; both axes come out of a single scan."""
    frames = []
    for name, df in features.items():
        if name == "globecoordinate":
            axes = F.array(*[F.struct(F.lit(f"globecoordinate_{a}").alias("source"), F.col(f"label_{a}").alias("label")) for a in AXES])
            wide = df.select(*columns, F.explode(axes).alias("_x")).select(*columns, "_x.source", "_x.label")
        else:
            if name == "entity" and labels_on_entity:
                df = df.where((F.col("old_value_label") != "") & (F.col("new_value_label") != ""))
            wide = df.select(*columns, F.lit(name).alias("source"), "label")
        frames.append(wide.where(is_labelled(F.col("label"))))
    return _union(frames)


def labelled_changes(features: dict, columns=("is_reverted", "reversion"), labels_on_entity: bool = True) -> DataFrame:
    """(source, individual_label, columns): one row per label of each change.

    ``labels_on_entity`` keeps an entity change only if both values have a label.
    """
    return explode_labels(_labels(features, columns, labels_on_entity)).select("source", "individual_label", *columns)


def label_counts(features: dict) -> DataFrame:
    """Counts per (source, individual_label), the last not yet added up.

    Rows are counted under their whole label text before it is split: there are few such
    texts, so only counts are exploded.
    """
    counted = _labels(features, ("is_reverted", "reversion")).groupBy("source", "label").agg(*_reverted())
    return explode_labels(counted).drop("label")


def _reverted() -> list[Column]:
    return [
        F.count_if(F.col("is_reverted") == 1).alias("count_reverted"),
        F.count_if((F.col("is_reverted") == 0) & (F.col("reversion") == 0)).alias("count_non_reverted"),
    ]


def _with_rate(df: DataFrame) -> DataFrame:
    total = F.col("count_reverted") + F.col("count_non_reverted")
    return df.select("*", total.alias("total"), F.try_divide(F.col("count_reverted").cast("double"), total).alias("reversion_rate"))


def value_change_rules(value_change: DataFrame) -> DataFrame:
    """The five label rules on value changes in one scan; a rule without rows reports 0."""
    label, target = F.col("label"), F.col("change_target")
    rules = {
        "statement_insertion": label.isin("statement_insertion", "value_insertion") & (target == ""),
        "statement_deletion": label.isin("statement_deletion", "value_deletion") & (target == ""),
        "property_value_update": (label == "value_update") & (target == ""),
        "soft_insertion": (label == "soft_insertion") & (target == "rank"),
        "soft_deletion": (label == "soft_deletion") & (target == "rank"),
    }
    undone, kept = F.col("is_reverted") == 1, (F.col("is_reverted") == 0) & (F.col("reversion") == 0)
    sums = [F.count_if(c & side).alias(f"{n}_{i}") for n, c in rules.items() for i, side in enumerate((undone, kept))]
    return _stacked(value_change.agg(*sums), "value_change", {n: (F.col(f"{n}_0"), F.col(f"{n}_1")) for n in rules})


def _stacked(one_row: DataFrame, source: str, cells: dict) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("label"), a.alias("count_reverted"), b.alias("count_non_reverted"))
                     for n, (a, b) in cells.items()])
    return one_row.select(F.explode(rows).alias("r")).select(F.lit(source).alias("source"), "r.*")


def qualifier_rules(qualifier_change: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    counts = qualifier_change.agg(
        F.count_if(F.col("action") == "CREATE").alias("c"), F.count_if(F.col("action") == "DELETE").alias("d"),
        F.count_if(F.col("label") == "soft_deletion").alias("s"))
    return _stacked(counts, "qualifier", {
        "qualifier_insertion": (zero, F.col("c")), "qualifier_deletion": (zero, F.col("d")), "soft_deletion": (zero, F.col("s"))})


def reference_rules(reference_change: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    counts = reference_change.agg(
        F.count_if(F.col("action") == "CREATE").alias("c"), F.count_if(F.col("action") == "DELETE").alias("d"))
    return _stacked(counts, "reference", {"reference_insertion": (zero, F.col("c")), "reference_deletion": (zero, F.col("d"))})


def change_type_distribution(features: dict, value_change: DataFrame, qualifier_change: DataFrame,
                             reference_change: DataFrame) -> DataFrame:
    """Reverted and other changes per (source, label), with the reversion rate."""
    by_label = label_counts(features).groupBy("source", F.col("individual_label").alias("label")).agg(*_sums()[:2])
    parts = [by_label, value_change_rules(value_change), qualifier_rules(qualifier_change), reference_rules(reference_change)]
    return _with_rate(_union(parts))


def distribution_per_user_type(features: dict, revision: DataFrame) -> DataFrame:
    """The same per (datatype, user type, label) for the feature tables.

    Changes meet their revision in one shuffle (AQE splits a revision with very many); what follows are counts.
    """
    known = _labels(features, ("revision_id", "is_reverted", "reversion")).join(revision.select("revision_id", "user_type"), "revision_id")
    counted = explode_labels(known.groupBy("source", "user_type", "label").agg(*_reverted())).drop("label")
    return _with_rate(counted.groupBy(
        F.col("source").alias("datatype"), "user_type", F.col("individual_label").alias("label")).agg(*_sums()[:2]))


def change_types_overtime(features: dict, revision: DataFrame) -> DataFrame:
    """Changes per (datatype, label, year), reverted ones included, entity labels not required."""
    known = _labels(features, ("revision_id",), labels_on_entity=False).join(revision.select("revision_id", "year"), "revision_id")
    counted = explode_labels(known.groupBy("source", "year", "label").agg(F.count(F.lit(1)).alias("n"))).drop("label")
    return counted.groupBy(F.col("source").alias("datatype"), "individual_label", "year").agg(F.sum("n").alias("count"))


def dense_years(overtime: DataFrame, first: int = 2012, last: int = 2025, per_datatype: bool = True) -> DataFrame:
    """A full year x label (x datatype) grid with 0 for what did not occur, by year; the axes are one datatype here.

    The grid comes from the distinct labels of an already aggregated table: a few hundred rows.
    """
    merged = overtime.withColumn("datatype", merged_source(F.col("datatype")))
    keys = ["datatype", "individual_label"] if per_datatype else ["individual_label"]
    sums = merged.groupBy(*keys, "year").agg(F.sum("count").alias("count"))
    if per_datatype:
        grid = _pairs(merged, "datatype", "individual_label")
    else:
        grid = merged.select("individual_label").distinct()
    grid = grid.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return grid.join(sums, [*keys, "year"], "left").fillna(0, ["count"]).orderBy("year", *keys)


def _pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Every value of one small vocabulary with every value of another."""
    both = df.agg(F.collect_set(left).alias("l"), F.collect_set(right).alias("r"))
    return both.select(F.explode("l").alias(left), "r").select(left, F.explode("r").alias(right))


def rollup_by_label(distribution: DataFrame) -> DataFrame:
    """Totals per label over all sources, smallest first."""
    sums = distribution.groupBy("label").agg(*_sums())
    return sums.withColumn("reversion_rate", F.try_divide(F.col("count_reverted").cast("double"), F.col("total"))).orderBy("total", "label")


def _sums():
    return [F.sum(c).alias(c) for c in ("count_reverted", "count_non_reverted", "total")]


def rollup_by_source(distribution: DataFrame) -> DataFrame:
    """Totals per feature source with both axes merged, and the reverted percentage."""
    merged = distribution.withColumn("source", merged_source(F.col("source"))).where(F.col("source").isin(list(FEATURE_SOURCES)))
    sums = merged.groupBy("source", "label").agg(*_sums())
    return sums.select("source", short_label(F.col("label")).alias("label"), "count_reverted", "count_non_reverted", "total",
                       (F.try_divide(F.col("count_reverted").cast("double"), F.col("total")) * 100).alias("reverted_percentage"))


def share_by_user_type(per_user: DataFrame) -> DataFrame:
    """Percentage of each user type within (datatype, label)."""
    merged = per_user.withColumn("datatype", merged_source(F.col("datatype")))
    sums = merged.groupBy("datatype", "label", "user_type").agg(F.sum("total").alias("total"))
    whole = F.sum("total").over(Window.partitionBy("datatype", "label"))
    return sums.select("datatype", short_label(F.col("label")).alias("label"),
                       F.replace("user_type", F.lit("human"), F.lit("registered")).alias("user_type"), "total",
                       (F.try_divide(F.col("total").cast("double"), whole) * 100).alias("pct"))


def label_frequencies(df: DataFrame, label: str = "label") -> DataFrame:
    whole = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return explode_labels(whole, label).groupBy("individual_label").agg(F.sum("n").alias("count"))


def pending_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """How many rows are pending, processed with nothing to report, and labelled."""
    c = F.col(label)
    return df.agg(F.count_if(c == "").alias("pending"), F.count_if(c.isNull()).alias("nothing"),
                  F.count_if(is_labelled(c)).alias("labelled"))
