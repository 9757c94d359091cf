"""Multi-label columns: splitting, parsing, choosing labels from probabilities."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_labelled(label: Column) -> Column:
    """Processed and with something to report; '' is pending, NULL is nothing to report."""
    return label.isNotNull() & (label != "")


def is_pending(label: Column) -> Column:
    return label == ""


def explode_labels(df: DataFrame, label: str = "label", out: str = "individual_label") -> DataFrame:
    """One row per label of a ', '-separated list; duplicates stay."""
    return df.where(is_labelled(F.col(label))).withColumn(out, F.explode(F.split(F.col(label), ", ")))


def parse_labels(text: Column) -> Column:
    """Array of labels from free text: split on ',', trimmed; blank gives an empty array."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).otherwise(parts)


def known_only(labels: Column, classes) -> Column:
    return F.filter(labels, lambda x: x.isin(list(classes)))


def pick_labels(probabilities: list[Column], classes, threshold: float = 0.5) -> Column:
    """', '-joined classes at or above the threshold, else the single most likely (first on ties)."""
    top = F.greatest(*probabilities) if len(probabilities) > 1 else probabilities[0]
    best = F.coalesce(*[F.when(p == top, F.lit(c)) for p, c in zip(probabilities, classes)])
    chosen = F.concat_ws(", ", *[F.when(p >= threshold, F.lit(c)) for p, c in zip(probabilities, classes)])
    return F.when(chosen == "", best).otherwise(chosen)


def blank_unchanged(label: Column, old: Column, new: Column) -> Column:
    """NULL the label of a coordinate axis whose old and new numbers are equal."""
    return F.when(F.coalesce(old.try_cast("double") == new.try_cast("double"), F.lit(False)), F.lit(None)).otherwise(label)


def merged_source(source: Column) -> Column:
    """Both coordinate axes under one name."""
    return F.when(source.startswith("globecoordinate_"), "globecoordinate").otherwise(source)


def short_label(label: Column) -> Column:
    return F.replace(label, F.lit("property_value_update"), F.lit("value_update"))
