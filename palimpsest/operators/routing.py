"""Which feature family a datatype belongs to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.domain import AXES, ENTITY_TYPES, STRING_TYPES
from palimpsest.operators import graph, value_features
from palimpsest.operators.pairs import PAIR_COLUMNS, pair_features
from palimpsest.operators.reversion import REVERTED_COLUMNS, reverted_features
from palimpsest.operators.text_features import TEXT_COLUMNS, similarity_features, text_features


def datatype_group(datatype: Column) -> Column:
    """text, entity, or the datatype itself."""
    return (F.when(datatype.isin(list(STRING_TYPES)), "text")
            .when(datatype.isin(list(ENTITY_TYPES)), "entity").otherwise(datatype))


def of_class(df: DataFrame, dt_class: str) -> DataFrame:
    """Changes that a classifier of the class works on; both axes share the coordinate changes."""
    wanted = "globecoordinate" if dt_class.startswith("globecoordinate") else dt_class
    return df.where(datatype_group(F.col("datatype")) == wanted)


def features_for(df: DataFrame, dt_class: str, closed: DataFrame | None = None, vectors: dict | None = None,
                 **options) -> tuple[DataFrame, list[str]]:
    """The feature frame of a class and its ordered feature columns.

    ``closed`` is the closure table for entities; ``vectors`` maps similarity columns to
    pairs of embedding columns of ``df``.
    """
    if dt_class == "reverted_edit":
        return reverted_features(df, **options), REVERTED_COLUMNS
    if dt_class == "property_replacement":
        return pair_features(df, **options), PAIR_COLUMNS
    routed = of_class(df, dt_class)
    if dt_class == "text":
        out, columns = text_features(routed, **options), TEXT_COLUMNS
    elif dt_class == "time":
        out, columns = value_features.time_features(routed, **options), value_features.TIME_COLUMNS
    elif dt_class == "quantity":
        out, columns = value_features.quantity_features(routed, **options), value_features.QUANTITY_COLUMNS
    elif dt_class == "entity":
        out, columns = graph.entity_features(routed, closed, **options), graph.ENTITY_COLUMNS
    elif dt_class in [f"globecoordinate_{a}" for a in AXES]:
        axis_label = f"label_{dt_class.removeprefix('globecoordinate_')}"
        if axis_label in routed.columns:
            routed = routed.where(F.col(axis_label).isNotNull()).withColumn("label", F.col(axis_label))
        out, columns = value_features.geo_features(routed, **options), value_features.GEO_COLUMNS
    else:
        raise ValueError(f"unknown class {dt_class}")
    if vectors:
        out, columns = similarity_features(out, vectors), [*columns, *vectors]
    return out, list(columns)
