"""Schemas, key columns and fixed vocabularies of the change log."""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
STRING_TYPES = (
    "monolingualtext", "string", "external-id", "url", "commonsMedia",
    "geo-shape", "tabular-data", "math", "musical-notation", "unknown-values",
)
ENTITY_TYPES = (
    "wikibase-item", "wikibase-entityid", "wikibase-property",
    "wikibase-lexeme", "wikibase-sense", "wikibase-form", "entity-schema",
)
CLASSES = {
    "text": ("textual_change", "re_formatting", "refinement", "unrefinement", "property_value_update"),
    "quantity": ("refinement", "unrefinement", "property_value_update", "re_formatting"),
    "time": ("refinement", "unrefinement", "property_value_update"),
    "globecoordinate_latitude": ("refinement", "unrefinement", "property_value_update"),
    "globecoordinate_longitude": ("refinement", "unrefinement", "property_value_update"),
    "entity": ("refinement", "unrefinement", "property_value_update", "link_change"),
}
REVERT_WORDS = ("revert", "rv", "undid", "restore", "rvv", "vandal", "undo")
USER_TYPE_CODES = {"HUMAN": 0, "BOT": 1, "ANONYMOUS": 2}
DAY_CODES = {"Friday": 0, "Monday": 1, "Saturday": 2, "Sunday": 3, "Thursday": 4, "Tuesday": 5, "Wednesday": 6}
ACTION_CODES = {"CREATE": 0, "DELETE": 1, "UPDATE": 2}
RELATIONS = ("subclass", "located_in", "has_part", "part_of")
MODELS = ("kn", "random_forest", "xgboost")
# --- end of fixed values ----------------------------------------------------

AXES = ("latitude", "longitude")
CHANGE_KEY = ("revision_id", "property_id", "value_id", "change_target")
STATEMENT_KEY = ("entity_id", "property_id", "value_id")

GOLD_SCHEMA = T.StructType([
    T.StructField("revision_id", T.LongType()),
    T.StructField("property_id", T.IntegerType()),
    T.StructField("value_id", T.StringType()),
    T.StructField("change_target", T.StringType()),
    T.StructField("entity_id", T.LongType()),
    T.StructField("entity_label", T.StringType()),
    T.StructField("property_label", T.StringType()),
    T.StructField("datatype", T.StringType()),
    T.StructField("old_value", T.StringType()),
    T.StructField("new_value", T.StringType()),
    T.StructField("old_value_label", T.StringType()),
    T.StructField("new_value_label", T.StringType()),
    T.StructField("old_value_description", T.StringType()),
    T.StructField("new_value_description", T.StringType()),
    T.StructField("label", T.StringType()),
])
GLOBE_GOLD_SCHEMA = T.StructType(
    [f for f in GOLD_SCHEMA.fields if f.name != "label"]
    + [T.StructField(f"label_{axis}", T.StringType()) for axis in AXES]
)
VALUE_CHANGE_SCHEMA = T.StructType([
    T.StructField("revision_id", T.LongType()),
    T.StructField("entity_id", T.LongType()),
    T.StructField("property_id", T.IntegerType()),
    T.StructField("property_label", T.StringType()),
    T.StructField("value_id", T.StringType()),
    T.StructField("change_target", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("is_reverted", T.IntegerType()),
    T.StructField("reversion", T.IntegerType()),
    T.StructField("old_hash", T.StringType()),
    T.StructField("new_hash", T.StringType()),
    T.StructField("old_value", T.StringType()),
    T.StructField("new_value", T.StringType()),
    T.StructField("new_datatype", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("reversion_timestamp", T.TimestampType()),
    T.StructField("revision_id_reversion", T.LongType()),
])
METRIC_COLUMNS = ("precision", "recall", "accuracy", "f1")
