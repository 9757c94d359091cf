"""Tables of classification requests for an external batch scorer, and parsing of its answers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import domain
from palimpsest.functions.labels import parse_labels
from palimpsest.operators.evaluation import label_metrics, long_labels

# What each class means; callers may pass their own table instead.
CLASS_NOTES = {
    "property_value_update": "the value is replaced by one with a different meaning",
    "refinement": "the value becomes more specific or precise and keeps its meaning",
    "unrefinement": "the value becomes less specific or precise and keeps its meaning",
    "re_formatting": "only the surface form of the value changes",
    "textual_change": "a language error is corrected or introduced",
    "link_change": "the reference moves to another entity with the same or a similar label",
}


def class_table(spark, classes=None, notes=None) -> DataFrame:
    """(datatype, position, label, description): the classes on offer per datatype."""
    classes, notes = classes or domain.CLASSES, notes or CLASS_NOTES
    rows = [(dt, i, label, notes[label]) for dt, labels in classes.items() for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "datatype string, position int, label string, description string")


def contexts(classes: DataFrame) -> DataFrame:
    """One instruction text per datatype, built from its class list (a few rows per datatype)."""
    listed = F.array_sort(F.collect_list(F.struct("position", "label", "description")))
    per = classes.groupBy("datatype").agg(listed.alias("c"))
    names = F.concat_ws(", ", F.transform("c", lambda x: x["label"]))
    notes = F.concat_ws("\n", F.transform("c", lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["description"])))
    return per.select("datatype", F.concat(
        F.lit("You edit an open knowledge base. A value of datatype "), F.col("datatype"),
        F.lit(" was changed. Assign the change to one or more of these classes: "), names, F.lit(".\n"), notes,
        F.lit("\nAnswer with the class names only, separated by a comma and a space.")).alias("context"))


def prompt_table(df: DataFrame, datatype: str, classes: DataFrame, key=domain.CHANGE_KEY) -> DataFrame:
    """(key, system, user): one request per change; labels of the values are shown for entities only."""
    def shown(value, label):
        if datatype != "entity":
            return F.coalesce(F.col(value), F.lit(""))
        return F.concat(F.coalesce(F.col(value), F.lit("")), F.lit(" ("), F.coalesce(F.col(label), F.lit("")), F.lit(")"))

    def text(column):
        return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in df.columns else F.lit("")

    user = F.concat(
        F.lit("Entity: "), text("entity_label"), F.lit(" ("), text("entity_id"), F.lit(")\nProperty: "),
        text("property_label"), F.lit(" ("), text("property_id"), F.lit(")\nOld value: "), shown("old_value", "old_value_label"),
        F.lit("\nNew value: "), shown("new_value", "new_value_label"))
    context = contexts(classes.where(F.col("datatype") == datatype)).select("context").scalar()
    return df.select(*key, context.alias("system"), user.alias("user"))


def evaluate_answers(df: DataFrame, truth: str = "label", answer: str = "predicted_class", by=()) -> DataFrame:
    """Per-label metrics of free-text answers; only labels that occur in the truth are scored."""
    return label_metrics(long_labels(df, parse_labels(F.col(truth)), parse_labels(F.col(answer)), by), by)
