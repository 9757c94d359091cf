"""Features of a change between two times, quantities or coordinates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.domain import AXES
from palimpsest.functions import numbers
from palimpsest.functions.jsontext import is_object, number_text
from palimpsest.functions.text import flag, unquoted
from palimpsest.functions.timeliteral import date_fields, date_parts, date_text, unknown_value

TIME_COLUMNS = ["date_diff_days", "sign_change", "day_added", "day_removed", "month_added", "month_removed",
                "different_year", "different_day", "different_month"]
QUANTITY_COLUMNS = ["sign_change", "precision_change", "length_increase", "length_decrease", "whole_number_change",
                    "old_is_prefix_of_new", "new_is_prefix_of_old", "same_float_value"]
GEO_COLUMNS = [f"{axis}_{c}" for axis in AXES for c in QUANTITY_COLUMNS]


def time_features(df: DataFrame, old: str = "old_value", new: str = "new_value", extras: bool = False) -> DataFrame:
    """Add time-change features. Values that are no date literal count as 1000 days apart."""
    names = df.columns
    base = df.select("*", unquoted(F.col(old)).alias("_old"), unquoted(F.col(new)).alias("_new"))
    # one projection per step: what several columns use is computed once
    base = base.select("*", date_text(F.col("_old")).alias("_do"), date_text(F.col("_new")).alias("_dn"))
    base = base.select("*", date_fields(F.col("_do")).alias("_fo"), date_fields(F.col("_dn")).alias("_fn"))
    base = base.select("*", date_parts(F.col("_do"), F.col("_fo")).alias("_a"), date_parts(F.col("_dn"), F.col("_fn")).alias("_b"))
    a, b = F.col("_old"), F.col("_new")
    y1, m1, d1 = (F.col(f"_a.{p}") for p in ("year", "month", "day"))
    y2, m2, d2 = (F.col(f"_b.{p}") for p in ("year", "month", "day"))
    dated = a.contains("T") & b.contains("T")
    unknown = unknown_value(a) | unknown_value(b)

    days = F.floor(F.abs(y2 - y1) * F.lit(365.25)) + F.floor(F.abs(m2 - m1) * F.lit(30.44)) + F.abs(d2 - d1)
    base = base.select(
        "*", unknown.alias("_unknown"), dated.alias("_dated"), (F.abs(y1) == F.abs(y2)).alias("_same_year"),
        ((m1 == 0) & (m2 > 0)).alias("_m_up"), ((m1 > 0) & (m2 == 0)).alias("_m_down"),
        ((d1 == 0) & (d2 > 0)).alias("_d_up"), ((d1 > 0) & (d2 == 0)).alias("_d_down"))
    unknown, dated, same_year, m_up, m_down, d_up, d_down = (
        F.col(c) for c in ("_unknown", "_dated", "_same_year", "_m_up", "_m_down", "_d_up", "_d_down"))
    gained = dated & same_year
    month_shift = same_year & (d1 == 0) & ((m_up & (d2 >= 0)) | (m_down & (d2 == 0)))
    day_shift = same_year & ((d_up & ((m1 == m2) | m_up)) | (d_down & (m1 == m2)))
    columns = [
        F.coalesce(F.when(dated, days), F.lit(1000)).cast("bigint").alias("date_diff_days"),
        flag(F.substring(a, 2, 1 << 30) == F.substring(b, 2, 1 << 30)).alias("sign_change"),
        flag(gained & d_up).alias("day_added"), flag(gained & d_down).alias("day_removed"),
        flag(gained & m_up).alias("month_added"), flag(gained & m_down).alias("month_removed"),
        flag(unknown | ~same_year).alias("different_year"),
        flag(unknown | ((d1 != d2) & ~day_shift)).alias("different_day"),
        flag(unknown | ((m1 != m2) & ~month_shift)).alias("different_month"),
    ]
    if extras:
        to_year = (m1 == 1) & (d1 == 1) & (m2 == 0) & (d2 == 0)
        to_month = (m1 == m2) & (m1 > 1) & (d1 == 1) & (d2 == 0)
        month_only = (m1 == 1) & (m2 == 0) & (d1 == 0) & (d2 == 0)
        columns.append(flag(~unknown & (y1 == y2) & (to_year | to_month | month_only)).alias("placeholder_to_zero"))
    return base.select(*names, *columns)


def _with_numbers(df: DataFrame, texts: dict) -> DataFrame:
    """Per number text, a struct of what the features look at, so that it is parsed once."""
    return df.select("*", *[numbers.anatomy(F.col(c)).alias(out) for out, c in texts.items()])


def _number_columns(a: Column, b: Column, decrease) -> dict[str, Column]:
    return {
        "sign_change": numbers.sign_change(a, b),
        "precision_change": numbers.precision_change(a, b),
        "length_increase": numbers.length_increase(a, b),
        "length_decrease": decrease(a, b),
        "whole_number_change": numbers.whole_number_change(a, b),
        "old_is_prefix_of_new": flag(b["text"].startswith(a["text"])),
        "new_is_prefix_of_old": flag(a["text"].startswith(b["text"])),
        "same_float_value": numbers.same_float(a, b),
    }


def quantity_features(df: DataFrame, old: str = "old_value", new: str = "new_value", compat: bool = True,
                      extras: bool = False) -> DataFrame:
    """Add quantity-change features.

    ``compat`` keeps the crossed length_decrease rule, which is always 0; ``compat=False``
    gives its evident intent.
    """
    names = df.columns
    plain = [F.replace(unquoted(F.col(c)), F.lit("+"), F.lit("")) for c in (old, new)]
    base = _with_numbers(df.select("*", plain[0].alias("_old"), plain[1].alias("_new")), {"_a": "_old", "_b": "_new"})
    a, b = F.col("_a"), F.col("_b")
    decrease = numbers.length_decrease_crossed if compat else numbers.length_decrease
    columns = _number_columns(a, b, decrease)
    if extras:
        columns |= {
            "precision_added": numbers.precision_added(a, b),
            "precision_removed": numbers.precision_removed(a, b),
            "same_decimal_length": numbers.same_decimal_length(a, b),
        }
    return base.select(*names, *[c.alias(n) for n, c in columns.items()])


def geo_features(df: DataFrame, old: str = "old_value", new: str = "new_value", axes=AXES) -> DataFrame:
    """Add the number features per coordinate axis; a value that is no JSON object gives 0."""
    names = df.columns
    texts = [number_text(F.col(c), axis).alias(f"_{side}_{axis}")
             for axis in axes for side, c in (("old", old), ("new", new))]
    base = df.select("*", (is_object(F.col(old)) & is_object(F.col(new))).alias("_objects"), *texts)
    base = _with_numbers(base, {f"_n{c}": c for axis in axes for c in (f"_old_{axis}", f"_new_{axis}")})
    columns = []
    for axis in axes:
        for name, value in _number_columns(F.col(f"_n_old_{axis}"), F.col(f"_n_new_{axis}"), numbers.length_decrease).items():
            columns.append(F.when(F.col("_objects"), value).otherwise(0).alias(f"{axis}_{name}"))
    return base.select(*names, *columns)
