"""Reading JSON values as text, so that the digits a user typed survive."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def scalar_text(value: Column) -> Column:
    """Unquoted text of a JSON scalar; NULL for an object."""
    bare = F.regexp_replace(value, '^\\s*"|"\\s*$', "")
    return F.when(F.ltrim(value).startswith("{"), F.lit(None).cast("string")).otherwise(bare)


def number_text(value: Column, member: str) -> Column:
    """Digits of a numeric member of a JSON object; a fraction loses its trailing zeros but one."""
    raw = F.regexp_extract(value, f'"{member}"\\s*:\\s*"?([-+]?[0-9][0-9.eE+-]*)', 1)
    trimmed = F.regexp_replace(raw, "(\\.[0-9]+?)0+$", "$1")
    return F.when(raw != "", trimmed)


def is_object(value: Column) -> Column:
    return value.contains("{")
