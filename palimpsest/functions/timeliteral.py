"""Time literals such as +1910-02-00T00:00:00Z, where month and day may be 00."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_text(value: Column) -> Column:
    """The date of a literal: only digits and separators, up to the T, without the Z."""
    kept = F.replace(F.regexp_replace(value, "[^0-9TZ:\\-]", ""), F.lit("Z"), F.lit(""))
    return F.split_part(kept, F.lit("T"), F.lit(1))


def date_fields(date: Column) -> Column:
    """The texts of year, month and day of a ``date_text``; a leading minus belongs to the year."""
    return F.split(F.when(date.startswith("-"), F.substring(date, 2, 1 << 30)).otherwise(date), "-")


def date_parts(date: Column, fields: Column) -> Column:
    """struct(year, month, day), year signed; NULL unless all three are numbers."""
    year, month, day = (F.get(fields, i).try_cast("bigint") for i in range(3))
    sign = F.when(date.startswith("-"), -1).otherwise(1)
    return F.when((year + month + day).isNotNull(), F.struct((sign * year).alias("year"), month.alias("month"), day.alias("day")))


def unknown_value(value: Column) -> Column:
    return value.contains("somevalue") | value.contains("novalue")
