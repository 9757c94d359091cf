"""Column expressions comparing two numbers kept as text, given as their ``anatomy``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import flag

def to_number(c: Column) -> Column:
    """The text as DOUBLE, NULL where it is no decimal number (also for NaN, infinity and suffixes such as 1d)."""
    return F.when(c.rlike("^[0-9eE+. -]*$"), c.try_cast("double"))


def anatomy(c: Column) -> Column:
    """struct(text, number, floor, whole, decimals, digits) of a number text; NULL for no text.

    ``number`` is NULL for what is no number; ``decimals`` is '' without a point.
    """
    number = to_number(c)
    return F.when(c.isNotNull(), F.struct(
        c.alias("text"), number.alias("number"), F.floor(F.abs(number)).alias("floor"),
        F.substring_index(c, ".", 1).alias("whole"),
        F.when(c.contains("."), F.split_part(c, F.lit("."), F.lit(2))).otherwise("").alias("decimals"),
        F.length(_without(c, "+", "-", ".")).alias("digits")))


def _without(c: Column, *marks: str) -> Column:
    for mark in marks:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return c


def _significant(a: Column) -> Column:
    part = a["decimals"]
    return F.when(part.rlike("^[0-9]*[1-9][0-9]*$"), part).otherwise("0")


def precision_change(a: Column, b: Column) -> Column:
    return flag((a["whole"] == b["whole"]) & (a["decimals"] != b["decimals"]) & (_significant(a) != _significant(b)))


def sign_change(a: Column, b: Column) -> Column:
    return flag((a["number"] * b["number"] < 0) & (a["floor"] == b["floor"]))


def whole_number_change(a: Column, b: Column) -> Column:
    return flag(a["floor"] != b["floor"])


def length_increase(a: Column, b: Column) -> Column:
    return flag((b["digits"] > a["digits"]) & b["text"].startswith(a["text"]))


def length_decrease(a: Column, b: Column) -> Column:
    return flag((b["digits"] < a["digits"]) & a["text"].startswith(b["text"]))


def length_decrease_crossed(a: Column, b: Column) -> Column:
    """Asks whether the shorter new text starts with the longer old one, which never holds."""
    return flag((b["digits"] < a["digits"]) & b["text"].startswith(a["text"]))


def same_float(a: Column, b: Column) -> Column:
    return flag(a["number"] == b["number"])


def precision_added(a: Column, b: Column) -> Column:
    return flag((a["whole"] == b["whole"]) & b["text"].contains(".") & ~a["text"].contains("."))


def precision_removed(a: Column, b: Column) -> Column:
    return precision_added(b, a)


def same_decimal_length(a: Column, b: Column) -> Column:
    return flag(F.length(a["decimals"]) == F.length(b["decimals"]))
