"""Small dictionary encodings and user classes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import domain


def code_of(value: Column, codes: dict) -> Column:
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def user_class(username: Column) -> Column:
    return (F.when(F.lower(username).contains("bot"), "BOT")
            .when(username.isNotNull() & (username != ""), "USER").otherwise("ANONYMOUS"))


def user_code(user_type: Column, compat: bool = True) -> Column:
    """Numeric user class. The encoding knows HUMAN, BOT, ANONYMOUS; USER falls through to 0."""
    known = user_type if compat else F.when(user_type == "USER", "HUMAN").otherwise(user_type)
    return F.coalesce(code_of(known, domain.USER_TYPE_CODES), F.lit(0))


def day_code(ts: Column) -> Column:
    return code_of(F.date_format(ts, "EEEE"), domain.DAY_CODES)


def action_code(action: Column) -> Column:
    return code_of(action, domain.ACTION_CODES)
