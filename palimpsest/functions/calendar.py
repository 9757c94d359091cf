"""Calendar difference of two timestamps in whole years, months, days and the rest."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000


def _time_of_day(ts: Column) -> Column:
    return F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))


def age(later: Column, earlier: Column) -> Column:
    """struct(years, months, days, micros): the symbolic age, negative when later < earlier.

    Fields are subtracted one by one; a negative remainder borrows a day, and a negative
    day count borrows the length of the earlier date's month.
    """
    flipped = later < earlier
    a, b = F.greatest(later, earlier), F.least(later, earlier)
    micros = _time_of_day(a) - _time_of_day(b)
    short_day = F.when(micros < 0, 1).otherwise(0)
    days = F.dayofmonth(a) - F.dayofmonth(b) - short_day
    short_month = F.when(days < 0, 1).otherwise(0)
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b) - short_month
    days = days + short_month * F.dayofmonth(F.last_day(b))
    micros = micros + short_day * F.lit(_DAY_MICROS)
    sign = F.when(flipped, -1).otherwise(1)
    whole_years = F.floor(months / 12).cast("int")
    parts = F.struct(
        (sign * whole_years).alias("years"),
        (sign * (months - whole_years * 12)).alias("months"),
        (sign * days).alias("days"),
        (sign * micros).alias("micros"),
    )
    return F.when(later.isNotNull() & earlier.isNotNull(), parts)
