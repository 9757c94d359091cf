"""Column expressions comparing an old and a new text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters a whitespace split breaks on, also beyond ASCII.
_SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def unquoted(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{_SPACE}+"), lambda t: t != "")


def jaccard(old_tokens: Column, new_tokens: Column) -> Column:
    union = F.size(F.array_union(old_tokens, new_tokens))
    both = F.size(F.array_intersect(old_tokens, new_tokens))
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "")


def adjacent_swap(old: Column, new: Column) -> Column:
    """1 if exactly two neighbouring characters are exchanged.

    Such a pair is at edit distance 2, a bound that the banded distance checks cheaply
    before any character is looked at.
    """
    close = (F.length(old) == F.length(new)) & (F.levenshtein(old, new, 2) == 2)
    differs = F.zip_with(F.split(old, ""), F.split(new, ""), lambda a, b: a != b)
    at = F.array_position(differs, True).cast("int")
    two = F.size(F.filter(differs, lambda d: d)) == 2
    crossed = (F.substr(old, at, F.lit(1)) == F.substr(new, at + 1, F.lit(1))) & (
        F.substr(old, at + 1, F.lit(1)) == F.substr(new, at, F.lit(1)))
    return flag(F.when(close, two & crossed).otherwise(F.lit(False)))


def mean_word_distance(old_tokens: Column, new_tokens: Column) -> Column:
    """Mean edit distance over all pairs of an old and a new word; 0 when there is none."""
    total = F.aggregate(
        old_tokens, F.lit(0).cast("bigint"),
        lambda acc, a: acc + F.aggregate(new_tokens, F.lit(0).cast("bigint"), lambda s, b: s + F.levenshtein(a, b)))
    pairs = F.size(old_tokens).cast("bigint") * F.size(new_tokens)
    return F.coalesce(F.try_divide(total, pairs), F.lit(0.0))
