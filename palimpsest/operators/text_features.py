"""Features of a change between two texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.editops import edit_ops
from palimpsest.functions.text import (
    adjacent_swap, alphanumeric, flag, jaccard, mean_word_distance, tokens, trimmed, unquoted,
)
from palimpsest.functions.vectors import cosine

OVERLAP_COLUMNS = ["token_overlap", "old_in_new", "new_in_old", "edit_distance_ratio", "complete_replacement"]
TEXT_COLUMNS = OVERLAP_COLUMNS + [
    "length_diff_abs", "token_count_old", "token_count_new", "levenshtein_distance",
    "same_value_without_special_char", "special_char_count_diff",
    "char_insertions", "char_deletions", "char_substitutions", "adjacent_char_swap",
    "has_significant_prefix", "has_significant_suffix",
]


def text_features(df: DataFrame, old: str = "old_value", new: str = "new_value", subset: str = "full",
                  extras: bool = False) -> DataFrame:
    """Add text-change features; rows whose old or new text is ``{}``, ``nan`` or NULL are dropped.

    ``subset='label'`` gives only the overlap group, as used for entity labels. ``extras``
    adds the computed-but-unused ones (special characters added/removed, structure, words).
    """
    names = df.columns
    base = df.select("*", unquoted(F.col(old)).alias("_old"), unquoted(F.col(new)).alias("_new"))
    base = base.where(~F.col("_old").isin("{}", "nan") & ~F.col("_new").isin("{}", "nan"))
    # A separate projection per level keeps each split or distance evaluated once.
    base = base.select("*", tokens(F.col("_old")).alias("_told"), tokens(F.col("_new")).alias("_tnew"),
                       F.levenshtein(trimmed(F.lower("_old")), trimmed(F.lower("_new"))).alias("levenshtein_distance"))
    a, b = F.col("_old"), F.col("_new")
    base = base.select(
        "*", jaccard(F.col("_told"), F.col("_tnew")).alias("token_overlap"),
        flag(b.contains(a)).alias("old_in_new"), flag(a.contains(b)).alias("new_in_old"),
        (F.col("levenshtein_distance") / F.greatest(F.length(a), F.length(b), F.lit(1))).alias("edit_distance_ratio"))
    replaced = (F.col("token_overlap") == 0) & (F.col("old_in_new") == 0) & (F.col("new_in_old") == 0)
    overlap = [F.col(c) for c in OVERLAP_COLUMNS[:-1]] + [flag(replaced).alias("complete_replacement")]
    if subset == "label":
        return base.select(*names, *overlap)

    base = base.select("*", alphanumeric(a).alias("_aold"), alphanumeric(b).alias("_anew"), edit_ops(a, b).alias("_ops"))
    special = (F.length(b) - F.length("_anew")) - (F.length(a) - F.length("_aold"))
    same_plain = flag(F.col("_aold") == F.col("_anew"))
    columns = overlap + [
        F.abs(F.length(b) - F.length(a)).alias("length_diff_abs"),
        F.size("_told").alias("token_count_old"), F.size("_tnew").alias("token_count_new"),
        F.col("levenshtein_distance"),
        same_plain.alias("same_value_without_special_char"), special.alias("special_char_count_diff"),
        F.col("_ops.char_insertions"), F.col("_ops.char_deletions"), F.col("_ops.char_substitutions"),
        adjacent_swap(a, b).alias("adjacent_char_swap"),
        flag((F.length(a) >= 3) & (F.left(a, F.lit(3)) == F.left(b, F.lit(3)))).alias("has_significant_prefix"),
        flag((F.length(a) >= 3) & (F.right(a, F.lit(3)) == F.right(b, F.lit(3)))).alias("has_significant_suffix"),
    ]
    if extras:
        most = F.greatest(F.size("_told"), F.size("_tnew"))
        columns += [
            flag(special > 0).alias("special_chars_added"), flag(special < 0).alias("special_chars_removed"),
            flag((same_plain == 1) & (special != 0)).alias("only_special_char_change"),
            (1 - F.try_divide(F.abs(F.size("_told") - F.size("_tnew")), most)).alias("structure_similarity"),
            mean_word_distance(F.col("_told"), F.col("_tnew")).alias("avg_word_similarity"),
        ]
    return base.select(*names, *columns)


def similarity_features(df: DataFrame, pairs: dict) -> DataFrame:
    """Add cosine columns; ``pairs`` maps an output name to (old vector, new vector)."""
    return df.select("*", *[cosine(F.col(a), F.col(b)).alias(name) for name, (a, b) in pairs.items()])
