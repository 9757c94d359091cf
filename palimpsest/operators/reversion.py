"""Reversions and neighbours in time, per statement, without self-joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.domain import REVERT_WORDS, STATEMENT_KEY
from palimpsest.functions.lookup import action_code, day_code, user_class, user_code
from palimpsest.functions.text import flag
from palimpsest.operators.ordered import CHUNK, DEFAULT_SPLIT, Fold, Split, position, running, settled, with_chunk

DAY_MICROS = 86_400_000_000
US = "_us"
REVERTED_COLUMNS = [
    "user_type_encoded", "day_of_week_encoded", "hour_of_day", "is_weekend", "action_encoded",
    "is_reverted_within_day", "num_changes_same_user_last_24h", "rv_keyword_in_comment_next_10",
    "hash_reversion_next_10", "time_to_prev_change_seconds", "time_to_next_change_seconds",
]


def undo_of(old: Column, new: Column) -> Column:
    """What a later change must restore to undo this one: the old state, or the absence before a create."""
    return F.when(old != "", F.concat(F.lit("U:"), old)).when(old == "", F.concat(F.lit("C:"), new))


def restores(old: Column, new: Column) -> Column:
    """What this change restores, in the terms of ``undo_of``."""
    return F.when(new != "", F.concat(F.lit("U:"), new)).when(new == "", F.concat(F.lit("C:"), old))


def _seek_and_offer(df: DataFrame, keys, seeks: Column, offers: Column, value: str = US) -> DataFrame:
    """Each change once as a seeker of its undoing and once as an offer of what it restores.

    An offer brings its ``value``. A change with a NULL hash offers nothing, so seekers
    without a match value meet none.
    """
    old, new = F.col("old_hash"), F.col("new_hash")
    shared = [c for c in (*keys, US, CHUNK) if c in df.columns]
    carried = F.struct(*[c for c in df.columns if c not in shared])
    row_type = df.select(carried.alias("s")).schema["s"].dataType
    seek = F.when(seeks, F.struct(undo_of(old, new).alias("match"), carried.alias("row"), F.lit(None).cast("bigint").alias("at")))
    offer = F.when(offers, F.struct(restores(old, new).alias("match"), F.lit(None).cast(row_type).alias("row"),
                                    F.when(restores(old, new).isNotNull(), F.col(value)).alias("at")))
    sides = df.select(*shared, F.explode(F.array_compact(F.array(seek, offer))).alias("_s"))
    return sides.select(*shared, F.col("_s.match").alias("_match"), F.col("_s.row").alias("_row"), F.col("_s.at").alias("_at"))


def _timed(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(US, F.unix_micros(F.col(ts).cast("timestamp")))


def _prepared(df: DataFrame, keys, ts: str, split):
    return with_chunk(_timed(df, ts), keys, US, split)


def first_reversion(df: DataFrame, keys=STATEMENT_KEY, ts: str = "timestamp", out: str = "first_reversion_us",
                    split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """Add the micros of the first strictly later change that inverts this one, NULL if none."""
    prepared, split = _prepared(df, keys, ts, split)
    return _first_reversion(prepared, keys, out, US, split).select(*df.columns, out)


def _first_reversion(df: DataFrame, keys, out: str, value: str, split) -> DataFrame:
    sides = _seek_and_offer(df, keys, F.lit(True), F.lit(True), value)
    met = running(sides, US, [Fold(out, "min", "_at", (*keys, "_match"), later=True)], split)
    return met.where(F.col("_row").isNotNull()).select("*", "_row.*").select(*df.columns, out)


def reversion_pairs(df: DataFrame, keys=STATEMENT_KEY, ts: str = "timestamp", split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """Per reverted change, how many later reversions invert it and the micros to all of them together."""
    prepared, split = _prepared(df, keys, ts, split)
    sides = _seek_and_offer(prepared, keys, F.col("is_reverted") == 1, F.col("reversion") == 1)
    # decimal: a sum of epoch micros over a hot key does not fit 64 bits
    sides = sides.withColumn("_one", F.when(F.col("_at").isNotNull(), F.lit(1).cast("bigint"))).withColumn(
        "_dec", F.col("_at").cast("decimal(38,0)"))
    match = (*keys, "_match")
    met = running(sides, US, [Fold("pairs", "sum", "_one", match, True), Fold("_total", "sum", "_dec", match, True)], split)
    kept = met.where(F.col("_row").isNotNull() & (F.col("pairs") > 0))
    waited = F.col("_total") - F.col("pairs").cast("decimal(38,0)") * F.col(US)
    return kept.select("*", "_row.*").select(*df.columns, "pairs", waited.cast("decimal(38,0)").alias("wait_micros"))


def keyword_in_next(df: DataFrame, keys=STATEMENT_KEY, ts: str = "timestamp", words=REVERT_WORDS, n: int = 10,
                    ties=("revision_id",), out: str = "rv_keyword_in_comment_next_10",
                    split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """1 if one of the next ``n`` strictly later changes has a keyword in its comment."""
    prepared, split = _prepared(df, keys, ts, split)
    return _next_positions(prepared, keys, words, ties, split).select(*df.columns, _keyword_near(n).alias(out))


def _next_positions(df: DataFrame, keys, words, ties, split) -> DataFrame:
    """Add _rn, and over the strictly later rows _next_rn and _next_kw: the first position, the first with a keyword."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.coalesce(F.lower("comment").contains(word), F.lit(False))
    ranked = position(df, keys, US, ties, "_rn", split).withColumn("_kw", F.when(hit, F.col("_rn")))
    folds = [Fold("_next_kw", "min", "_kw", tuple(keys), True), Fold("_next_rn", "min", "_rn", tuple(keys), True)]
    return running(ranked, US, folds, split)


def _keyword_near(n: int) -> Column:
    return flag(F.coalesce(F.col("_next_kw") < F.col("_next_rn") + n, F.lit(False)))


def time_to_neighbour(df: DataFrame, keys=STATEMENT_KEY, fallback=("entity_id", "property_id"), ts: str = "timestamp",
                      split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """Seconds to the nearest strictly earlier / later change of the key, else of the fallback key, else -1."""
    prepared, split = _prepared(df, fallback, ts, split)
    return _time_to_neighbour(prepared, keys, fallback, split).select(
        *df.columns, "time_to_prev_change_seconds", "time_to_next_change_seconds")


def _time_to_neighbour(df: DataFrame, keys, fallback, split) -> DataFrame:
    # the rows are placed by the coarser key, which serves the windows of both
    keys, fallback = tuple(keys), tuple(fallback)
    met = running(df, US, [
        Fold("_nf", "min", US, fallback, True), Fold("_pf", "max", US, fallback),
        Fold("_nk", "min", US, keys, True), Fold("_pk", "max", US, keys)], split)
    us = F.col(US)
    nxt = F.coalesce((F.coalesce("_nk", "_nf") - us) / 1_000_000, F.lit(-1.0))
    prev = F.coalesce((us - F.coalesce("_pk", "_pf")) / 1_000_000, F.lit(-1.0))
    return met.select(*df.columns, prev.alias("time_to_prev_change_seconds"), nxt.alias("time_to_next_change_seconds"))


def trailing_count(df: DataFrame, keys=(*STATEMENT_KEY, "username"), ts: str = "timestamp", seconds: int = 86_400,
                   out: str = "num_changes_same_user_last_24h", split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """How many earlier changes of the key lie at most ``seconds`` back (NULL keys count nothing).

    The count is a difference of two running counts, at the change and at the start of its
    interval, so the cost does not grow with the number of changes inside the interval.
    """
    keys, names = list(keys), df.columns
    timed = _timed(df, ts)
    instants = timed.select(*keys, US).dropna(subset=keys).groupBy(*keys, US).agg(F.count(F.lit(1)).alias("_n"))
    probes = F.array(
        F.struct(F.col(US).alias("at"), F.col("_n").alias("n"), F.lit(1).alias("sign")),
        F.struct((F.col(US) - seconds * 1_000_000).alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("sign")))
    marks = instants.select(*keys, F.col(US).alias("_of"), F.explode(probes).alias("_p")).select(
        *keys, "_of", F.col("_p.at").alias("_at"), F.col("_p.n").alias("_n"), F.col("_p.sign").alias("_sign"))
    marks, split = with_chunk(marks, keys, "_at", split)
    counted = running(marks, "_at", [Fold("_c", "sum", "_n", tuple(keys))], split)
    totals = counted.groupBy(*keys, "_of").agg(F.sum(F.col("_c") * F.col("_sign")).alias("_total"))
    tags = [f"_j{i}" for i in range(len(keys))]
    right = totals.select(*[F.col(k).alias(t) for k, t in zip(keys, tags)], "_of", "_total")
    cond = [F.col(k) == F.col(t) for k, t in zip(keys, tags)] + [F.col(US) == F.col("_of")]
    return timed.join(right, cond, "left").select(*names, F.coalesce("_total", F.lit(0)).cast("bigint").alias(out))


def reverted_features(df: DataFrame, keys=STATEMENT_KEY, fallback=("entity_id", "property_id"), ts: str = "timestamp",
                      compat: bool = True, split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """Add all features of the reverted-edit class to a log with timestamp, username, action, comment, hashes.

    ``compat`` looks for a hash inversion among all later changes although the feature is
    named for the next 10, and leaves registered users without an own code.
    """
    names = df.columns
    at = F.col(ts).cast("timestamp")
    user = user_class(F.col("username"))
    base = df.select(
        "*", user_code(user, compat).alias("user_type_encoded"), day_code(at).alias("day_of_week_encoded"),
        F.hour(at).alias("hour_of_day"), flag(F.weekday(at) >= 5).alias("is_weekend"),
        action_code(F.col("action")).alias("action_encoded"))
    base = trailing_count(base, [*keys, "username"], ts, split=split)
    base, split = _prepared(base, fallback, ts, split)
    base = _time_to_neighbour(settled(base, split), keys, fallback, split)
    base = _next_positions(settled(base, split), keys, REVERT_WORDS, ("revision_id",), split)
    base = _first_reversion(settled(base, split), keys, "_rev", US, split)
    undone = F.col("_rev").isNotNull()
    if not compat:
        base = _first_reversion(settled(base, split), keys, "_rev_rn", "_rn", split)
        undone = F.coalesce(F.col("_rev_rn") < F.col("_next_rn") + 10, F.lit(False))
    day = F.coalesce(F.col("_rev") - F.col(US) <= DAY_MICROS, F.lit(False))
    return base.select(
        *names, *REVERTED_COLUMNS[:5], flag(day).alias("is_reverted_within_day"), REVERTED_COLUMNS[6],
        _keyword_near(10).alias(REVERTED_COLUMNS[7]), flag(undone).alias("hash_reversion_next_10"), *REVERTED_COLUMNS[9:])


def sample_training_set(df: DataFrame, anchor: str = "anchor_revision_id", label: str = "label",
                        positive: str = "reverted_edit", ids=("revision_id",), seed: int = 42) -> DataFrame:
    """All positives and, per anchor, one of the other changes picked by a seeded hash."""
    chosen = F.col(label) == positive
    order = F.struct(F.xxhash64(F.lit(seed), *ids).alias("h"), *ids)
    others = df.where(~F.coalesce(chosen, F.lit(False)))
    one = others.groupBy(anchor).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")
    return df.where(chosen).unionByName(one)
