"""Reversions found while the change log is still arriving, within a bounded horizon."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.domain import STATEMENT_KEY
from palimpsest.functions.shipping import by_value
from palimpsest.operators.reversion import restores, undo_of

by_value(__name__)


def reversion_stream(changes: DataFrame, keys=STATEMENT_KEY, ids=("revision_id",), ts: str = "timestamp",
                     horizon: str = "28 days", lateness: str = "1 hour", salts: int = 1) -> DataFrame:
    """Stream of (ids, reversion_timestamp): each change with every later one that inverts it.

    A stream-stream left outer join on statement and hash. A change none of the others
    inverts appears once with NULL when the horizon has passed; rows later than
    ``lateness`` are dropped. ``salts`` spreads the state of a busy statement: each change
    waits in all salts, each possible undoing lands in one (a NULL row per salt is then
    possible; ``first_reversions`` folds them).
    """
    old, new = F.col("old_hash"), F.col("new_hash")
    at = F.col(ts).cast("timestamp")
    seeks = changes.select(
        *[F.col(k).alias(f"s_{k}") for k in keys], *ids, undo_of(old, new).alias("s_match"), at.alias("s_at"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s_salt")).withWatermark("s_at", lateness)
    offers = changes.select(
        *[F.col(k).alias(f"o_{k}") for k in keys], restores(old, new).alias("o_match"), at.alias("o_at"),
        F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int").alias("o_salt")).withWatermark("o_at", lateness)
    same = [F.col(f"s_{k}") == F.col(f"o_{k}") for k in keys]
    later = F.expr(f"s_match = o_match and s_salt = o_salt and o_at > s_at and o_at <= s_at + interval {horizon}")
    cond = later
    for c in same:
        cond = cond & c
    return seeks.join(offers, cond, "left_outer").select(
        *ids, F.col("s_at").alias("changed_at"), F.col("o_at").alias("reversion_timestamp"))


def first_reversion_stream(changes: DataFrame, keys=STATEMENT_KEY, ids=("revision_id",), ts: str = "timestamp",
                           horizon: str = "28 days", lateness: str = "1 hour", salts: int = 1) -> DataFrame:
    """Stream of (ids, changed_at, reversion_timestamp): each change with the first later one that inverts it.

    One row a change instead of one a pair, so the output grows with the changes however often a state returns. A change waits in the
    state of its statement and hash until it is inverted or the horizon has passed; what can still come late is kept for ``lateness``.
    A late inversion before the one already written gives a second row, of which ``first_reversions`` takes the earlier. Changes that
    none inverts give no row. ``salts`` spreads a busy statement: each change waits in one salt, each possible undoing goes to all.
    """
    count, unit = re.fullmatch(r"(\d+) (day|hour|minute|second)s?", horizon).groups()
    within = int(count) * {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}[unit] * 1_000_000
    old, new, every = F.col("old_hash"), F.col("new_hash"), F.sequence(F.lit(0), F.lit(salts - 1))
    roles = F.array(F.struct(F.lit(True).alias("seeks"), undo_of(old, new).alias("match"),
                             F.array(F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int")).alias("salts")),
                    F.struct(F.lit(False).alias("seeks"), restores(old, new).alias("match"), every.alias("salts")))
    group = [*[f"k_{k}" for k in keys], "match", "salt"]
    rows = changes.select(F.col(ts).cast("timestamp").alias("at"), *[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(i).cast("string").alias(f"id_{i}") for i in ids],
                          F.explode(roles).alias("r")).select("at", F.unix_micros("at").alias("us"), *[f"k_{k}" for k in keys], *[f"id_{i}" for i in ids],
                                                              "r.seeks", "r.match", F.explode("r.salts").alias("salt"))
    rows = rows.withWatermark("at", lateness).dropna(subset=["at", *group])
    kinds = {f"id_{i}": T.StringType() for i in ids}  # pandas may widen a column of integers
    long = T.LongType()
    out = T.StructType([*[T.StructField(i, t) for i, t in kinds.items()], T.StructField("us", long), T.StructField("first", long)])
    kept = T.StructType([T.StructField("offers", T.ArrayType(long)), *[T.StructField(c, T.ArrayType(t)) for c, t in (
        *kinds.items(), ("us", long), ("first", long))]])
    columns, never, whole = [*kinds, "us", "first"], np.iinfo(np.int64).max, {"us": "int64", "first": "int64"}

    def find(key, parts, state: GroupState):
        offers, waiting = [], []
        if state.exists:
            held = state.get
            offers.append(np.array(held[0], dtype=np.int64))
            waiting.append(pd.DataFrame(dict(zip(columns, map(list, held[1:])))).astype(whole))
        for part in parts:
            seeks, us = part["seeks"].to_numpy(dtype=bool), part["us"].to_numpy(dtype=np.int64)
            offers.append(us[~seeks])
            waiting.append(part.loc[seeks, [*kinds, "us"]].assign(first=never).astype(whole))
        offers, seekers = np.sort(np.concatenate(offers)), pd.concat(waiting, ignore_index=True)
        at, first = seekers["us"].to_numpy(dtype=np.int64), seekers["first"].to_numpy(dtype=np.int64)
        found = np.append(offers, never)[np.searchsorted(offers, at, side="right")]
        found = np.where(found - at <= within, found, never)
        better = found < first
        seekers["first"] = np.minimum(first, found)
        passed = state.getCurrentWatermarkMs() * 1_000
        last = np.where(seekers["first"] < never, seekers["first"], at + within)
        offers, left = offers[offers >= passed], seekers[last >= passed]
        ends = np.concatenate([offers, last[last >= passed]])
        if len(ends):
            state.update((offers.tolist(), *[left[c].tolist() for c in columns]))
            state.setTimeoutTimestamp(max(int(ends.min()) // 1_000, passed // 1_000) + 1)
        elif state.exists:
            state.remove()
        if better.any():
            yield seekers.loc[better, columns]

    firsts = rows.groupBy(*group).applyInPandasWithState(find, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return firsts.select(*[F.col(f"id_{i}").cast(changes.schema[i].dataType).alias(i) for i in ids], F.timestamp_micros("us").alias("changed_at"),
                         F.timestamp_micros("first").alias("reversion_timestamp"))


def first_reversions(pairs: DataFrame, ids=("revision_id",)) -> DataFrame:
    """The first reversion per change from the rows written by either stream."""
    return pairs.groupBy(*ids).agg(F.min("changed_at").alias("changed_at"), F.min("reversion_timestamp").alias("first_reversion"))
