"""Feature frames for training and scoring: assembly, scaling, label columns, folds."""

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.labels import parse_labels
from palimpsest.operators.ordered import DEFAULT_SPLIT, Split, position, with_chunk
from palimpsest.session import shared_dir

FOLD = "fold"
_SPAN_BITS = 50  # of the 62 bits of a hash, those within a span: 4,096 spans a label set
_NUMBERED = 200_000  # rows that are all numbered, in fewer jobs


def truth_column(label: str) -> str:
    return f"y_{label or 'none'}"


def numeric(df: DataFrame, columns) -> DataFrame:
    """Feature columns as DOUBLE, missing and NaN as 0."""
    def clean(c):
        value = F.col(c).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0)).alias(c)

    return df.select(*[clean(c) if c in columns else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class Scaler:
    """Per-column mean and population deviation; a constant column keeps scale 1."""

    mean: dict
    scale: dict
    rows: int = 0

    def apply(self, df: DataFrame, columns, out: str = "features") -> DataFrame:
        cells = [(F.col(c) - F.lit(self.mean[c])) / F.lit(self.scale[c]) for c in columns]
        return df.withColumn(out, F.array(*cells))


def fit_scaler(df: DataFrame, columns) -> Scaler:
    """One aggregate over all columns; its single row of moments comes to the driver."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return Scaler({c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)}, {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)},
                  row["rows"])


def label_classes(df: DataFrame, label: str = "label") -> list[str]:
    """Sorted label vocabulary; a missing label is the class ''."""
    cells = F.explode(_label_list(label)).alias("l")
    return [r["l"] for r in df.select(cells).distinct().orderBy("l").collect()]


def _label_list(label: str):
    given = F.col(label)
    return F.when(given.isNull() | (F.trim(given) == ""), F.array(F.lit(""))).otherwise(parse_labels(given))


def binarise(df: DataFrame, classes, label: str = "label") -> DataFrame:
    """One 0/1 column per class."""
    base = df.withColumn("_l", _label_list(label))
    return base.select(*df.columns, *[
        F.array_contains("_l", c).cast("double").alias(truth_column(c)) for c in classes])


def binarise_single(df: DataFrame, positive: str, label: str = "label") -> DataFrame:
    """The label of a yes/no class, a missing one as non_{class}, and its 0/1 column."""
    named = df.withColumn(label, F.coalesce(F.col(label), F.lit(f"non_{positive}")))
    return named.withColumn(truth_column(positive), (F.col(label) == positive).cast("double"))


def stratified_folds(df: DataFrame, key, k: int = 5, label: str = "label", seed: int = 42,
                     split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """Add ``fold`` 0..k-1 so that each fold has its share of every label set.

    Rows of a label set are numbered in the order of a seeded hash of their key; a frequent
    label set is numbered in chunks.
    """
    base = df.withColumn("_set", F.coalesce(F.col(label), F.lit(""))).withColumn(
        "_h", F.shiftright(F.xxhash64(F.lit(seed), *key), 2))
    base, split = with_chunk(base, ["_set"], "_h", split)
    numbered = position(base, ["_set"], "_h", key, "_n", split)
    return numbered.select(*df.columns, F.pmod(F.col("_n") - 1, F.lit(k)).cast("int").alias(FOLD))


def apportion(sets: dict[tuple, int], k: int) -> dict[tuple, list[int]]:
    """How many rows of each label set every fold gets; ``sets`` maps a label set to its number of rows.

    Labels are served from the rarest on: of each open set that holds the label every fold gets a k-th, and the rows that are
    left over go one by one to the folds that lack most of this label, then most of the set's other labels, then most rows.
    """
    totals = Counter()
    for labels, n in sets.items():
        totals.update(dict.fromkeys(labels, n))
    lack = {label: [n / k] * k for label, n in totals.items()}
    rows, out = [sum(sets.values()) / k] * k, {}
    for label in sorted(totals, key=lambda x: (totals[x], x)):
        for labels in sorted((s for s in sets if label in s and s not in out), key=lambda s: (sets[s], s)):
            base, left = divmod(sets[labels], k)
            out[labels] = [base] * k
            for f in range(k):
                rows[f] -= base
                for x in labels:
                    lack[x][f] -= base
            for _ in range(left):
                f = max((f for f in range(k) if out[labels][f] == base),
                        key=lambda f: (round(lack[label][f], 6), round(sum(lack[x][f] for x in labels), 6), round(rows[f], 6), -f))
                out[labels][f] += 1
                rows[f] -= 1
                for x in labels:
                    lack[x][f] -= 1
    return out


def multilabel_folds(df: DataFrame, key, k: int = 5, label: str = "label", seed: int = 42, split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """Add ``fold`` 0..k-1 so that each fold has its share of every label, and of every set of labels.

    The driver sees the histogram of label sets and decides how many rows of each go to a fold (:func:`apportion`). Rows of a
    set take the folds in turn in the order of a seeded hash of their key. Above ``_NUMBERED`` rows a histogram of the hashes says which
    fold a span of them belongs to; only rows of the few spans that folds share are numbered, and the others are not moved.
    """
    named = F.array_join(F.array_sort(F.array_distinct(_label_list(label))), "\x1f")
    base = df.withColumn("_h", F.shiftright(F.xxhash64(F.lit(seed), *key), 2)).withColumn("_span", F.shiftright("_h", _SPAN_BITS))
    shared_dir(df.sparkSession)
    spans = base.groupBy(label, "_span").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_set", named).checkpoint()
    texts = {r[label] or "": r["_set"] for r in spans.select(label, "_set").distinct().collect()}
    spans = spans.groupBy("_set", "_span").agg(F.sum("_rows").alias("_rows")).checkpoint()
    sets = {tuple(r["_set"].split("\x1f")): r["n"] for r in spans.groupBy("_set").agg(F.sum("_rows").alias("n")).collect()}
    ends = {"\x1f".join(labels): [sum(quota[:f + 1]) for f in range(k)] for labels, quota in apportion(sets, k).items()}
    table = df.sparkSession.createDataFrame(list(ends.items()), "_named string, _ends array<long>")
    if sum(sets.values()) <= _NUMBERED:
        base, split = with_chunk(base.withColumn("_set", named), ["_set"], "_h", split)
        numbered = position(base, ["_set"], "_h", key, "_n", split).join(F.broadcast(table), F.col("_set") == F.col("_named"))
        return numbered.select(*df.columns, F.size(F.filter("_ends", lambda e: e < F.col("_n"))).cast("int").alias(FOLD))
    before = F.sum("_rows").over(Window.partitionBy("_set").orderBy("_span")) - F.col("_rows")
    spans = spans.join(F.broadcast(table), F.col("_set") == F.col("_named")).withColumn("_before", before)
    past = lambda n: F.size(F.filter("_ends", lambda e: e < n)).cast("int")
    spans = spans.select("_set", "_span", "_rows", "_before", past(F.col("_before") + 1).alias("_first"), past(F.col("_before") + F.col("_rows")).alias("_last"))
    starts, mixed, most = {}, {}, 0  # of each set: the first span of every fold, and the spans that folds share with the rows before them
    for r in spans.groupBy("_set", "_first").agg(F.min("_span").alias("start")).collect():
        starts.setdefault(r["_set"], []).append((r["_first"], r["start"]))
    for r in spans.where("_first < _last").collect():
        mixed.setdefault(r["_set"], {})[r["_span"]] = r["_before"]
        most = max(most, r["_rows"])

    def of_set(values: dict):
        cells = [c for text, name in texts.items() if name in values for c in (F.lit(text), values[name])]
        return F.try_element_at(F.create_map(*cells), F.coalesce(F.col(label), F.lit("")))

    begun = of_set({s: F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(at).cast("bigint").alias("at")) for f, at in v]) for s, v in starts.items()})
    fold = F.array_max(F.transform(F.filter(begun, lambda x: x["at"] <= F.col("_span")), lambda x: x["fold"]))
    whole = base
    if mixed:
        shared = of_set({s: F.array(*[F.lit(x).cast("bigint") for x in v]) for s, v in mixed.items()})
        is_shared = F.coalesce(F.array_contains(shared, F.col("_span")), F.lit(False))
        whole = base.where(~is_shared)
    out = whole.select(*df.columns, fold.cast("int").alias(FOLD))
    if not mixed:
        return out
    rows = base.where(is_shared).withColumn("_set", named)
    keys = ["_set", "_span"]
    rows, split = with_chunk(rows, keys, "_h", split) if split and most > split.floor else (rows, None)
    offsets = of_set({s: F.create_map(*[F.lit(x).cast("bigint") for cell in v.items() for x in cell]) for s, v in mixed.items()})
    numbered = position(rows, keys, "_h", key, "_n", split).withColumn("_n", F.col("_n") + F.try_element_at(offsets, F.col("_span")))
    quota = of_set({s: F.array(*[F.lit(x).cast("bigint") for x in v]) for s, v in ends.items() if s in mixed})
    return out.unionByName(numbered.select(*df.columns, F.size(F.filter(quota, lambda e: e < F.col("_n"))).cast("int").alias(FOLD)))
