"""Reachability over an edge table (relation, src, dst)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import flag, trimmed, unquoted
from palimpsest.operators.text_features import text_features
from palimpsest.session import shared_dir

_PAIR = ["relation", "src", "dst"]


def closure(edges: DataFrame, relations=None, max_depth: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """All (relation, src, dst) with a path src to dst, without self pairs.

    Each round extends only the pairs that were new in the round before, by all known
    paths, so path lengths double and the rounds are logarithmic in the depth. With
    ``max_depth``, or with ``seeds`` (one column ``src``: the only sources that will be
    asked for), a round extends by single edges. Each round's new pairs are a checkpoint in
    the shared folder: plans stay short, a lost executor costs no recomputation. Known
    pairs are dropped, so cycles end.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select(*_PAIR).where("src is not null and dst is not null").distinct()
    if relations is not None:
        edges = edges.where(F.col("relation").isin(list(relations)))
    edges = edges.checkpoint()
    step = edges.toDF("relation", "mid", "next")
    front = edges
    if seeds is not None:
        front = edges.join(seeds.select("src").distinct(), "src", "left_semi").select(*_PAIR).checkpoint()
    found = front
    rounds = 1
    while (max_depth is None or rounds < max_depth) and not front.isEmpty():
        onward = step if max_depth is not None or seeds is not None else found.toDF("relation", "mid", "next")
        reached = front.toDF("relation", "src", "mid").join(onward, ["relation", "mid"]).select(
            "relation", "src", F.col("next").alias("dst")).distinct()
        front = reached.join(found, _PAIR, "left_anti").checkpoint()
        found = found.unionByName(front)
        rounds += 1
    return found.where("src <> dst")


# ---- reachability of given pairs, without the closure --------------------------------

_RANKS = 4


def reach_labels(edges: DataFrame) -> DataFrame:
    """(relation, node, d0.., u0..): the least of several random ranks among all nodes that a node reaches (d) and that reach it (u),
    itself included.

    If x reaches y then what y reaches is reached by x too, so no d of x is greater than that of y and no u of y greater than
    that of x; one rank out of order proves that there is no path. Ranks spread from neighbour to neighbour, and only
    nodes whose labels fell in a round pass them on, so the whole takes as many rounds as the longest shortest path, each one join
    of the changed nodes with their edges. Cycles need no care: their nodes end with equal labels. The labels have one row a node,
    however many pairs the closure has.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select(*_PAIR).where("src is not null and dst is not null and src <> dst").distinct()
    names = [f"m{i}" for i in range(_RANKS)]
    links = edges.select("relation", F.explode(F.array(
        F.struct(F.lit("d").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("of")),
        F.struct(F.lit("u").alias("kind"), F.col("dst").alias("node"), F.col("src").alias("of")))).alias("l")).select("relation", "l.*").checkpoint()
    now = links.select("relation", "kind", "node").union(links.select("relation", F.when(F.col("kind") == "d", "u").otherwise("d"), "node")).distinct()
    now = now.select("*", *[F.xxhash64("node", F.lit(i)).alias(n) for i, n in enumerate(names)], F.lit(True).alias("fell")).checkpoint()
    while not (changed := now.where("fell")).isEmpty():
        told = changed.select("relation", "kind", F.col("node").alias("of"), *names).join(links, ["relation", "kind", "of"]).groupBy(
            "relation", "kind", "node").agg(*[F.min(n).alias(f"_{n}") for n in names])
        lower = [F.least(n, f"_{n}").alias(n) for n in names]
        fell = F.lit(False)
        for n in names:
            fell = fell | F.coalesce(F.col(f"_{n}") < F.col(n), F.lit(False))
        now = now.join(told, ["relation", "kind", "node"], "left").select("relation", "kind", "node", *lower, fell.alias("fell")).checkpoint()
    return now.groupBy("relation", "node").agg(*[
        F.max(F.when(F.col("kind") == k, F.col(n))).alias(f"{k}{i}") for k in ("d", "u") for i, n in enumerate(names)])


def _possible(node: str, target: str) -> Column:
    """Whether labels allow a path from the one to the other."""
    out = F.lit(True)
    for i in range(_RANKS):
        out = out & (F.col(f"{node}.d{i}") <= F.col(f"{target}.d{i}")) & (F.col(f"{target}.u{i}") <= F.col(f"{node}.u{i}"))
    return out


def reachable_pairs(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct (relation, src, dst) of ``asked`` with a path from src to dst; pairs of one node with itself have none.

    Labels (:func:`reach_labels`) dismiss most pairs without a path. What is left is searched exactly, all pairs at once: a
    round follows the edges out of the nodes reached last, keeps those whose labels allow the pair's target, and ends for pairs
    that have arrived. Nothing of the closure is stored but the nodes between the pairs that were asked for.
    """
    shared_dir(edges.sparkSession)
    pairs = asked.select(*_PAIR).where("src <> dst").distinct()
    edges = edges.join(pairs.select("relation").distinct(), "relation", "left_semi")
    labels = reach_labels(edges).checkpoint()
    packed = labels.select("relation", "node", F.struct(*[c for c in labels.columns if c not in ("relation", "node")]).alias("l"))
    start = pairs.join(packed.select("relation", F.col("node").alias("src"), F.col("l").alias("a")), ["relation", "src"]).join(
        packed.select("relation", F.col("node").alias("dst"), F.col("l").alias("b")), ["relation", "dst"]).where(_possible("a", "b"))
    step = edges.select(*_PAIR).where("src <> dst").distinct().join(packed.select("relation", F.col("node").alias("dst"), F.col("l").alias("a")), [
        "relation", "dst"]).select("relation", F.col("src").alias("node"), F.col("dst").alias("next"), "a").checkpoint()
    key = [*_PAIR, "node"]
    front = start.select(*_PAIR, F.col("src").alias("node"), "b").checkpoint()
    seen, found = front.select(*key), None
    while not front.isEmpty():
        moved = front.join(step, ["relation", "node"]).where(_possible("a", "b")).select(*_PAIR, F.col("next").alias("node"), "b").dropDuplicates(key)
        moved = moved.join(seen, key, "left_anti").checkpoint()
        arrived = moved.where("node = dst").select(*_PAIR)
        found = arrived if found is None else found.unionByName(arrived)
        seen = seen.unionByName(moved.select(*key))
        front = moved.join(arrived, _PAIR, "left_anti")
    return found if found is not None else pairs.limit(0)


def asked_pairs(df: DataFrame, relations, old: str = "old_value", new: str = "new_value") -> DataFrame:
    """(relation, src, dst): both values of every change in both directions, for each relation."""
    base = df.select(_cleaned(old).alias("o"), _cleaned(new).alias("n")).where("o <> n").distinct()
    ways = F.array(F.struct(F.col("o").alias("src"), F.col("n").alias("dst")), F.struct(F.col("n").alias("src"), F.col("o").alias("dst")))
    return base.select(F.explode(ways).alias("w")).select(F.explode(F.array(*[F.lit(r) for r in relations])).alias("relation"), "w.src", "w.dst").distinct()


def paths(edges: DataFrame, steps, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst) with src <> dst, joined by a path whose relations match ``steps``, a list of (relation, how often).

    How often is ``1``, ``?``, ``+`` or ``*``: once, at most once, at least once, any number of times. The steps are a small
    automaton; the search runs over (source, node, state) and extends only what was new in the round before, so cycles end. With
    ``seeds`` (one column ``src``) only paths from these are followed.
    """
    shared_dir(edges.sparkSession)
    optional = [often in "?*" for _, often in steps]
    moves = [(s, relation, t + 1) for s in range(len(steps) + 1) for t, (relation, often) in enumerate(steps)
             if (t >= s and all(optional[s:t])) or (t == s - 1 and often in "+*")]
    final = [s for s in range(len(steps) + 1) if all(optional[s:])]
    rules = edges.sparkSession.createDataFrame(moves, "state int, relation string, next_state int")
    step = edges.select("relation", F.col("src").alias("node"), F.col("dst").alias("next")).where("node is not null and next is not null").join(
        F.broadcast(rules), "relation").select("node", "state", "next", "next_state").distinct().checkpoint()
    front = step.where("state = 0").select(F.col("node").alias("src"), "node", "state").distinct()
    if seeds is not None:
        front = front.join(seeds.select("src").distinct(), "src", "left_semi")
    front = front.checkpoint()
    found = None
    while not front.isEmpty():
        reached = front.join(step, ["node", "state"]).select("src", F.col("next").alias("node"), F.col("next_state").alias("state")).distinct()
        front = (reached if found is None else reached.join(found, ["src", "node", "state"], "left_anti")).checkpoint()
        found = front if found is None else found.unionByName(front)
    if found is None:
        return front.select("src", F.col("node").alias("dst"))
    return found.where(F.col("state").isin(final)).select("src", F.col("node").alias("dst")).where("src <> dst").distinct()


def composite_path(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs (src, dst) joined by a path of the first closure followed by one of the second."""
    a = first.select("src", F.col("dst").alias("mid"))
    b = second.select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").where("src <> dst").select("src", "dst").distinct()


def entity_types(df: DataFrame, edges: DataFrame, entity: str, relation: str = "instance_of",
                 out: str = "types") -> DataFrame:
    """Add the sorted list of types of an entity column; an unknown entity has an empty list."""
    types = edges.where(F.col("relation") == relation).groupBy(F.col("src").alias("_entity")).agg(
        F.sort_array(F.collect_set("dst")).alias(out))
    joined = df.join(types, F.col(entity) == F.col("_entity"), "left").drop("_entity")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def _cleaned(c: str) -> Column:
    return trimmed(unquoted(F.col(c)))


def sources(df: DataFrame, old: str = "old_value", new: str = "new_value") -> DataFrame:
    """Both values of every change, as the ``seeds`` of a closure that is asked for these changes only."""
    return df.select(F.explode(F.array(_cleaned(old), _cleaned(new))).alias("src")).where(F.col("src").isNotNull()).distinct()


def reach_flags(df: DataFrame, closed: DataFrame, relations: dict, old: str = "old_value",
                new: str = "new_value") -> DataFrame:
    """Add {old,new}_value_<name>_{new,old}_value flags for each relation, both directions.

    ``relations`` maps a relation of the closure to the name used in the columns. The
    closure turns into one row per unordered pair, so the change rows shuffle once for
    all relations and both directions.
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    wanted = closed.where(F.col("relation").isin(list(relations)))
    up = F.col("src") <= F.col("dst")
    pivoted = wanted.groupBy(lo.alias("_lo"), hi.alias("_hi")).agg(*[
        F.max(F.when((F.col("relation") == rel) & (up if forward else ~up), 1).otherwise(0)).alias(f"_{name}_{int(forward)}")
        for rel, name in relations.items() for forward in (True, False)])
    names = df.columns
    base = df.select("*", _cleaned(old).alias("_o"), _cleaned(new).alias("_n"))
    joined = base.join(pivoted, (F.least("_o", "_n") == F.col("_lo")) & (F.greatest("_o", "_n") == F.col("_hi")), "left")
    old_first = F.col("_o") <= F.col("_n")
    columns = []
    for name in relations.values():
        forward, backward = F.col(f"_{name}_1"), F.col(f"_{name}_0")
        columns += [
            F.coalesce(F.when(old_first, backward).otherwise(forward), F.lit(0)).alias(f"new_value_{name}_old_value"),
            F.coalesce(F.when(old_first, forward).otherwise(backward), F.lit(0)).alias(f"old_value_{name}_new_value"),
        ]
    return joined.select(*names, *columns)


def metaclass_flags(df: DataFrame, closed: DataFrame, relation: str = "metaclass", old: str = "old_value",
                    new: str = "new_value") -> DataFrame:
    """Add is-metaclass-for flags; "new is metaclass for old" holds where a path leads from old to new."""
    flags = reach_flags(df, closed, {relation: "_m"}, old, new)
    return flags.withColumnsRenamed({
        "old_value__m_new_value": "new_value_is_metaclass_for_old_value",
        "new_value__m_old_value": "old_value_is_metaclass_for_new_value"})


def composite_flags(df: DataFrame, first: DataFrame, second: DataFrame, old: str = "old_value", new: str = "new_value",
                    name: str = "subclass_part_of") -> DataFrame:
    """Add {old,new}_value_<name>_{new,old}_value: a path of the first closure, then one of the second.

    Only the distinct pairs that occur in ``df`` are followed.
    """
    names = df.columns
    base = df.select("*", _cleaned(old).alias("_o"), _cleaned(new).alias("_n"))
    ways = F.array(F.struct(F.col("_o").alias("a"), F.col("_n").alias("b")), F.struct(F.col("_n").alias("a"), F.col("_o").alias("b")))
    asked = base.select(F.explode(ways).alias("w")).select("w.a", "w.b").where("a <> b").distinct()
    hops = asked.join(first.select(F.col("src").alias("a"), F.col("dst").alias("mid")), "a")
    linked = hops.join(second.select(F.col("src").alias("mid"), F.col("dst").alias("b")), ["mid", "b"], "left_semi").select("a", "b").distinct()
    forward = linked.select(F.col("a").alias("_o"), F.col("b").alias("_n"), F.lit(1).alias("_f"))
    backward = linked.select(F.col("b").alias("_o"), F.col("a").alias("_n"), F.lit(1).alias("_b"))
    joined = base.join(forward, ["_o", "_n"], "left").join(backward, ["_o", "_n"], "left")
    return joined.select(*names, F.coalesce("_f", F.lit(0)).alias(f"old_value_{name}_new_value"),
                         F.coalesce("_b", F.lit(0)).alias(f"new_value_{name}_old_value"))


# Relation of the closure -> name in the feature columns (fixed values).
ENTITY_RELATIONS = {"subclass": "subclass", "located_in": "located_in", "has_part": "has_parts", "part_of": "part_of"}
ENTITY_COLUMNS = [
    "token_overlap", "old_in_new", "new_in_old", "edit_distance_ratio", "complete_replacement", "is_link_change",
] + [f"{s}_value_{n}_{o}_value" for n in ENTITY_RELATIONS.values() for s, o in (("new", "old"), ("old", "new"))]


def entity_features(df: DataFrame, closed: DataFrame, old_label: str = "old_value_label",
                    new_label: str = "new_value_label", old: str = "old_value", new: str = "new_value") -> DataFrame:
    """Add label-overlap features, the link-change flag and the closure flags of an entity change."""
    labelled = text_features(df, old_label, new_label, subset="label")
    link = flag((F.col(old_label) == F.col(new_label)) & (F.col(old) != F.col(new)))
    return reach_flags(labelled.withColumn("is_link_change", link), closed, ENTITY_RELATIONS, old, new)
