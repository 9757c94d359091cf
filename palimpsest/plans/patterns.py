"""Edit patterns: refinements, oscillations, soft insertions and deletions, links, formats."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.domain import STATEMENT_KEY
from palimpsest.functions.jsontext import scalar_text
from palimpsest.functions.numbers import to_number
from palimpsest.operators.latest import latest_per_key, no_later_row
from palimpsest.operators.ordered import DEFAULT_SPLIT, Split, adjacent, position, with_chunk
from palimpsest.session import shared_dir

_KEY = list(STATEMENT_KEY)
_LASTING = "is_reverted = 0 and reversion = 0"
# Parts of a time text: a year alone (two forms), anywhere or at the start; a month, a day not known; no day after a month (fixed values).
YEAR_ALONE = ("\\d+-00-00", "\\d+-01-01")
YEAR_ALONE_FIRST = ("^\\+?\\d+-00-00", "^\\+?\\d+-01-01")
NO_MONTH, NO_DAY, MONTH_NO_DAY = "\\d+-00-", "-00T", "\\d+-\\d{2}-00"
# A degree-minute-second coordinate in a comment (fixed value).
DMS = "(\\d+)°(\\d+)'(\\d+\\.?\\d*)\""


def _any(text, patterns):
    found = text.rlike(patterns[0])
    for p in patterns[1:]:
        found = found | text.rlike(p)
    return found


def _total(condition):
    """Sum of a 0/1 condition: NULL, not 0, when there are no rows."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def oscillations(features_entity: DataFrame, revision: DataFrame, at_least: int = 2, arrow: str = " -> ",
                 split: Split | None = DEFAULT_SPLIT) -> DataFrame:
    """Swings of statements whose value moves between refinement and unrefinement at least ``at_least`` times.

    One row per swing: its ``position`` in time order within the statement, the statement's
    ``oscillation_count`` and the ``swing`` itself, most swings first. Rows stay small
    however often a statement swings.
    """
    ties = ["revision_id", "old_value_label", "new_value_label"]
    kept = features_entity.where("label in ('refinement', 'unrefinement') and is_reverted = 0").select(
        "revision_id", "property_id", "value_id", "property_label", "old_value_label", "new_value_label", "label")
    changes = kept.join(revision.select("revision_id", "entity_id", F.unix_micros("timestamp").alias("us")), "revision_id")
    changes, split = with_chunk(changes, _KEY, "us", split)
    following = adjacent(changes, _KEY, "us", ties + ["label"], {"next_label": (1, "label")}, split)
    swings = following.where("label <> next_label")
    keys = [*_KEY, "property_label"]
    placed = position(swings, keys, "us", ties, "position", split)
    counts = swings.groupBy(*keys).agg(F.count(F.lit(1)).alias("oscillation_count")).where(F.col("oscillation_count") >= at_least)
    right = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "oscillation_count")
    joined = placed.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    step = F.concat("old_value_label", F.lit(arrow), "new_value_label")
    return joined.select(*keys, "oscillation_count", "position", step.alias("swing")).orderBy(
        F.desc("oscillation_count"), *keys, "position")


def quantity_unrefinement(features_quantity: DataFrame) -> DataFrame:
    """How unrefined quantities lose precision. Without a '.', the whole text counts as decimals."""
    old, new = scalar_text(F.col("old_value")), scalar_text(F.col("new_value"))
    rows = features_quantity.where("label = 'unrefinement'").select(
        (F.length(old) - F.instr(old, ".")).alias("decimals"), new.rlike("\\.").alias("pointed"))
    short = F.col("decimals") <= 10
    return rows.agg(
        F.count(F.lit(1)).alias("total_unrefinements"), _total(F.col("decimals") > 10).alias("long_precision_change"),
        _total(short & F.col("pointed")).alias("small_precision_change"), _total(short & ~F.col("pointed")).alias("precision_removal"))


def time_refinement(features_time: DataFrame, revision: DataFrame) -> DataFrame:
    """Which parts lasting time refinements add: month, day or both. The patterns may overlap."""
    rows = features_time.where("label = 'refinement'").where(_LASTING).join(
        revision.select("revision_id"), "revision_id").select(
            scalar_text(F.col("old_value")).alias("o"), scalar_text(F.col("new_value")).alias("n"))
    o, n = F.col("o"), F.col("n")
    year_only = _any(o, YEAR_ALONE)
    has_month, no_day = ~n.rlike(NO_MONTH), n.rlike(NO_DAY)
    return rows.agg(
        F.count(F.lit(1)).alias("total_time_refinements"), _total(year_only & has_month & no_day).alias("only_month_refinements"),
        _total(o.rlike(MONTH_NO_DAY) & ~no_day).alias("only_day_refinements"),
        _total(year_only & has_month & ~no_day).alias("day_month_refinements"))


def year_only_creations(value_change: DataFrame) -> DataFrame:
    n = scalar_text(F.col("new_value"))
    rows = value_change.where("action = 'CREATE' and new_datatype = 'time' and change_target = ''")
    return rows.agg(F.count(F.lit(1)).alias("total_time_values"),
                    _total(_any(n, YEAR_ALONE_FIRST)).alias("year_only"))


def _degrees(d, m, s):
    return to_number(d) + to_number(m) / 60 + to_number(s) / 3600


def latitude_conversions(features_globecoordinate: DataFrame, revision: DataFrame) -> DataFrame:
    """Latitude refinements whose comment holds the same coordinate in degrees, minutes, seconds."""
    kept = features_globecoordinate.where("label_latitude = 'refinement'").select("revision_id", "latitude_new")
    rows = kept.join(revision.select("revision_id", "comment"), "revision_id")
    d, m, s = (F.regexp_extract("comment", DMS, i) for i in (1, 2, 3))
    near = F.abs(_degrees(d, m, s) - F.abs(to_number(F.col("latitude_new")))) < 0.0001
    return rows.agg(F.count(F.lit(1)).alias("total_refinements"), _total(near).alias("dms_conversion"))


def longitude_conversions(features_globecoordinate: DataFrame, revision: DataFrame) -> DataFrame:
    """The same for longitudes, on the second coordinate of a comment, per distinct (value, longitude, comment).

    Equal rows pool their coordinates, so a comment with one coordinate that occurs twice
    has a second one: itself. The comment being part of the key, a count is all that is needed.
    """
    kept = features_globecoordinate.where("label_longitude = 'refinement'").select("revision_id", "new_value", "longitude_new")
    rows = kept.join(revision.select("revision_id", "comment"), "revision_id").where(F.col("comment").rlike(DMS))
    groups = rows.groupBy("new_value", "longitude_new", "comment").agg(F.count(F.lit(1)).alias("n"))
    found = groups.select("longitude_new", "n", *[F.regexp_extract_all("comment", F.lit(DMS), i).alias(f"g{i}") for i in (1, 2, 3)])
    here = F.size("g1")
    at = F.when(here >= 2, 2).otherwise(1)
    second = _degrees(*[F.element_at(F.col(f"g{i}"), at) for i in (1, 2, 3)])
    near = F.abs(second - F.abs(to_number(F.col("longitude_new")))) < 0.0001
    return found.where(here * F.col("n") >= 2).agg(F.count(F.lit(1)).alias("all_refinements"), _total(near).alias("num_dms_matches"))


def text_refinement_count(features_text: DataFrame) -> DataFrame:
    return features_text.where("label = 'refinement'").agg(F.count(F.lit(1)).alias("count"))


def text_refinements_by_property(features_text: DataFrame) -> DataFrame:
    return features_text.where("label = 'refinement'").groupBy("property_id", "property_label").agg(
        F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "property_id", "property_label")


def entities_with_text_changes(value_change: DataFrame, properties=(-1, -2)) -> DataFrame:
    """Distinct entities whose label (-1) or description (-2) changed."""
    return value_change.where(F.col("property_id").isin(list(properties))).groupBy("property_id", "property_label").agg(
        F.count_distinct("entity_id").alias("entities"))


def unrefinement_reverters(features_entity: DataFrame, revision: DataFrame) -> DataFrame:
    """User types of those who revert entity unrefinements: distinct reverting revisions."""
    ids = features_entity.where("is_reverted = 1 and label = 'unrefinement'").select(
        F.col("revision_id_reversion").alias("revision_id")).distinct()
    return ids.join(revision.select("revision_id", "user_type"), "revision_id").groupBy("user_type").agg(
        F.count(F.lit(1)).alias("reverting_revisions"))


def unrefinement_authors(features_entity: DataFrame, revision: DataFrame) -> DataFrame:
    """User types of those whose entity unrefinements were reverted."""
    counted = features_entity.where("label = 'unrefinement' and is_reverted = 1").groupBy("revision_id").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.join(revision.select("revision_id", "user_type"), "revision_id").groupBy("user_type").agg(
        F.sum("n").alias("count"))


def undo_comments(features_time: DataFrame, revision: DataFrame) -> DataFrame:
    """Reverted time unrefinements, and those whose reverting comment says undo, reverted or restore."""
    counted = features_time.where("label = 'unrefinement' and is_reverted = 1").groupBy(
        F.col("revision_id_reversion").alias("revision_id")).agg(F.count(F.lit(1)).alias("n"))
    said = F.col("comment").ilike("%undo%") | F.col("comment").ilike("%reverted%") | F.col("comment").ilike("%restore%")
    spoken = revision.where(said).select("revision_id", F.lit(1).alias("said"))
    return counted.join(spoken, "revision_id", "left").agg(
        F.coalesce(F.sum(F.when(F.col("said") == 1, F.col("n"))), F.lit(0)).alias("reverted_with_undo_comment"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("reverted_unrefinements"))


def _soft(value_change: DataFrame, label: str) -> DataFrame:
    return value_change.where(F.col("label") == label).where(_LASTING)


def _created(qualifier_change: DataFrame, qualifier: int) -> DataFrame:
    return qualifier_change.where((F.col("qual_property_id") == qualifier) & (F.col("action") == "CREATE"))


def soft_changes_with_reason(value_change: DataFrame, qualifier_change: DataFrame, label: str, qualifier: int) -> DataFrame:
    """Lasting soft changes of a statement that (ever) got a reason qualifier."""
    reasons = _created(qualifier_change, qualifier).select(*_KEY).distinct()
    return _soft_counts(value_change, label).join(reasons, _KEY, "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))


def _soft_counts(value_change: DataFrame, label: str) -> DataFrame:
    return _soft(value_change, label).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))


def latest_reasons(value_change: DataFrame, qualifier_change: DataFrame, label: str = "soft_insertion", qualifier: int = 7452) -> DataFrame:
    """Soft changes per latest reason of their statement."""
    latest = latest_per_key(_created(qualifier_change, qualifier), _KEY, ["timestamp", "revision_id"], ["new_value"])
    return _soft_counts(value_change, label).join(latest, _KEY).groupBy("new_value").agg(
        F.sum("n").alias("count")).orderBy(F.desc("count"), "new_value")


def latest_start_insertions(value_change: DataFrame, qualifier_change: DataFrame, label: str = "soft_insertion",
                            qualifier: int = 580) -> DataFrame:
    """Soft insertions of a value no other value of the property starts later than.

    Per (entity, property) the two greatest starts of different values are enough: a value
    holds the latest start if its own greatest start is not below the greatest of the
    others. Both come from aggregates, so nothing is compared pairwise.
    """
    starts = _created(qualifier_change, qualifier).select(*_KEY, scalar_text(F.col("new_value")).alias("s")).groupBy(*_KEY).agg(
        F.max("s").alias("start"), F.max(F.col("s").isNull()).alias("open"))
    group = ["entity_id", "property_id"]
    top = starts.groupBy(*group).agg(F.max("start").alias("first"))
    # values at the group's greatest start hold it, and so does a start without a comparable text
    holders = starts.join(top, group).where("open or start = first").select(*_KEY)
    return _soft_counts(value_change, label).join(holders, _KEY).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))


def deletion_reasons(value_change: DataFrame, qualifier_change: DataFrame, label: str = "soft_deletion", qualifier: int = 2241) -> DataFrame:
    """Distinct soft-deleted statements per reason, by how many (qualifier, change) pairs there are.

    Both sides are counted per statement before the join, so pairs are multiplied, not built.
    """
    given = _created(qualifier_change, qualifier).groupBy(*_KEY, "new_value").agg(F.count(F.lit(1)).alias("q"))
    joined = given.join(_soft_counts(value_change, label), _KEY)
    return joined.groupBy("new_value").agg(
        F.count(F.lit(1)).alias("statements"), F.sum(F.col("q") * F.col("n")).alias("_pairs")
    ).orderBy(F.desc("_pairs"), "new_value").drop("_pairs")


def dead_link_changes(features_entity: DataFrame, revision: DataFrame) -> DataFrame:
    """Link changes to an entity that had been redirected to the old value, the redirect still standing."""
    last = no_later_row(revision.select("entity_id", "timestamp", "redirect", "q_id_redirect"), ["entity_id"], "timestamp")
    redirects = last.where("redirect").select(
        "entity_id", "q_id_redirect", F.col("timestamp").alias("redirected_at"),
        F.concat(F.lit("Q"), F.col("entity_id").cast("string")).alias("_new"),
        F.concat(F.lit("Q"), F.col("q_id_redirect").cast("string")).alias("_old"))
    changes = features_entity.where(
        "label = 'link_change' and is_reverted = 0 and new_value_label <> '' and old_value_label <> ''"
    ).withColumn("_new", scalar_text(F.col("new_value"))).withColumn("_old", scalar_text(F.col("old_value")))
    timed = changes.join(redirects, ["_new", "_old"]).join(
        revision.select("revision_id", F.col("timestamp").alias("changed_at")), "revision_id")
    return timed.where("changed_at > redirected_at").select(
        "revision_id", "property_id", "property_label", "old_value", "new_value", "old_value_label", "new_value_label",
        "label", "entity_id", "q_id_redirect")


def unsourced_date_refinements(features_time: DataFrame, revision: DataFrame, property_id: int = 569) -> DataFrame:
    """Reverted date refinements of a property, and refinements whose reverting comment names missing sources."""
    dates = features_time.where((F.col("property_id") == property_id) & (F.col("label") == "refinement"))
    total = dates.where("is_reverted = 1").agg(F.count(F.lit(1)).alias("total_refinements_reverted"))
    blamed = revision.where(F.col("comment").ilike("%non-WP source(s)%")).select(F.col("revision_id").alias("revision_id_reversion"))
    with_comment = dates.join(blamed, "revision_id_reversion", "left_semi").join(
        revision.select("revision_id"), "revision_id").agg(F.count(F.lit(1)).alias("n"))
    return total.select("*", with_comment.scalar().alias("reverted_with_comment"))


def value_formats(features_text: DataFrame, revision: DataFrame, property_id: int = 2035) -> DataFrame:
    """Latest value per entity of one property, counted by trailing slash and user, with the share of all."""
    kept = features_text.where((F.col("property_id") == property_id) & (F.col("is_reverted") == 0)).select(
        "revision_id", "value_id", scalar_text(F.col("new_value")).alias("v"))
    rows = kept.join(revision.select("revision_id", "entity_id", "timestamp", "user_type", "username"), "revision_id")
    latest = latest_per_key(rows, ["entity_id"], ["timestamp", "revision_id", "value_id", "v"], ["v", "user_type", "username"])
    shape = F.when(F.col("v").endswith("/"), "with slash").otherwise("without slash")
    # the total is taken from the grouped rows, which are made once
    shared_dir(latest.sparkSession)
    groups = latest.groupBy(shape.alias("format"), "user_type", "username").agg(F.count(F.lit(1)).alias("total")).checkpoint()
    whole = groups.agg(F.sum("total")).scalar()
    return groups.select("*", F.round(F.lit(100.0) * F.col("total") / whole, 2).cast("double").alias("pct"))


def url_formats(pages: DataFrame) -> DataFrame:
    """Trailing-slash classes of page addresses with their share."""
    shape = F.when(F.split_part("url", F.lit("?"), F.lit(1)).endswith("/"), "with slash").otherwise("without slash")
    groups = pages.groupBy(shape.alias("format")).agg(F.count(F.lit(1)).alias("total"))
    share = F.lit(100.0) * F.col("total") / F.sum("total").over(Window.partitionBy())
    return groups.select("*", F.round(share, 2).alias("pct"))
