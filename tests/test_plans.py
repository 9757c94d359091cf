"""Analyses: invariants, hand-made cases, and the shape of physical plans."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.ordered import Split
from palimpsest.operators.reversion import reversion_pairs, reverted_features
from palimpsest.plans import distribution, patterns, reverts
from palimpsest.registry.oracles import ORACLES
from palimpsest.registry.queries import QUERIES, features
from palimpsest.sources.derived import CHAIN_SQL, build_value_change


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


def test_ages_are_computed_once_a_pair_of_dates(spark):
    """Joined rows are counted by their dates before any age is computed."""
    plan = QUERIES["W_AGE_parts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [o_orderdate") == 1 and plan.index("Aggregate [o_orderdate") < plan.index("Join")


def test_overall_counts_are_the_sum_over_user_types(log):
    per_user = distribution.distribution_per_user_type(features(log), _full_revision(log))
    summed = per_user.groupBy(F.col("datatype").alias("source"), "label").agg(F.sum("total").alias("total"))
    whole = distribution.change_type_distribution(features(log), log.value_change, log.qualifier_change, log.reference_change)
    whole = whole.where(F.col("source").isin("entity", "text", "time", "globecoordinate_latitude", "globecoordinate_longitude", "quantity"))
    assert rows(summed, "source", "label", "total") == rows(whole, "source", "label", "total")


def _full_revision(log):
    """A revision for every id the feature tables mention."""
    ids = None
    for df in features(log).values():
        part = df.select(F.col("revision_id").cast("bigint").alias("revision_id"))
        ids = part if ids is None else ids.unionByName(part)
    return ids.distinct().withColumn("user_type", F.when(F.col("revision_id") % 3 == 0, "bot").otherwise("human"))


def test_totals_and_shares(log):
    whole = distribution.change_type_distribution(features(log), log.value_change, log.qualifier_change, log.reference_change)
    assert whole.where("total <> count_reverted + count_non_reverted").count() == 0
    shares = distribution.share_by_user_type(distribution.distribution_per_user_type(features(log), log.revision))
    assert shares.groupBy("datatype", "label").agg(F.sum("pct").alias("s")).where("abs(s - 100) > 1e-9").count() == 0


def test_dense_grid_has_every_cell(log):
    overtime = distribution.change_types_overtime(features(log), log.revision)
    labels = overtime.select("individual_label").distinct().count()
    assert distribution.dense_years(overtime, per_datatype=False).count() == labels * 14


def test_empty_log_reports_zero_rules(log):
    got = distribution.value_change_rules(log.value_change.where("false"))
    assert got.count() == 5 and got.where("count_reverted + count_non_reverted > 0").count() == 0


def test_sums_over_nothing_are_null(log):
    assert patterns.quantity_unrefinement(log.features_quantity.where("false")).first()["precision_removal"] is None


def test_derived_log_does_not_depend_on_cutting(spark, log, monkeypatch):
    import palimpsest.sources.derived as derived

    whole = build_value_change(log._view(CHAIN_SQL))
    real = derived.with_chunk
    monkeypatch.setattr(derived, "with_chunk", lambda df, keys, order: real(df, keys, order, Split(floor=4)))
    cut = build_value_change(log._view(CHAIN_SQL))
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def oscillating(spark, n):
    label = lambda i: "refinement" if i % 2 == 0 else "unrefinement"
    f = spark.createDataFrame([(i, 1, "a", "p", f"o{i}", f"n{i}", label(i), 0) for i in range(n)],
                              "revision_id long, property_id int, value_id string, property_label string, old_value_label string, "
                              "new_value_label string, label string, is_reverted int")
    r = spark.createDataFrame([(i, 5, i) for i in range(n)], "revision_id long, entity_id long, s long")
    return f, r.select("revision_id", "entity_id", F.timestamp_seconds("s").alias("timestamp"))


@pytest.mark.parametrize("split", [None, Split(floor=5)])
@pytest.mark.parametrize("named", [True, False])
def test_oscillations_are_one_row_per_swing_in_order(spark, split, named):
    f, r = oscillating(spark, 30)
    if not named:  # a NULL in the key must not tear a hot statement apart
        f = f.withColumn("property_label", F.lit(None).cast("string"))
    got = patterns.oscillations(f, r, split=split).collect()
    assert [x["position"] for x in got] == list(range(1, 30)) and {x["oscillation_count"] for x in got} == {29}
    assert [x["swing"] for x in got] == [f"o{i} -> n{i}" for i in range(29)]


def test_repeated_comment_pools_its_coordinate(spark):
    f = spark.createDataFrame([(1, "v", "23.5", "refinement"), (2, "v", "23.5", "refinement"), (3, "w", "23.5", "refinement")],
                              "revision_id long, new_value string, longitude_new string, label_longitude string")
    r = spark.createDataFrame([(i, "at 23°30'0\"E") for i in (1, 2, 3)], "revision_id long, comment string")
    assert tuple(patterns.longitude_conversions(f, r).first()) == (1, 1)


def test_start_without_text_counts_as_latest(spark):
    v = spark.createDataFrame([(1, 1, "a", "soft_insertion", 0, 0), (1, 1, "b", "soft_insertion", 0, 0), (1, 1, "c", "soft_insertion", 0, 0)],
                              "entity_id long, property_id int, value_id string, label string, is_reverted int, reversion int")
    q = spark.createDataFrame([(1, 1, "a", '"2001"'), (1, 1, "b", '"2002"'), (1, 1, "c", None)],
                              "entity_id long, property_id int, value_id string, new_value string").select(
                                  "*", F.lit(580).alias("qual_property_id"), F.lit("CREATE").alias("action"))
    assert patterns.latest_start_insertions(v, q).first()["count"] == 2


def test_soft_deletions_can_keep_entities_without_hard_ones(log):
    some = reverts.soft_vs_hard_deletions(log.value_change, log.qualifier_change)
    full = reverts.soft_vs_hard_deletions(log.value_change, log.qualifier_change, full=True)
    assert some.exceptAll(full).count() == 0 and full.count() >= some.count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairwise_plans(log):
    frames = {
        "pairs": reversion_pairs(log.value_change), "reverted": reverted_features(log.edits),
        "links": patterns.dead_link_changes(log.features_entity, log.revision),
        "starts": patterns.latest_start_insertions(log.value_change, log.qualifier_change),
        "reasons": patterns.deletion_reasons(log.value_change, log.qualifier_change),
    }
    for name, df in frames.items():
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_filters_and_columns_reach_the_scan(log):
    text = plan(patterns.year_only_creations(log.value_change))
    assert "PushedFilters: [IsNotNull(action)" in text and "EqualTo(action,CREATE)" in text
    assert "old_hash" not in text


def test_ordered_results_are_in_order(spark, log):
    """Rows come sorted as described, ties by key; the comparison with SQL does not look at order."""
    from palimpsest.registry.queries import QUERIES

    def rows(name):
        return QUERIES[name](spark, log.folder).collect()

    totals = [(r.total, r.label) for r in rows("A4_rollup_by_label")]
    assert totals == sorted(totals) and len(totals) > 3
    years = [(r.year, r.individual_label) for r in rows("A3a_dense_years_overall")]
    assert years == sorted(years) and len(years) > 20
    swings = [(-r.oscillation_count, r.entity_id, r.property_id, r.value_id, r.property_label, r.position) for r in rows("A9_oscillations")]
    assert swings == sorted(swings) and len(swings) > 5
    reasons = [-r["count"] for r in rows("A22_latest_reasons")]
    assert reasons == sorted(reasons)


@pytest.mark.parametrize("name", ["A2_distribution_per_user_type", "A3_change_types_overtime", "A6_reverted_edits_by_month"])
def test_facts_are_shuffled_once(spark, log, name):
    """By revision to meet it; what is shuffled after that are partial counts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        lines = plan(QUERIES[name](spark, log.folder)).splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    partial = [i for i in shuffled if "HashAggregate" in lines[i + 1] and "partial_" in lines[i + 1]]
    rest = [lines[i] for i in shuffled if i not in partial]
    assert len(rest) == 2 and all("hashpartitioning(revision_id" in x for x in rest)
