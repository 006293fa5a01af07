import re

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import blocking, candidates, eda, evaluate, features, ground_truth, profile, tfidf, training


def norm(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, name_norm string, addr_norm string, country_norm string").withColumn("core_name", text.core_name(F.col("name_norm")))


def test_profile_of_a_small_table(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1.0), (3, None, 3.0)], "id int, word string, x double")
    out = profile.profile(df)
    by = {c["name"]: c for c in out["column_stats"]}
    assert out["total_rows"] == 3 and by["word"]["missing_count"] == 1 and by["word"]["distinct_count"] == 1
    assert by["word"]["top_categories"] == [{"value": "a", "count": 2, "pct": 66.67}]
    assert by["x"]["numeric_stats"]["median"] == 2.0 and by["x"]["numeric_stats"]["p25"] == 1.5


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, word string")
    assert profile.profile(df)["total_rows"] == 0


def test_approximate_distinct_counts(spark):
    r = profile.missing_distinct(spark.range(1000).withColumn("even", F.col("id") % 2), approximate=True).collect()
    assert {x.column_name: round(x.distinct_count / 100) for x in r} == {"id": 10, "even": 0}


def test_case_classes_leave_caseless_text_out(spark):
    df = spark.createDataFrame([("abc",), ("ABC",), ("Abc",), ("राम",), ("",), (None,)], "business_name string")
    r = eda.case_variation(df).first()
    assert (r.total, r.lower_cnt, r.upper_cnt, r.mixed_cnt) == (4, 1, 1, 1)


def test_truth_lists(spark):
    gt = spark.createDataFrame([("S1-1", "S2-1,S3-2,S3-3"), ("S1-2", None), ("S1-3", "  ")], "source1_entity_id string, matched_entity_ids string")
    assert {r.source1_entity_id: r.num_matches for r in ground_truth.num_matches(gt).collect()} == {"S1-1": 3, "S1-2": 0, "S1-3": 0}
    hist = {r.num_matches: r.n for r in ground_truth.match_histogram(gt).collect()}
    pairs = ground_truth.pairs(gt)
    assert sum(k * n for k, n in hist.items()) == pairs.count() == 3
    r = ground_truth.source_combinations(pairs).collect()
    assert [(x.has_s2, x.has_s3, x.n) for x in r] == [(True, True, 1)]


def test_keys_are_capped_and_heavy_ones_dropped(spark):
    s1 = norm(spark, [("S1-1", "delta power", "1 road", "us"), ("S1-2", "", "", "us")])
    pool = norm(spark, [(f"S2-{k:02d}", "delta power", "1 road", "us") for k in range(30)])
    out = blocking.multikey(s1, pool, ("exact-name",)).collect()
    assert sorted(r.cand_id for r in out) == [f"S2-{k:02d}" for k in range(20)]
    assert blocking.multikey(s1, pool, ("exact-name",), most=29).count() == 0
    assert blocking.multikey(s1, pool, total=5).groupBy("s1_id").count().first()["count"] == 5


def test_cross_country_key_needs_no_country(spark):
    s1, pool = norm(spark, [("S1-1", "delta", "12 road", "us")]), norm(spark, [("S2-1", "delta", "12 road", "fr")])
    assert blocking.multikey(s1, pool, blocking.NINE_KEYS).count() == 0
    assert blocking.multikey(s1, pool, blocking.ELEVEN_KEYS).count() == 1


def test_word_grams_follow_padding(spark):
    df = spark.createDataFrame([("a bcd",)], "t string")
    got = df.select(tfidf.word_grams(F.col("t")).alias("g")).first().g
    assert sorted(got) == sorted([" a", "a ", " a ", " b", "bc", "cd", "d ", " bc", "bcd", "cd ", " bcd", "bcd "])


def test_prioritized_union(spark):
    pair = "s1_id string, cand_id string, rank int"
    a = spark.createDataFrame([("x", "1", 1), ("x", "2", 2)], pair)
    b = spark.createDataFrame([("x", "2", 1), ("x", "3", 2), ("x", "4", 3)], pair)
    out = {r.cand_id: r.rank for r in candidates.union_capped(a, b, 3).collect()}
    assert out == {"1": 1, "2": 2, "3": 3}


def test_rank_filter_keeps_a_sure_second(spark):
    scored = spark.createDataFrame([("x", "S2-1", 0.95), ("x", "S2-2", 0.94), ("x", "S2-3", 0.93), ("x", "S3-1", 0.8), ("x", "S3-2", 0.79), ("y", "S2-1", 0.1)], "s1_id string, cand_id string, prob double")
    assert sorted(r.cand_id for r in candidates.rank_filter(scored).collect()) == ["S2-1", "S2-2", "S3-1"]


def test_features_of_a_pair(spark):
    s1 = norm(spark, [("S1-1", "delta telecommunication incorporated", "9914 pierpont avenue, cleveland, oh", "us")])
    pool = norm(spark, [("S2-1", "delta tetlecommunication incorporated", "914 pierpont avenue, cleveland, oh", "us")])
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string")
    for version, n in (("baseline", 26), ("v2", 34), ("v3", 45), ("v4", 38)):
        assert len(features.FEATURES[version]) == n
        row = features.features(pairs, s1, pool, version, tfidf.token_idf(s1) if version == "v3" else None).first().asDict()
        assert list(row)[2:] == list(features.FEATURES[version])
        assert row["name_jaccard"] == 0.5 and row["addr_jaccard"] == pytest.approx(4 / 6) and row["num_jaccard"] == 0
        if version != "baseline":
            assert row["name_lev"] == pytest.approx(1 - 1 / 37) and row["house_match"] == 0
        if version == "v3":
            assert row["same_street_diff_house"] == 1 and 0 < row["weighted_name_jaccard"] < 1
        if version in ("v3", "v4"):
            assert row["house_mismatch_penalty"] == 1 and row["pin_mismatch_penalty"] == 0


def test_number_sets_of_empty_addresses(spark):
    s1, pool = norm(spark, [("S1-1", "a", "", "us")]), norm(spark, [("S2-1", "a", None, "us"), ("S2-2", "a", "7", "us")])
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], "s1_id string, cand_id string")
    assert {r.cand_id: r.num_jaccard for r in features.native_features(pairs, s1, pool).collect()} == {"S2-1": 1.0, "S2-2": 0.0}


def test_macro_score_cases(spark):
    pair = "s1_id string, cand_id string"
    records = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity_id string")
    predicted = spark.createDataFrame([("b", "1"), ("d", "1")], pair)
    true = spark.createDataFrame([("c", "1"), ("d", "1"), ("d", "2")], pair)
    scores = {r.s1_id: r.f05 for r in evaluate.record_scores(records, predicted, true).collect()}
    assert scores == {"a": 1.0, "b": 0.0, "c": 0.0, "d": pytest.approx(1.25 * 0.5 / 0.75)}


def test_lowest_of_equal_thresholds_wins(spark):
    pair = "s1_id string, cand_id string"
    records = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    scored = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.2)], pair + ", prob double")
    true = spark.createDataFrame([("a", "1")], pair)
    grid = evaluate.threshold_scores(records, scored, true, (0.1, 0.3, 0.5, 0.95))
    assert {r.threshold: r.f05 for r in grid.collect()}[0.95] == 0.5
    assert evaluate.best_threshold(grid).first().threshold == 0.3


def test_training_pairs_take_first_wrong_candidates(spark):
    pair = "s1_id string, cand_id string"
    s1 = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    pool = spark.createDataFrame([(str(k),) for k in range(9)], "entity_id string")
    true = spark.createDataFrame([("a", "0"), ("a", "missing")], pair)
    cands = spark.createDataFrame([(s, str(k), k) for s in "ab" for k in range(9)], pair + ", rank int")
    out = training.training_pairs(true, cands, pool, s1).collect()
    assert sorted((r.s1_id, r.cand_id) for r in out if r.label) == [("a", "0")]
    assert sorted(r.cand_id for r in out if r.s1_id == "a" and not r.label) == [str(k) for k in range(1, 7)]
    assert sum(r.s1_id == "b" for r in out) == 2


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("cast(id as string) AS entity_id")
    one, two = training.sample(df.repartition(7), 50), training.sample(df.coalesce(1), 50)
    assert {r.entity_id for r in one.collect()} == {r.entity_id for r in two.collect()}
    a, b = training.split(df, "entity_id")
    assert a.count() + b.count() == 1000 and 60 < b.count() < 140


def pair_sides(spark):
    names = [("S1-1", "blue river mills", "12 oak road 4401", "x"), ("S2-1", "blue river mill", "12 oak rd 4401", "x"), ("S3-1", "", None, "x")]
    rows = spark.createDataFrame(names, "entity_id string, name_norm string, addr_norm string, country_norm string").withColumn("core_name", F.col("name_norm"))
    return spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1")], "s1_id string, cand_id string"), rows


@pytest.mark.parametrize("version", features.FEATURES)
def test_a_pair_carries_texts_alone(spark, version):
    """What is sent with each pair has no arrays; words and grams are made where its sides meet."""
    pairs, rows = pair_sides(spark)
    plan = features.paired(pairs, rows, rows, version)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "name2" in plan.left().schema().simpleString() and "array" not in plan.left().schema().simpleString()


def test_sounds_of_a_first_side_come_by_record(spark):
    """A pair is coded for its second side alone, and its second id is sent once."""
    pairs, rows = pair_sides(spark)
    made = features.features(pairs, rows, rows, "v2")
    assert {r.cand_id: (r.name_phon_exact, r.name_phon_jaccard, r.is_s3) for r in made.collect()} == {"S2-1": (0.0, 0.5, 0.0), "S3-1": (0.0, 0.0, 1.0)}
    plan = made._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "sound1" in plan.right().schema().simpleString() and "entity_id2" not in plan.left().schema().simpleString()


@pytest.mark.parametrize("version", features.FEATURES)
def test_a_pair_makes_one_trip_to_python(spark, version):
    """Each trip is another worker beside the executor's heap."""
    pairs, rows = pair_sides(spark)
    plan = features.features(pairs, rows, rows, version)._jdf.queryExecution().optimizedPlan()
    trips = 0
    while plan.nodeName() != "Join":
        trips += plan.nodeName() == "ArrowEvalPython"
        plan = plan.children().apply(0)
    assert trips == 1


def test_word_weights_come_by_record(spark):
    """No word of a pair is a row of its own."""
    pairs, rows = pair_sides(spark)
    idf = spark.createDataFrame([("blue", 2.0), ("mill", 3.0), ("mills", 4.0)], "token string, idf double")
    made = features.features(pairs, rows, rows, "v3", idf)
    got = {r.cand_id: (r.weighted_name_jaccard, r.weighted_addr_jaccard) for r in made.collect()}
    assert got == {"S2-1": (pytest.approx(3 / 10), pytest.approx(3 / 5)), "S3-1": (0.0, 0.0)}
    assert not re.search(r"hashpartitioning\(s1_id#\d+, cand_id", made._jdf.queryExecution().executedPlan().toString())
