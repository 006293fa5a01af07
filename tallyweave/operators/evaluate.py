"""Recall of blocking, macro F0.5, and the choice of a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds that are tried, by version.
GRIDS = {"v2": (0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85), "v3": (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85), "v4": (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)}


def blocking_recall(true_pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """found, total and recall (0 without true pairs) of true pairs (s1_id, cand_id)."""
    hit = true_pairs.select("s1_id", "cand_id").distinct().join(candidates.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    sums = hit.agg(F.count("hit").alias("found"), F.count("*").alias("total"))
    return sums.select("found", "total", (F.col("found").cast("double") / F.greatest("total", F.lit(1))).alias("recall"))


def f_half(hits: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one record: 1 where nothing is true or predicted, 0 where one of the two is empty."""
    p, r = hits.cast("double") / F.nullif(predicted, F.lit(0)), hits.cast("double") / F.nullif(true, F.lit(0))
    return F.when((predicted == 0) & (true == 0), 1.0).when((predicted == 0) | (true == 0) | (hits == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def record_scores(records: DataFrame, predicted: DataFrame, true_pairs: DataFrame) -> DataFrame:
    """s1_id, hits, n_pred, n_true, f05 of each record (entity_id), also of those without pairs."""
    both = predicted.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1)).join(true_pairs.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "full")
    sums = both.groupBy("s1_id").agg(F.count(F.col("p") + F.col("t")).alias("hits"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"))
    every = records.select(F.col("entity_id").alias("s1_id")).join(sums, "s1_id", "left").fillna(0, ["hits", "n_pred", "n_true"])
    return every.withColumn("f05", f_half(F.col("hits"), F.col("n_pred"), F.col("n_true")))


def macro_f_half(records: DataFrame, predicted: DataFrame, true_pairs: DataFrame) -> DataFrame:
    return record_scores(records, predicted, true_pairs).agg(F.count("*").alias("n_records"), F.avg("f05").alias("f05"))


def threshold_scores(records: DataFrame, scored: DataFrame, true_pairs: DataFrame, grid: tuple[float, ...] = GRIDS["v4"]) -> DataFrame:
    """threshold and macro F0.5 of each threshold, in one aggregation over all of them.

    A pair counts under each threshold that its probability reaches; records without pairs come in as counts.
    """
    truth = true_pairs.select("s1_id", "cand_id").distinct()
    n_true = truth.join(records.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").groupBy("s1_id").agg(F.count("*").alias("n_true"))
    marked = scored.select("s1_id", "cand_id", "prob").join(truth.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left")
    reached = marked.select("s1_id", "t", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda x: x <= F.col("prob"))).alias("threshold"))
    counts = reached.groupBy("threshold", "s1_id").agg(F.count("t").alias("hits"), F.count("*").alias("n_pred"))
    # a record with predictions has its score; one without has 1 if nothing is true, else 0
    total = records.agg(F.count("*").alias("n_records"))
    with_true = n_true.agg(F.count("*").alias("n_with_true"))
    scores = counts.join(records.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").join(n_true, "s1_id", "left").fillna(0, ["n_true"])
    sums = scores.groupBy("threshold").agg(F.sum(f_half(F.col("hits"), F.col("n_pred"), F.col("n_true"))).alias("f"), F.count("*").alias("n_pred"), F.count_if(F.col("n_true") > 0).alias("n_pred_true"))
    base = records.sparkSession.createDataFrame([(float(t),) for t in grid], "threshold double")
    joined = base.join(F.broadcast(sums), "threshold", "left").fillna(0, ["f", "n_pred", "n_pred_true"]).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(with_true))
    silent = (F.col("n_records") - F.col("n_with_true")) - (F.col("n_pred") - F.col("n_pred_true"))
    return joined.select("threshold", ((F.col("f") + silent) / F.nullif(F.col("n_records"), F.lit(0))).alias("f05"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """The threshold with the highest score, the lowest of equal ones."""
    return scores.orderBy(F.desc(F.round("f05", 12)), "threshold").limit(1)
