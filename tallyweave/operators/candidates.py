"""Operations on candidate and scored pairs (s1_id, cand_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.blocking import CAP_TOTAL


def union_capped(first: DataFrame, second: DataFrame, total: int = CAP_TOTAL) -> DataFrame:
    """Both sets with each pair once, those of `first` before those of `second`, each in its order, `total` for a record.

    Pairs are dealt by their record, so that they meet and are ranked after one shuffle.
    """
    both = first.select("s1_id", "cand_id", F.lit(0).alias("set"), "rank").unionByName(second.select("s1_id", "cand_id", F.lit(1).alias("set"), "rank")).repartition("s1_id")
    once = both.groupBy("s1_id", "cand_id").agg(F.min(F.struct("set", "rank")).alias("best"))
    order = Window.partitionBy("s1_id").orderBy("best.set", "best.rank", "cand_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= total).select("s1_id", "cand_id", F.col("best.set").alias("from_set"), "rank")


def first_per_record(pairs: DataFrame, n: int, *order) -> DataFrame:
    """The first n candidates of each record in an order; ties go by id."""
    w = Window.partitionBy("s1_id").orderBy(*order, "cand_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rank_filter(scored: DataFrame, threshold: float = 0.70, sure: float = 0.90, near: float = 0.03) -> DataFrame:
    """Of each record and source (S2 or not) the best candidate over the threshold, and the second if it is sure and near the first.

    An option for when precision counts most; equal probabilities go by id.
    """
    is_s2 = F.startswith("cand_id", F.lit("S2"))
    group = Window.partitionBy("s1_id", "is_s2")
    ranked = scored.where(F.col("prob") >= threshold).withColumn("is_s2", is_s2)
    ranked = ranked.withColumn("rank", F.row_number().over(group.orderBy(F.desc("prob"), "cand_id"))).withColumn("top", F.max("prob").over(group))
    return ranked.where((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("prob") >= sure) & (F.col("top") - F.col("prob") < near))).select("s1_id", "cand_id", "prob", "rank")


def at_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("prob") >= threshold)
