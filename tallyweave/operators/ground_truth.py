"""True matches: one row for each record of the first source, with the ids of its matches joined by commas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.eda import DEVANAGARI, share


def _given(gt: DataFrame) -> DataFrame:
    return gt.where(F.col("matched_entity_ids").isNotNull() & (F.trim("matched_entity_ids") != ""))


def num_matches(gt: DataFrame) -> DataFrame:
    """Ids in each row's list, 0 for a null or blank one."""
    ids = F.col("matched_entity_ids")
    return gt.withColumn("num_matches", F.when(ids.isNull() | (F.trim(ids) == ""), 0).otherwise(F.size(F.split(ids, ","))))


def match_histogram(gt: DataFrame) -> DataFrame:
    """num_matches, n and percent of rows."""
    counts = num_matches(gt).groupBy("num_matches").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("num_matches", "n", share(F.col("n"), F.col("total")).alias("pct"))


def pairs(gt: DataFrame) -> DataFrame:
    """source1_entity_id, target_entity_id; ids aren't trimmed."""
    return _given(gt).select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("target_entity_id"))


def as_lists(true_pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """The comma-joined form of a pair table, a row for each record of s1; ids in ascending order."""
    lists = true_pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("target_entity_id")), ",").alias("matched_entity_ids"))
    return s1.select(F.col("entity_id").alias("source1_entity_id")).join(lists, "source1_entity_id", "left")


def pairs_by_source(true_pairs: DataFrame) -> DataFrame:
    prefix = lambda p: F.count_if(F.startswith("target_entity_id", F.lit(p)))
    return true_pairs.agg(F.count("*").alias("pair_count"), prefix("S2-").alias("s2_pairs"), prefix("S3-").alias("s3_pairs"))


def source_combinations(true_pairs: DataFrame) -> DataFrame:
    """has_s2, has_s3 and the number of first-source records with that combination, from one aggregation."""
    has = lambda p: F.bool_or(F.startswith("target_entity_id", F.lit(p)))
    flags = true_pairs.groupBy("source1_entity_id").agg(has("S2-").alias("has_s2"), has("S3-").alias("has_s3"))
    return flags.groupBy("has_s2", "has_s3").agg(F.count("*").alias("n"))


def pair_details(true_pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Names and addresses of both sides of each pair; the second is null where the pool hasn't got the id.

    Targets are in one source only, so one join with the union of the sources does.
    """
    left = s1.select(F.col("entity_id").alias("source1_entity_id"), F.col("business_name").alias("s1_name"), F.col("business_address").alias("s1_addr"), "country")
    right = pool.select(F.col("entity_id").alias("target_entity_id"), F.col("business_name").alias("target_name"), F.col("business_address").alias("target_addr"))
    return true_pairs.join(left, "source1_entity_id").join(right, "target_entity_id", "left")


def cross_script(details: DataFrame) -> DataFrame:
    """Pairs whose names differ in having Devanagari letters; a pair without a target name is no such pair."""
    deva = lambda c: F.col(c).rlike(DEVANAGARI)
    return details.agg(F.count("*").alias("total_pairs"), F.count_if(deva("s1_name") != deva("target_name")).alias("cross_script_pairs"))
