"""Samples, training pairs and the matcher.

Samples go by a hash of the id, so that they don't depend on how rows are dealt out and a rerun takes the same ones.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def _bucket(column: str, parts: int, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(parts))


def split(rows: DataFrame, column: str = "source1_entity_id", validation: float = 0.1, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by id."""
    held = _bucket(column, 10_000, seed) < round(10_000 * validation)
    return rows.where(~held), rows.where(held)


def sample(rows: DataFrame, n: int, column: str = "entity_id", seed: int = SEED) -> DataFrame:
    """n rows, the first in the order of a hash."""
    return rows.orderBy(F.xxhash64(column, F.lit(seed)), column).limit(n)


def first_records(rows: DataFrame, n: int = 10_000) -> DataFrame:
    """The first n records by id, as validation takes them."""
    return rows.orderBy("entity_id").limit(n)


def select_pool(records: DataFrame, wanted: DataFrame | None, rate: float = 0.25, multiple: int | None = None, most: int | None = None, seed: int = SEED) -> DataFrame:
    """The wanted records (entity_id) and a share `rate` of the others, at most `multiple` times the wanted and `most`.

    Without `wanted`, all records. The others that stay are the first in the order of a hash.
    """
    if wanted is None:
        return records
    ids = wanted.select("entity_id").distinct()
    matched = records.join(ids, "entity_id", "left_semi").withColumn("is_wanted", F.lit(True))
    others = records.join(ids, "entity_id", "left_anti").where(_bucket("entity_id", 1_000_000, seed) < round(1_000_000 * rate))
    limits = ([multiple * max(matched.count(), 1)] if multiple is not None else []) + ([most] if most is not None else [])
    if limits:
        others = sample(others, min(limits), seed=seed + 1)
    return matched.unionByName(others.withColumn("is_wanted", F.lit(False)))


def training_pairs(true_pairs: DataFrame, candidates: DataFrame, pool: DataFrame, s1: DataFrame, ratio: int = 3) -> DataFrame:
    """s1_id, cand_id, label: true pairs that are in the pool, candidates or not; and of each record's other candidates the
    first, `ratio` for each true match and 2 at least. True matches count also where the pool hasn't got them."""
    truth = true_pairs.select("s1_id", "cand_id").distinct().join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    positive = truth.join(pool.select(F.col("entity_id").alias("cand_id")).distinct(), "cand_id", "left_semi").select("s1_id", "cand_id", F.lit(1).alias("label"))
    n_true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    wrong = candidates.join(truth, ["s1_id", "cand_id"], "left_anti")
    order = Window.partitionBy("s1_id").orderBy("rank", "cand_id")
    wrong = wrong.withColumn("nth", F.row_number().over(order)).join(n_true, "s1_id", "left")
    kept = wrong.where(F.col("nth") <= F.greatest(ratio * F.coalesce("n_true", F.lit(0)), F.lit(2)))
    return positive.unionByName(kept.select("s1_id", "cand_id", F.lit(0).alias("label")))


def train(rows: DataFrame, columns: list[str], trees: int = 60, depth: int = 6, rate: float = 0.1, seed: int = SEED) -> GBTClassificationModel:
    """Gradient-boosted trees; true pairs weigh as much as all others together."""
    n = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, n.n / max(n.p, 1)).otherwise(1.0))
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(weighted)
    booster = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return booster.fit(data.select("features", "label", "weight"))


def importance(model: GBTClassificationModel, columns: list[str], n: int = 15) -> list[tuple[str, float]]:
    """The most important features."""
    return sorted(zip(columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def score(rows: DataFrame, model: GBTClassificationModel, columns: list[str]) -> DataFrame:
    """s1_id, cand_id and prob of each pair."""
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    return model.transform(data).select("s1_id", "cand_id", vector_to_array("probability")[1].alias("prob"))
