"""Record linkage from raw records to matches: normalize, block, compare, train or score, choose, write."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import blocking, candidates, evaluate, features, ground_truth, tfidf, training
from tallyweave.plans.runlog import RunLog
from tallyweave.sources.delimited import StageStore, write_matches


@dataclass(frozen=True)
class Settings:
    """What a run depends on; stage results are kept under a hash of it."""

    version: str = "v4"
    style: str = "indic"
    keys: tuple[str, ...] = blocking.NINE_KEYS
    postal: str = r"\d{4,}"
    cap_total: int = blocking.CAP_TOTAL
    top_k: int = tfidf.TOP_K
    min_similarity: float = tfidf.MIN_SIMILARITY
    max_df: float = tfidf.MAX_DF
    fit_sample: int | None = None
    whole_text_grams: bool = False
    sample_size: int = 200_000
    negative_rate: float = 0.25
    negative_multiple: int = 3
    trees: int = 400
    depth: int = 6
    rate: float = 0.1
    grid: tuple[float, ...] = evaluate.GRIDS["v4"]
    rank_filter: bool = False


#: The four generations of the pipeline. Their trees, depths and learning rates.
SETTINGS = {
    "baseline": Settings("baseline", "baseline", keys=(), cap_total=20, top_k=20, fit_sample=100_000, trees=300),
    "v2": Settings("v2", grid=evaluate.GRIDS["v2"]),
    "v3": Settings("v3", "french", blocking.ELEVEN_KEYS, r"\b\d{5,6}\b", whole_text_grams=True, trees=500, rate=0.08, grid=evaluate.GRIDS["v3"]),
    "v4": Settings("v4"),
}


def _for_grams(records: DataFrame) -> DataFrame:
    return records.select("entity_id", F.col("country_norm").alias("country"), text.blocking_text(F.col("name_norm"), F.col("addr_norm")).alias("text"))


def block(s1: DataFrame, pool: DataFrame, s: Settings = SETTINGS["v4"]) -> DataFrame:
    """Candidates of normalized records by TF-IDF and by keys, TF-IDF first, at most cap_total for a record."""
    options = {"fit_sample": s.fit_sample, "max_df": s.max_df} | ({"max_features": None} if s.whole_text_grams else {})
    near = tfidf.similar(_for_grams(s1), _for_grams(pool), s.top_k, s.min_similarity, not s.whole_text_grams, tfidf.grams if s.whole_text_grams else tfidf.word_grams, **options)
    if not s.keys:
        return near
    return candidates.union_capped(near, blocking.multikey(s1, pool, s.keys, s.cap_total, postal=s.postal), s.cap_total)


def block_quick(s1: DataFrame, pool: DataFrame, cap: int = 10) -> DataFrame:
    """The quick way without TF-IDF: equal names and equal sorted words."""
    return blocking.exact(s1, pool, cap)


def _pairs(gt: DataFrame) -> DataFrame:
    return ground_truth.pairs(gt).select(F.col("source1_entity_id").alias("s1_id"), F.col("target_entity_id").alias("cand_id"))


def compare(pairs: DataFrame, s1: DataFrame, pool: DataFrame, s: Settings, idf: DataFrame | None = None) -> DataFrame:
    return features.features(pairs, s1, pool, s.version, idf, s.postal)


def run_training(spark: SparkSession, s1: DataFrame, pool: DataFrame, gt: DataFrame, folder: str, s: Settings = SETTINGS["v4"], validation_records: int = 10_000) -> dict:
    """Train on raw records and true matches, choose a threshold on held-out records; returns what was measured.

    Stages are kept under `folder` and found again by a later run with the same settings and the same tables: normalized
    records, candidates, features, scores. The model and the threshold are kept under the settings for `run_inference`.
    """
    log = RunLog(folder)
    store = StageStore(spark, folder, asdict(s) | {"validation_records": validation_records}, (s1, pool, gt))
    trained = StageStore(spark, folder, asdict(s))
    gt_train, gt_held = training.split(gt)
    raw_train = training.sample(s1.join(gt_train.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_semi"), s.sample_size)
    train = store.stage("train_s1", lambda: text.normalize_records(raw_train, s.style))
    true = _pairs(gt_train).join(train.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    wanted = true.select(F.col("cand_id").alias("entity_id"))
    train_pool = store.stage("train_pool", lambda: text.normalize_records(training.select_pool(pool, wanted, s.negative_rate, s.negative_multiple).drop("is_wanted"), s.style))
    found = store.stage("train_candidates", lambda: block(train, train_pool, s).select("s1_id", "cand_id", "rank"))
    recall = evaluate.blocking_recall(true, found).first()
    log.say(f"blocking recall {recall.recall}")
    log.memory(spark, "after blocking")
    idf = store.stage("idf", lambda: tfidf.token_idf(train)) if s.version == "v3" else None
    columns = list(features.FEATURES[s.version])
    rows = store.stage("train_features", lambda: compare(training.training_pairs(true, found, train_pool, train, 3), train, train_pool, s, idf))
    model = training.train(rows, columns, s.trees, s.depth, s.rate)
    model.write().overwrite().save(trained.path("model"))
    log.memory(spark, "after training")
    held = store.stage("validation_s1", lambda: text.normalize_records(training.first_records(s1.join(gt_held.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_semi"), validation_records), s.style))
    held_true = _pairs(gt_held).join(held.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    held_pool = store.stage("validation_pool", lambda: text.normalize_records(training.select_pool(pool, held_true.select(F.col("cand_id").alias("entity_id")), s.negative_rate, most=100_000).drop("is_wanted"), s.style))
    held_found = store.stage("validation_candidates", lambda: block(held, held_pool, s).select("s1_id", "cand_id", "rank"))
    scored = store.stage("validation_scores", lambda: training.score(compare(held_found, held, held_pool, s, idf), model, columns))
    best = evaluate.best_threshold(evaluate.threshold_scores(held, scored, held_true, s.grid)).first()
    out = {"threshold": best.threshold, "f05": best.f05, "recall": recall.recall, "importance": training.importance(model, columns)}
    trained.save_value("threshold", out | {"trained_on": store.key})
    log.say(f"threshold {best.threshold}, F0.5 {best.f05}")
    return out


def run_inference(spark: SparkSession, s1: DataFrame, pool: DataFrame, folder: str, output: str, s: Settings = SETTINGS["v4"], quick: bool = False) -> DataFrame:
    """Match raw records with a model trained under `folder`; writes matches and candidates, returns scored matches."""
    log = RunLog(folder)
    trained = StageStore(spark, folder, asdict(s))
    known = trained.load_value("threshold")
    threshold, store = known["threshold"], StageStore(spark, folder, asdict(s) | {"trained_on": known["trained_on"]}, (s1, pool))
    model = GBTClassificationModel.load(trained.path("model"))
    idf = spark.read.parquet(f"{trained.folder}/{known['trained_on']}/idf") if s.version == "v3" else None
    kept = "quick" if quick else "test"
    left = store.stage(f"{kept}_s1", lambda: text.normalize_records(s1, s.style))
    right = store.stage(f"{kept}_pool", lambda: text.normalize_records(pool, s.style))
    found = store.stage(f"{kept}_candidates", lambda: (block_quick(left, right) if quick else block(left, right, s)).select("s1_id", "cand_id", "rank"))
    scored = store.stage(f"{kept}_scores", lambda: training.score(compare(found, left, right, s, idf), model, list(features.FEATURES[s.version])))
    matches = candidates.rank_filter(scored, threshold) if s.rank_filter else candidates.at_threshold(scored, threshold)
    log.memory(spark, "after scoring")
    write_matches(left, matches.drop("rank").join(found, ["s1_id", "cand_id"]), found, output)
    return matches
