"""Delimited files in and out, tables in Parquet, and stage results that are found again by their configuration."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])
#: Separators that are told apart by a file's first line.
SEPARATORS = ("\t", ",", ";", "|")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that stands most often in the first line, a comma where none does."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0].value if head else ""
    best = max(SEPARATORS, key=line.count)
    return best if line.count(best) else ","


def read_any(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A delimited file with a header; types are inferred and malformed rows dropped. Without a separator it is sniffed.

    Inference reads the file once more; give `read_records` a schema where it is known.
    """
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("inferSchema", True)
    return reader.option("sep", separator or sniff_separator(spark, path)).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet, ORC or JSON table by its ending, else a delimited file."""
    for ending in ("parquet", "orc", "json"):
        if path.rstrip("/").endswith(f".{ending}"):
            return spark.read.format(ending).load(path)
    return read_any(spark, path)


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A tab-separated file of text columns; malformed rows are dropped, texts such as NA stay texts."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, TRUTH)


def id_lists(s1: DataFrame, pairs: DataFrame, name: str, order: str = "rank") -> DataFrame:
    """source1_entity_id and, under `name`, the ids of its pairs joined by commas in an order; empty for a record without pairs."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, "cand_id"))), lambda x: x["cand_id"])
    lists = pairs.groupBy("s1_id").agg(F.array_join(ids, ",").alias(name))
    joined = s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left")
    return joined.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def matches_table(s1: DataFrame, matches: DataFrame) -> DataFrame:
    ranked = matches if "rank" in matches.columns else matches.withColumn("rank", F.lit(0))
    return id_lists(s1, ranked, "matched_entity_ids")


def candidates_table(s1: DataFrame, candidates: DataFrame) -> DataFrame:
    return id_lists(s1, candidates, "candidate_entity_ids")


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_tsv(df: DataFrame, path: str) -> None:
    """One tab-separated file with a header and line feeds; an empty text is written as nothing.

    Tasks write parts in parallel; the driver passes their bytes on to one file, block by block, which takes its name when it
    is whole.
    """
    spark = df.sparkSession
    folder, draft = f"{path}.{uuid.uuid4().hex}.parts", f"{path}.{uuid.uuid4().hex}.draft"
    df.write.option("sep", "\t").option("header", False).option("lineSep", "\n").option("emptyValue", "").option("nullValue", "").csv(folder)
    (parts, fs), (whole, _) = _path(spark, folder), _path(spark, draft)
    files = sorted(f.getPath().toString() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-"))
    out = fs.create(whole, True)
    try:
        out.write(bytearray(("\t".join(df.columns) + "\n").encode()))
        for name in files:
            part = fs.open(_path(spark, name)[0])
            try:
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    final = _path(spark, path)[0]
    fs.delete(final, True)
    fs.rename(whole, final)
    fs.delete(parts, True)


def write_matches(s1: DataFrame, matches: DataFrame, candidates: DataFrame, folder: str) -> None:
    """matching_results.tsv and candidate_pairs.tsv in a folder; a line for each first-source record, also without pairs."""
    write_tsv(matches_table(s1, matches), f"{folder}/matching_results.tsv")
    write_tsv(candidates_table(s1, candidates), f"{folder}/candidate_pairs.tsv")


def fingerprint(df: DataFrame) -> str:
    """What tells a table's content from any other, whatever the order of its rows: names, types, and sums of row hashes."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    sums = [F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return hashlib.sha256(repr((df.dtypes, tuple(df.agg(F.count("*"), *sums).first()))).encode()).hexdigest()[:16]


class StageStore:
    """Stage results in Parquet under a folder, by stage name and a hash of what they depend on: configuration and input tables.

    A changed configuration or input has another path, so results of an older one are never taken for it.
    """

    def __init__(self, spark: SparkSession, folder: str, config: dict, inputs: tuple[DataFrame, ...] = ()):
        self.spark, self.folder = spark, folder.rstrip("/")
        known = json.dumps(config, sort_keys=True, default=str) + "".join(map(fingerprint, inputs))
        self.key = hashlib.sha256(known.encode()).hexdigest()[:16]

    def path(self, stage: str) -> str:
        return f"{self.folder}/{self.key}/{stage}"

    def exists(self, stage: str) -> bool:
        """Whether a stage was written to its end."""
        path, fs = _path(self.spark, f"{self.path(stage)}/_SUCCESS")
        return fs.exists(path)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows, made and written unless they are there."""
        if not self.exists(name):
            make().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def save_value(self, name: str, value: dict) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(self.path(name))

    def load_value(self, name: str) -> dict:
        return json.loads(self.spark.read.text(self.path(name)).first().value)


def sample_table(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """A made-up table of six columns for trials: ids, categories, prices, quantities, ratings with gaps, minutes."""
    pick = lambda k, low, high: (F.floor(F.rand(seed + k) * (high - low)) + low).cast("int")
    kinds = F.array(*map(F.lit, ("Electronics", "Clothing", "Home", "Books", "Sports")))
    return spark.range(n).select(
        pick(1, 1000, 9999).alias("user_id"),
        F.get(kinds, pick(2, 0, 5)).alias("category"),
        F.round(5 + F.rand(seed + 3) * 495, 2).alias("price"),
        pick(4, 1, 10).alias("quantity"),
        F.when(F.rand(seed + 6) >= 0.05, F.round(1 + F.rand(seed + 5) * 4, 1)).alias("rating"),
        (F.timestamp_seconds(F.lit(1_735_689_600) + F.col("id") * 60)).alias("created_at"),
    )
