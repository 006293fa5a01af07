"""The corpus queries by name: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of tokenizer files is a parameter; by default it is that of the installed package.
TOKENIZERS: str | None = None


def tokenizer_file(name: str) -> bytes:
    """The bytes of a vocabulary file, read on the driver; executors get them by broadcast."""
    if TOKENIZERS:
        path = f"{TOKENIZERS}/{name}"
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as file:
        return file.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import warc

    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import mixing

    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import dartminhash

    return dartminhash.classes(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import langid

    return langid.languages_of(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import quality

    return quality.quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import tokencount

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import sstable

    return sstable.shards_of(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import outliers

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return outliers.judge(table(spark, sf_dir, "documents")).select(*columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import decontam

    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_warc, op3_mixing, op4_near_duplicates, op5_language, op6_quality, op7_token_counts, op8_token_shards, op9_quality_rules, op10_decontamination, pipeline)}


def oracle_sql() -> dict[str, str]:
    from tallyweave.llm import sql

    return dict(sql.SQL)
