"""Records that arrive over time, normalized and matched by key with a pool that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyweave.functions import text
from tallyweave.operators import blocking
from tallyweave.sources.delimited import RECORD


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated record files as they come into a folder."""
    return spark.readStream.schema(RECORD).option("sep", "\t").option("header", True).csv(folder)


def block_arriving(stream: DataFrame, pool: DataFrame, output: str, checkpoint: str, names: tuple[str, ...] = blocking.NINE_KEYS, style: str = "indic") -> StreamingQuery:
    """Candidates of arriving records with normalized pool records, written batch by batch until the input is read.

    A batch has its own folder under its number, which is written anew if the batch is run again, so each record's
    candidates are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = blocking.multikey(text.normalize_records(batch, style), pool, names)
        found.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
