"""Append mode as a stream: new statement texts are parsed and merged into the stored bookings batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kontolith.plans.cuts import cut
from kontolith.plans.statements import appended, parse_statements
from kontolith.sources.readers import read_state
from kontolith.sources.sinks import write_state


def statement_stream(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """New statement files of a folder as ``quelle_pdf, ocr_text``."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path).select(F.col("_metadata.file_name").alias("quelle_pdf"), F.col("value").alias("ocr_text"))


def merge_batch(state_path: str):
    """What ``foreachBatch`` runs: the batch's new bookings are added to the state, nothing stored is written again.

    Keys already stored are left out, so a batch that runs twice changes nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        new = cut(appended(read_state(batch.sparkSession, state_path), parse_statements(batch).bookings), "appended")
        if new.limit(1).count():
            write_state(new, state_path, add=True)

    return run


def append_stream(spark: SparkSession, source: str, state_path: str, checkpoint: str) -> StreamingQuery:
    """Merge all files that wait, then stop; run it again for later ones."""
    return statement_stream(spark, source).writeStream.foreachBatch(merge_batch(state_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
