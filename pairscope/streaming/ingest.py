"""Incremental ingestion with Structured Streaming: new files of a landing folder are curated as they come.

The batch operators are the reference semantics; these runs give the same tables file by file. Records come in any order, years late
included, so there is no watermark and nothing is dropped as late. The state is one entry for each distinct key or window and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairscope.functions.text import normalize_for_qc, token_count


def read_landing(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """Stream of a folder of Parquet files with a declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def curate(stream: DataFrame, text: str, event_time: str | None = None, key: list[str] | None = None) -> DataFrame:
    """Normalised text and token count; with a key, repeated records come through once, however late.

    ``event_time`` is accepted for callers that name it; it bounds nothing.
    """
    out = stream.withColumn("normalized", normalize_for_qc(F.col(text))).withColumn("word_count", token_count(F.col("normalized")))
    return out.dropDuplicates(key) if key else out


def counts_by_window(stream: DataFrame, event_time: str, group: str, width: str = "7 days") -> DataFrame:
    """Records of each group by tumbling window, late ones too; to be run in mode ``complete``."""
    return stream.groupBy(F.window(event_time, width), group).agg(F.count(F.lit(1)).alias("n_records"))


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a later call goes on from the checkpoint. Mode ``complete`` replaces the target by the whole result."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    return writer.format("parquet").start(target)
