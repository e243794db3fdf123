"""File-by-file arrival of prediction files with last-file-wins.

New files are appended to a log, one folder per micro-batch, so a replayed batch only
rewrites its own folder. The merged view applies the same merge as the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veneer.operators.impact import impact_by_model
from veneer.operators.merge import last_in_file, last_wins
from veneer.sources.readers import EXAMPLE_FILE, file_name, path_below

SCHEMA = "model_name string, pair_id long, correct int"


def prediction_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Rows with their file's path below the folder and their place in it: block of the file, then row of the block."""
    raw = (spark.readStream.schema(SCHEMA).options(header=True, maxFilesPerTrigger=max_files, pathGlobFilter="*.csv")
           .csv(folder).select("model_name", "pair_id", "correct", "_metadata"))
    return (raw.filter(file_name() != EXAMPLE_FILE)
            .select(path_below(folder.rstrip("/") + "/*").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
                    "model_name", "pair_id", "correct"))


def start_ingest(spark: SparkSession, folder: str, log_path: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Drain the files present and stop; run again when more arrive."""
    def append(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("row_no", F.struct("block", F.monotonically_increasing_id().alias("row"))).drop("block")
        last_in_file(numbered).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return (prediction_stream(spark, folder, max_files).writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def merged_view(spark: SparkSession, log_path: str) -> DataFrame:
    return last_wins(spark.read.parquet(log_path).drop("batch"))


def impact_view(spark: SparkSession, log_path: str, flags: DataFrame) -> DataFrame:
    return impact_by_model(spark.read.parquet(log_path).drop("batch"), flags)
