"""Calls that arrive as files, appended to a folder of bucketed calls by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varicohort.plans.cohort import Quality, bucketed, classify

INGEST = "chrom string, pos int, ref string, alt string, gt_ac tinyint, sample_id int, filter_pass boolean, dp int, gq int, qual float"


def append_calls(spark: SparkSession, source: str, target: str, checkpoint: str, quality: Quality = Quality()):
    """Read new Parquet files of ingested records under ``source`` and append their calls to ``target``, then stop.

    Each micro-batch goes to a folder of its own, named by its number: a batch that runs again after a failure replaces
    what it wrote before, so that every record is appended once. Records of one variant and sample must not be spread
    over batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        bucketed(classify(batch, quality)).write.mode("overwrite").partitionBy("chrom", "bucket").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(INGEST).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
