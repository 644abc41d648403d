"""Documents that arrive as files, tokenized and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_documents(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def token_counts(documents: DataFrame, key: str, text: str, stamp: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tokens and documents per window of ``stamp``; later rows than ``delay`` are left out, as the watermark says."""
    sized = documents.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay).withColumn("_n", F.regexp_count(F.col(text), F.lit(r"[^ \n\t\f]+")))
    return sized.groupBy(F.window(stamp, window).alias("w")).agg(F.count(F.lit(1)).alias("documents"), F.sum("_n").alias("tokens")).select(F.col("w.start").alias("window_start"), "documents", "tokens")


def upsert_latest(batch: DataFrame, key: str, stamp: str) -> DataFrame:
    """The latest row of each key in a micro-batch, for use in ``foreachBatch``."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.coalesce(stamp, F.lit("1970-01-01").cast("timestamp"))).alias("r")).select(key, "r.*")
