"""The sentence-local operators on streams. Nothing in them needs state, so batch and stream share one plan;
deduplication keeps its keys only within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanloom.functions import text as T
from vanloom.operators import models


def sentence_stream(spark: SparkSession, path: str, schema: str = "sentence string, posted_at timestamp") -> DataFrame:
    """New JSON files of a folder as a stream of sentences."""
    return spark.readStream.schema(schema).json(path)


def annotate(sentences: DataFrame, text: str = "sentence") -> DataFrame:
    """Cleaned sentence, status, entities, triggers and events; the same on a batch and on a stream."""
    return models.pipeline(sentences.withColumn(text, T.clean_text(F.col(text))), text)


def first_within(sentences: DataFrame, at: str, delay: str = "1 hour", text: str = "sentence") -> DataFrame:
    """Drops sentences whose normalised key was seen within the watermark."""
    keyed = sentences.withColumn("_k", F.md5(T.norm_key(F.col(text)))).withWatermark(at, delay)
    return keyed.dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def trigger_counts(annotated: DataFrame, at: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Triggers by type and window of event time; late rows beyond the delay are left out."""
    rows = annotated.withWatermark(at, delay).select(at, F.explode("triggers").alias("t"))
    return rows.groupBy(F.window(at, window).alias("w"), F.col("t.label").alias("event_type")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
