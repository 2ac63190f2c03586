"""Summaries of a classification run (subject, confidence, seconds)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from topicweir.functions.fixed_values import CONFIDENCE_BINS, FAILED, UNKNOWN
from topicweir.operators.dataset import subject_table
from topicweir.runtime import literal_table, per_class_window, settle


def subject_report(results: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Rows and share per subject in the given order, then unknown and failed; empty ones left out.

    The share is taken over all rows, also those with a subject outside the list.
    """
    counts = results.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_all", F.sum("n").over(per_class_window()))
    order = subject_table(results.sparkSession, [*subjects, UNKNOWN, FAILED], "subject")
    return order.join(counts, "subject").select(
        "subject", "ord", "n", (F.col("n") / F.col("_all") * 100).alias("percent")
    )


def _valid() -> Column:
    return (F.col("confidence") > 0) & ~F.col("subject").isin(UNKNOWN, FAILED)


def confidence_summary(results: DataFrame) -> DataFrame:
    """Mean, greatest and least confidence of rows with a result, and the mean over all known rows."""
    valid = F.when(_valid(), F.col("confidence"))
    return results.agg(
        F.avg(valid).alias("avg_confidence"),
        F.max(valid).alias("max_confidence"),
        F.min(valid).alias("min_confidence"),
        F.avg(F.when(F.col("subject") != UNKNOWN, F.col("confidence"))).alias("avg_known"),
    )


def confidence_histogram(results: DataFrame, with_overflow: bool = True) -> DataFrame:
    """Rows and share per confidence bin, empty bins left out.

    The last named bin ends below 1.0; confidences from 1.0 on, which keyword results reach, have a
    bin of their own. Without `with_overflow` they are in no bin but count in the share's base.
    """
    bins = [*CONFIDENCE_BINS, (1.0, float("inf"), ">=100%")] if with_overflow else CONFIDENCE_BINS
    c = F.col("confidence")
    number = F.lit(None).cast("int")
    for i, (low, high, _) in enumerate(bins):
        number = F.when((c >= low) & (c < high), F.lit(i)).otherwise(number)
    counts = settle(results.select("subject", "confidence"), "subject", "confidence").filter(_valid()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("percent", F.col("n") / F.sum("n").over(per_class_window()) * 100)
    names = literal_table(
        results.sparkSession, [(i, name) for i, (_, _, name) in enumerate(bins)], ["bin", "name"], ["int", "string"]
    )
    return names.join(counts, "bin").select("bin", "name", "n", "percent")


def timing_summary(results: DataFrame) -> DataFrame:
    """Total, mean, least and greatest seconds of timed rows; rows per second; mean over all rows."""
    timed = F.when(F.col("seconds") > 0, F.col("seconds"))
    rows = F.count(F.lit(1))
    return results.agg(
        F.sum(timed).alias("total_seconds"),
        F.avg(timed).alias("avg_seconds"),
        F.min(timed).alias("min_seconds"),
        F.max(timed).alias("max_seconds"),
        rows.alias("files"),
        F.when(rows > 1, rows / F.sum(timed)).alias("files_per_second"),
        F.avg("seconds").alias("avg_seconds_all"),
    )
