"""Batch classification of deck files, from files to result rows."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from topicweir.functions.fixed_values import BATCH_SUFFIXES, FAILED, SLIDES_CLASSIFY
from topicweir.operators.classify import cascade_classify
from topicweir.runtime import settle
from topicweir.sources.decks import deck_texts, scan_decks
from topicweir.sources.dictionary import KeywordDictionary
from topicweir.sources.sinks import read_results, write_results


def classify_decks(
    decks: DataFrame,
    dictionary: KeywordDictionary,
    model=None,
    max_slides: int = SLIDES_CLASSIFY,
    unescape: bool = False,
    error_as_failed: bool = False,
) -> DataFrame:
    """(path, subject, confidence, seconds) for every deck row (path, content).

    Narrow from the archive to the result: no deck meets another one. An unreadable deck has
    an empty text and so an unknown subject; with `error_as_failed` it is reported as failed.
    """
    texts = settle(deck_texts(decks, max_slides, unescape=unescape), "text")
    scored = cascade_classify(texts, dictionary, model)
    if error_as_failed:
        failed = F.col("error").isNotNull()
        scored = scored.withColumns(
            {
                "subject": F.when(failed, F.lit(FAILED)).otherwise(F.col("subject")),
                "confidence": F.when(failed, F.lit(0.0)).otherwise(F.col("confidence")),
                "seconds": F.when(failed, F.lit(0.0)).otherwise(F.col("seconds")),
            }
        )
    return scored.select("path", "subject", "confidence", "seconds")


def batch_classify(
    spark: SparkSession,
    folder: str,
    dictionary: KeywordDictionary,
    output: str | None = None,
    model=None,
    recursive: bool = True,
    keyword_only: bool = False,
) -> DataFrame:
    """Classify the decks of a folder; optionally write the result CSV.

    With an output folder the returned rows are read from it, so the decks are opened once.
    """
    decks = scan_decks(spark, folder, recursive, BATCH_SUFFIXES, content=True)
    results = classify_decks(decks, dictionary, None if keyword_only else model, error_as_failed=True)
    if output is None:
        return results
    write_results(results, output)
    return read_results(spark, output)
