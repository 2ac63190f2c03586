"""Classify decks as they arrive in a folder."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from topicweir.functions.fixed_values import BATCH_SUFFIXES
from topicweir.plans.batch_job import classify_decks
from topicweir.sources.decks import is_deck
from topicweir.sources.dictionary import KeywordDictionary

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def classify_stream(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    dictionary: KeywordDictionary,
    model=None,
    suffixes: Sequence[str] = tuple(BATCH_SUFFIXES),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append one result row per new file to Parquet, each batch in its own folder.

    The file source remembers what it has read, so a file is scored once. A batch that is
    run again after a failure overwrites its own folder.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def score(batch: DataFrame, number: int) -> None:
        rows = classify_decks(batch, dictionary, model, error_as_failed=True)
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")

    decks = files.filter(is_deck(files["path"], suffixes))
    writer = decks.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
