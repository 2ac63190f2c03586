"""Classify rows as they arrive, once per version; a changed row replaces its old result."""

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from topicweir.operators.classify import cascade_classify
from topicweir.sources.dictionary import KeywordDictionary

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    """Per path the size and time last seen; lets a row through only when they are new.

    Of several rows of one path in a batch the one with the latest time counts, of equal times the
    longest. A row older than what was seen is dropped, so late files never bring an old result back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("length", LongType()), StructField("micros", LongType())])
        self.seen = handle.getValueState("version", kind)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        latest = None
        for row in rows:
            if latest is None or (row["_micros"], row.length) > (latest["_micros"], latest.length):
                latest = row
        known = self.seen.get() if self.seen.exists() else None
        if latest is not None:
            version = (latest.length, latest["_micros"])
            if known is None or (version[1] >= known[1] and version != tuple(known)):
                self.seen.update(version)
                yield Row(**latest.asDict(), changed=known is not None)

    def close(self) -> None:
        pass


def changed_rows(stream: DataFrame) -> DataFrame:
    """Rows of a stream (path, length, modificationTime and others) that are new or changed, with `changed`.

    Rows without path, size or time can't be told apart from older ones and are left out. The state
    is one size and time per path, kept in RocksDB by key, so it may be larger than memory.
    """
    known = stream.filter("path IS NOT NULL AND length IS NOT NULL AND modificationTime IS NOT NULL")
    known = known.withColumn("_micros", F.unix_micros("modificationTime"))
    kind = StructType([*known.schema.fields, StructField("changed", BooleanType())])
    return known.groupBy("path").transformWithState(Versions(), kind, "Append", "None").drop("_micros")


def classify_changes(
    spark: SparkSession,
    stream: DataFrame,
    output: str,
    checkpoint: str,
    dictionary: KeywordDictionary,
    model=None,
    text: str = "text",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score new and changed rows; each batch goes to its own folder under `output`.

    After a restart the checkpoint knows what was seen. A batch that is run again writes the same
    folder again, so no result is there twice. `current_results` reads the last one of each path.
    """
    spark.conf.set(STATE_STORE, ROCKSDB)

    def score(batch: DataFrame, number: int) -> None:
        out = cascade_classify(batch, dictionary, model, text)
        rows = out.select("path", "length", "modificationTime", "subject", "confidence", "changed")
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = changed_rows(stream).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def current_results(spark: SparkSession, output: str, columns: Sequence[str] = ("length", "modificationTime", "subject", "confidence")) -> DataFrame:
    """The result of the last version of every path."""
    rows = spark.read.parquet(output)
    newest = Window.partitionBy("path").orderBy(F.col("batch").desc())
    ranked = rows.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter("_rank = 1").select("path", *columns)
