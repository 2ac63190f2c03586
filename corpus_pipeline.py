"""The corpus pipeline: STAGES in order, and `run`, which applies them to `documents`.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's documents.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from topicweir.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from topicweir.runtime import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Several stages can't be said in SQL: a fitted classifier, a tokenizer, a linear program.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with `n_chars` of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score(docs, labels).filter(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines cut out; documents of which no line is left go."""
    left = line_dedup.dedup_lines(docs)
    return _counted(left.filter((F.col("_removed") == 0) | (F.col("_removed") < F.col("_lines"))))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, the one with the least id; of equal ids the first row read.

    Rows are judged one by one, so repeated rows are copies of each other, rows without id go
    where another row has their text, and an id with two texts loses only those that are copies.
    Texts without words link with nothing and stay.
    """
    scratch = Scratch(spark, "near-copies")
    rows = scratch.table(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = jaccard_join.link_documents(rows.select(F.col("row").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = groups.join(rows.select("row", "doc_id"), "row").groupBy("group").agg(first).select("first.row")
    kept = scratch.table(kept, "kept")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items cut out; documents that hardly hold anything else go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _counted(decontaminate.decontaminate(docs.select(*COLUMNS), items))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, as pieces of documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`; each stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
