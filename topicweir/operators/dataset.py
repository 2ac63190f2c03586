"""Labelled collections: sampling per class, splits, class counts, label codes.

Classes are always given as a list (configuration), so tables with a row per class are
bounded by it and may be broadcast.
"""

from collections.abc import Callable, Sequence

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import DataFrame, Window, functions as F

from topicweir.runtime import literal_table, per_class_window

# Hex digits of the hash used to cut a class into ordered buckets (16^4 per class).
PREFIX_DIGITS = 4


def hash_key(seed: int, id_col: str):
    """Deterministic pseudo-random order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def subject_table(spark, subjects: Sequence[str], name: str = "label") -> DataFrame:
    return literal_table(spark, [(s, i) for i, s in enumerate(subjects)], [name, "ord"], ["string", "int"])


def pick_by_hash(
    df: DataFrame,
    subjects: Sequence[str],
    quota: Callable[[DataFrame], DataFrame],
    label: str = "label",
    id_col: str = "doc_id",
    seed: int = 42,
) -> DataFrame:
    """Add `picked`: true for the first `quota` rows of each class in hash order.

    No class is gathered in one task. Rows are counted per (class, hash prefix); the running
    count tells which prefix holds the class's cut, and the hashes and ids of that one prefix
    (1/65536 of a class, no other column) are ranked to find the last row that is picked. The
    data are then read once and compared with the cut of their class.

    `quota` turns a table (label, n) into (label, quota). Rows without a configured label go.
    """
    rows = df.filter(F.col(label).isin(list(subjects)))
    keys = rows.select(label, hash_key(seed, id_col).alias("_hash"), F.col(id_col).alias("_id"))
    keys = keys.withColumn("_prefix", F.substring("_hash", 1, PREFIX_DIGITS))
    buckets = keys.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("n"))
    classes = buckets.groupBy(label).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(label).orderBy("_prefix"))
    quotas = quota(classes).select(label, "quota")
    edges = (
        buckets.withColumn("_upto", upto)
        .join(F.broadcast(quotas), label)
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("n") < F.col("quota")))
        .select(label, "_prefix", (F.col("quota") - F.col("_upto") + F.col("n")).alias("_room"))
    )
    order = Window.partitionBy(label).orderBy("_hash", "_id")
    last = (
        keys.join(F.broadcast(edges), [label, "_prefix"])
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_room"))
        .select(label, F.struct("_hash", F.col("_id").cast("string").alias("_id")).alias("_last"))
    )
    # At most one row per configured class; a class without a last row is picked whole or not at all.
    found = quotas.join(last, label, "left").select(label, "quota", "_last._hash", "_last._id").collect()
    none, every = ("", None), ("g", None)
    cuts = [(r[label], *((r["_hash"], r["_id"]) if r["_hash"] else every if r["quota"] > 0 else none)) for r in found]
    cuts = literal_table(df.sparkSession, cuts, [label, "_cut", "_cut_id"], ["string", "string", "string"])
    bounded = rows.withColumn("_hash", hash_key(seed, id_col)).join(F.broadcast(cuts), label)
    upto_id = F.col(id_col) <= F.col("_cut_id").cast(df.schema[id_col].dataType)
    picked = (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & upto_id)
    return bounded.select(*df.columns, picked.alias("picked"))


def limit_per_class(
    df: DataFrame,
    subjects: Sequence[str],
    limit: int,
    label: str = "label",
    id_col: str = "doc_id",
    seed: int = 42,
    shuffle: bool = False,
) -> DataFrame:
    """At most `limit` pseudo-random rows per class; optionally in pseudo-random order."""
    picked = pick_by_hash(
        df, subjects, lambda c: c.withColumn("quota", F.lit(limit).cast("long")), label, id_col, seed
    )
    picked = picked.filter("picked").drop("picked")
    return picked.orderBy(hash_key(seed, id_col), id_col) if shuffle else picked


def mini_dataset(
    df: DataFrame, subjects: Sequence[str], n: int = 10, label: str = "label", id_col: str = "doc_id", seed: int = 42
) -> DataFrame:
    return limit_per_class(df, subjects, n, label, id_col, seed)


def class_subset(
    df: DataFrame,
    subject: str,
    subjects: Sequence[str],
    limit: int | None = None,
    label: str = "label",
    id_col: str = "doc_id",
    seed: int = 42,
) -> DataFrame:
    """Rows of one class, optionally a pseudo-random part; an unknown class is an error."""
    if subject not in subjects:
        raise ValueError(f"unknown subject: {subject}")
    rows = df.filter(F.col(label) == subject)
    return rows if limit is None else limit_per_class(rows, [subject], limit, label, id_col, seed)


def test_quotas(classes: DataFrame, test_size: float, label: str) -> DataFrame:
    """Test rows per class so that all classes together give ceil(test_size * N).

    Train rows go to classes in proportion, by largest remainder (ties by class name);
    the test part is what is left. Works on a table with one row per class.
    """
    every = per_class_window()
    shares = classes.withColumn("_all", F.sum("n").over(every))
    shares = shares.withColumn("_train", F.col("_all") - F.ceil(F.lit(test_size) * F.col("_all")))
    shares = shares.withColumn("_exact", F.col("n") / F.col("_all") * F.col("_train"))
    shares = shares.withColumn("_floor", F.floor("_exact"))
    shares = shares.withColumn("_missing", F.col("_train") - F.sum("_floor").over(every))
    order = every.orderBy((F.col("_exact") - F.col("_floor")).desc(), label)
    extra = (F.row_number().over(order) <= F.col("_missing")).cast("long")
    return shares.select(label, (F.col("n") - F.col("_floor") - extra).alias("quota"))


def stratified_split(
    df: DataFrame,
    subjects: Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    label: str = "label",
    id_col: str = "doc_id",
) -> DataFrame:
    """Add `part` ('train'/'test'), each class represented in proportion."""
    picked = pick_by_hash(df, subjects, lambda c: test_quotas(c, test_size, label), label, id_col, seed)
    return picked.withColumn("part", F.when(F.col("picked"), "test").otherwise("train")).drop("picked")


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def analyze_dataset(df: DataFrame, subjects: Sequence[str], label: str = "label") -> DataFrame:
    """Count and share for every configured class, with total and imbalance on each row."""
    counts = class_distribution(df.filter(F.col(label).isin(list(subjects))), label)
    table = subject_table(df.sparkSession, subjects, label).join(counts, label, "left")
    every = per_class_window()
    table = table.withColumns({"_present": F.col("n"), "n": F.coalesce("n", F.lit(0))})
    table = table.withColumn("total", F.sum("n").over(every))
    ratio = F.max("_present").over(every) / F.greatest(F.min("_present").over(every), F.lit(1))
    return table.select(
        label,
        "n",
        F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("percent"),
        "total",
        ratio.alias("imbalance"),
        (ratio > 3).alias("unbalanced"),
    )


def dataset_info(
    df: DataFrame, subjects: Sequence[str], label: str = "label", path: str = "path", examples: int = 5
) -> DataFrame:
    """Per class: count and the first base names in name order, joined with a comma."""
    base = F.element_at(F.split(path, "/"), -1)
    rows = df.filter(F.col(label).isin(list(subjects))).select(label, F.col(path), base.alias("_name"))
    order = Window.partitionBy(label).orderBy("_name", path)
    named = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= examples)
    listed = named.groupBy(label).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_name"))), lambda e: e["_name"]).alias("examples")
    )
    table = subject_table(df.sparkSession, subjects, label)
    out = table.join(class_distribution(rows, label), label, "left").join(listed, label, "left")
    return out.select(
        label,
        "ord",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )


def label_codes(subjects: Sequence[str]) -> list[str]:
    """Class names in code order: the position is the code."""
    return sorted(set(subjects))


def label_model(subjects: Sequence[str], label: str = "label", code: str = "code") -> StringIndexerModel:
    """The encoder as an ML stage, to be saved with other models."""
    return StringIndexerModel.from_labels(label_codes(subjects), inputCol=label, outputCol=code)


def label_encode(df: DataFrame, subjects: Sequence[str], label: str = "label", code: str = "code") -> DataFrame:
    return label_model(subjects, label, code).transform(df).withColumn(code, F.col(code).cast("int"))


def label_decode(df: DataFrame, subjects: Sequence[str], code: str = "code", label: str = "decoded") -> DataFrame:
    decoder = IndexToString(inputCol="_code", outputCol=label, labels=label_codes(subjects))
    return decoder.transform(df.withColumn("_code", F.col(code).cast("double"))).drop("_code")


def encoded_distribution(df: DataFrame, subjects: Sequence[str], code: str = "code") -> DataFrame:
    """Rows per label code, with the class name."""
    return label_decode(df.groupBy(code).agg(F.count(F.lit(1)).alias("n")), subjects, code, "label")
