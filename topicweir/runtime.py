"""Session helpers: partition spreading, shared scratch folder, small literal tables."""

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a plain scan by `keys` only when it yields fewer splits than slots.

    A large table already arrives in many splits and is left alone, so no shuffle is
    added at scale. The hash (not round-robin) keeps retries deterministic.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


# Folders made for applications that run on one machine and name none.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Where the setting is missing, a temporary folder per application on a local master, else an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="topicweir-")
        folder = _LOCAL_FOLDERS[context.applicationId]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives executor loss."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A driver-side list as a DataFrame inside the plan: one JSON literal, no Python in tasks."""
    items = json.dumps([dict(zip(names, row)) for row in rows], ensure_ascii=False)
    schema = ", ".join(f"{n}: {t}" for n, t in zip(names, types))
    return spark.range(1).select(F.inline(F.from_json(F.lit(items), f"array<struct<{schema}>>")))


def json_constant(value: list, kind: str) -> Column:
    """A nested driver-side list as a constant of the plan; the optimizer parses it once."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def literal_array(values: list, kind: str = "string") -> Column:
    """A driver-side list as one constant array column."""
    return json_constant(values, f"array<{kind}>")


def per_class_window():
    """One frame over a table of model size (a row per class or feature); never over data rows."""
    return Window.partitionBy(F.lit(0))


def number_within(df: DataFrame, group: str, *order: Column, name: str = "rn") -> DataFrame:
    """`df` with the place (from 1) of each row among those of its group, in `order`.

    Unlike a window this never meets a group in one task: rows are range-partitioned and numbered
    where they lie, and each group's places go on from partition to partition. The counts per
    group and partition that this takes are as many as groups and partitions together.
    """
    place = F.monotonically_increasing_id()
    rows = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("_place", place)
    rows = write_once(rows, "numbered")
    part = F.shiftright("_place", 33)
    runs = rows.groupBy(group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(group).alias("_of"), "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(runs, F.col(group).eqNullSafe(F.col("_of")) & (part == F.col("_part")))
    return joined.select(*df.columns, (F.col("_place") - F.col("_first") + F.col("_before") + 1).cast("int").alias(name))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def subject_map(key: str, order: str, value: str, keep: Column | None = None) -> Column:
    """Aggregate: an ordered map over a table with one row per class."""
    entry = F.struct(F.col(order), F.col(key), F.col(value))
    entry = entry if keep is None else F.when(keep, entry)
    return F.map_from_entries(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e[key], e[value]))
    )


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once; later filters and joins act on their values.

    A filter on a computed column is otherwise moved below the projection, with the whole
    expression copied into it, once per use and without sharing. Columns that come out of a
    generator are values, so such a filter stays above; filters on other columns still reach
    the scan.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*[F.col(n) for n in names]))))


class Scratch:
    """Intermediate tables in the shared folder, removed by `close()` or one by one.

    A written table cuts lineage and survives lost executors. Tables that a returned frame
    still reads must outlive it, so their owner closes the scratch after the last action.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = fresh_path(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.drop()

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.close()
