"""Keyword dictionaries: ordered subject -> keyword lists, as JSON files and long tables."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicweir.functions.fixed_values import DEFAULT_KEYWORDS
from topicweir.runtime import literal_table

# A packed dictionary travels inside the plan of every scoring task, so its size is checked.
MAX_PACKED_ENTRIES = 1_000_000

DICTIONARY_COLUMNS = ["subject", "subject_ord", "kw_ord", "keyword"]
DICTIONARY_TYPES = ["string", "int", "int", "string"]


@dataclass(frozen=True)
class KeywordDictionary:
    """Ordered subjects, each with an ordered keyword list (repeats allowed)."""

    entries: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def of(cls, mapping: Mapping[str, Sequence[str]]) -> "KeywordDictionary":
        return cls(tuple((s, tuple(kws)) for s, kws in mapping.items()))

    @classmethod
    def from_frame(cls, df: DataFrame) -> "KeywordDictionary":
        """Pack a long dictionary table; refuses one that is too large to ship with tasks."""
        rows = df.select(*DICTIONARY_COLUMNS).limit(MAX_PACKED_ENTRIES + 1).collect()
        if len(rows) > MAX_PACKED_ENTRIES:
            raise ValueError(f"dictionary has more than {MAX_PACKED_ENTRIES} entries; score it in parts by subject")
        packed: dict[str, list[str]] = {}
        for row in sorted(rows, key=lambda r: (r.subject_ord, r.kw_ord)):
            packed.setdefault(row.subject, []).append(row.keyword)
        return cls.of(packed)

    @property
    def subjects(self) -> list[str]:
        return [s for s, _ in self.entries]

    @property
    def size(self) -> int:
        return sum(len(kws) for _, kws in self.entries)

    def keywords(self, subject: str) -> list[str]:
        return list(dict(self.entries).get(subject, ()))

    def lowered(self) -> "KeywordDictionary":
        return KeywordDictionary(tuple((s, tuple(k.lower() for k in kws)) for s, kws in self.entries))

    def distinct(self) -> "KeywordDictionary":
        return KeywordDictionary(tuple((s, tuple(dict.fromkeys(kws))) for s, kws in self.entries))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s, i, j, k) for i, (s, kws) in enumerate(self.entries) for j, k in enumerate(kws)]
        return literal_table(spark, rows, DICTIONARY_COLUMNS, DICTIONARY_TYPES)


def default_dictionary() -> KeywordDictionary:
    return KeywordDictionary.of(DEFAULT_KEYWORDS)


def parse_dictionary(json_text: Column) -> Column:
    return F.from_json(json_text, "map<string,array<string>>")


def load_dictionary(
    spark: SparkSession, path: str, default: KeywordDictionary | None = None
) -> DataFrame:
    """Long dictionary table of a JSON file; the default where it is missing or unreadable."""
    fallback = default or default_dictionary()
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as err:  # a missing path only shows as an analysis error
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return fallback.to_frame(spark)
    parsed = raw.select(parse_dictionary("value").alias("subjects"))
    table = parsed.select(F.posexplode("subjects").alias("subject_ord", "subject", "keywords")).select(
        "subject", "subject_ord", F.posexplode("keywords").alias("kw_ord", "keyword")
    )
    return table if table.take(1) else fallback.to_frame(spark)


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    """Write one JSON object, subjects and keywords in order, text unescaped.

    A dictionary is one JSON document by definition, so the subjects meet in one row.
    """
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("kw_ord", "keyword"))), lambda e: e["keyword"]
    )
    per_subject = dictionary.groupBy("subject", "subject_ord").agg(ordered.alias("keywords"))
    entries = F.transform(
        F.sort_array(F.collect_list(F.struct("subject_ord", "subject", "keywords"))),
        lambda e: F.struct(e["subject"], e["keywords"]),
    )
    (
        per_subject.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
        .coalesce(1)
        .write.mode("overwrite")
        .text(path)
    )
