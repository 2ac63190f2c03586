from datetime import datetime

import pytest

from topicweir.sources.dictionary import KeywordDictionary
from topicweir.streaming.changed import classify_changes, current_results

WORDS = KeywordDictionary.of({"a": ["red"], "b": ["sea", "sky"]})
KIND = "path string, length long, modificationTime timestamp, text string"


@pytest.fixture
def feed(spark, tmp_path):
    def put(*rows):
        data = [(p, n, datetime(2024, 1, day), t) for p, n, day, t in rows]
        spark.createDataFrame(data, KIND).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        classify_changes(spark, stream, str(tmp_path / "out"), str(tmp_path / "mark"), WORDS).awaitTermination()
        return {r.path: (r.length, r.subject) for r in current_results(spark, str(tmp_path / "out")).collect()}

    return put, run


def test_changed_rows_replace_their_results(spark, feed, tmp_path):
    put, run = feed
    put(("x", 3, 1, "red"), ("y", 3, 1, "sea sky"), ("z", 4, 1, "none"), ("x", 9, 1, "sky sky"), (None, 1, 1, "red"))
    assert run() == {"x": (9, "b"), "y": (3, "b"), "z": (4, "未知")}
    # A new query on the same checkpoint is a restart: what was seen is not scored again.
    put(("y", 3, 1, "red"), ("z", 5, 2, "red"), ("w", 1, 1, "red"))
    assert run() == {"x": (9, "b"), "y": (3, "b"), "z": (5, "a"), "w": (1, "a")}
    # An older version that comes late changes nothing; an equal time with another size does.
    put(("z", 4, 1, "sea"), ("w", 2, 1, "sea"))
    assert run() == {"x": (9, "b"), "y": (3, "b"), "z": (5, "a"), "w": (2, "b")}
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.path, r.changed) for r in rows.select("path", "changed").collect()) == [
        ("w", False), ("w", True), ("x", False), ("y", False), ("z", False), ("z", True),
    ]
    assert run()["z"] == (5, "a")
