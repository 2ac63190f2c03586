import hashlib
import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicweir.operators import dataset
from topicweir.sources import sinks

CLASSES = ["b", "a", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """One class holds most rows."""
    data = [(i, "a" if i % 10 < 7 else "b" if i % 10 < 9 else "c") for i in range(1003)] + [(5000, "z")]
    return spark.createDataFrame(data, "doc_id long, label string").repartition(4).persist()


def hashed(rows, label, seed=42):
    ids = [r.doc_id for r in rows.collect() if r.label == label]
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("digits", [0, 1, 4])
@pytest.mark.parametrize("k", [0, 1, 7, 100, 5000])
def test_limit_per_class(rows, monkeypatch, digits, k):
    monkeypatch.setattr(dataset, "PREFIX_DIGITS", digits)
    got = dataset.limit_per_class(rows, CLASSES, k)
    assert got.columns == ["doc_id", "label"]
    found = {c: sorted(r.doc_id for r in got.collect() if r.label == c) for c in CLASSES}
    assert found == {c: sorted(hashed(rows, c)[:k]) for c in CLASSES}


def test_seed_and_shuffle(rows):
    one = dataset.limit_per_class(rows, CLASSES, 5, seed=1).collect()
    assert sorted(one) != sorted(dataset.limit_per_class(rows, CLASSES, 5, seed=2).collect())
    order = [r.doc_id for r in dataset.limit_per_class(rows, CLASSES, 5, shuffle=True).collect()]
    assert order == sorted(order, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())


@pytest.mark.parametrize("size", [0.2, 0.33, 0.5])
def test_stratified_split(rows, size):
    got = dataset.stratified_split(rows, CLASSES, size)
    parts = Counter((r.label, r.part) for r in got.collect())
    sizes = Counter(r.label for r in rows.collect() if r.label in CLASSES)
    assert sum(n for (_, p), n in parts.items() if p == "test") == math.ceil(size * sum(sizes.values()))
    for c in CLASSES:
        assert parts[c, "test"] + parts[c, "train"] == sizes[c]
        assert abs(parts[c, "test"] - size * sizes[c]) <= 1
        test_ids = {r.doc_id for r in got.collect() if r.label == c and r.part == "test"}
        assert test_ids == set(hashed(rows, c)[: len(test_ids)])


def test_class_subset(rows):
    assert dataset.class_subset(rows, "c", CLASSES).count() == 100
    assert dataset.class_subset(rows, "c", CLASSES, 9).count() == 9
    assert dataset.class_subset(rows, "none", ["none"]).count() == 0
    with pytest.raises(ValueError):
        dataset.class_subset(rows, "z", CLASSES)


def test_analysis(rows):
    got = {r.label: r for r in dataset.analyze_dataset(rows, ["a", "b", "c", "d"]).collect()}
    assert [got[c].n for c in "abcd"] == [703, 200, 100, 0]
    assert got["d"].percent == 0.0 and got["a"].total == 1003
    assert got["a"].imbalance == pytest.approx(7.03) and got["a"].unbalanced
    even = dataset.analyze_dataset(rows.filter("label = 'c'"), ["c"]).first()
    assert even.imbalance == 1.0 and not even.unbalanced


def test_codes(rows):
    coded = dataset.label_encode(rows.filter("label <> 'z'"), CLASSES)
    assert {(r.label, r.code) for r in coded.select("label", "code").distinct().collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert dataset.label_decode(coded, CLASSES).filter("label <> decoded").count() == 0
    assert {(r.label, r.n) for r in dataset.encoded_distribution(coded, CLASSES).collect()} == {("a", 703), ("b", 200), ("c", 100)}
    subjects = ["语文", "数学", "英语", "物理", "化学", "生物"]
    assert dataset.label_codes(subjects) == sorted(subjects)


def test_info_and_files(spark, tmp_path):
    files = [(f"/d/数学/m{i}.pptx", "数学") for i in range(7)] + [("/d/物理/p.pptx", "物理"), ("/d/x/o.pptx", "x")]
    df = spark.createDataFrame(files, "path string, label string")
    subjects = ["物理", "数学", "化学"]
    info = dataset.dataset_info(df, subjects)
    sinks.write_dataset_info(info, str(tmp_path / "info"), subjects, "/d")
    text = spark.read.text(str(tmp_path / "info")).first()[0]
    assert json.loads(text) == {
        "subjects": subjects,
        "data_dir": "/d",
        "total_files": 8,
        "distribution": {"物理": 1, "数学": 7, "化学": 0},
        "file_examples": {"物理": ["p.pptx"], "数学": [f"m{i}.pptx" for i in range(5)]},
    }
    assert list(json.loads(text)["distribution"]) == subjects
    sinks.write_mini(dataset.mini_dataset(df, subjects, 3, id_col="path"), str(tmp_path / "mini"))
    mini = spark.read.option("header", True).csv(str(tmp_path / "mini"))
    assert mini.columns == ["file_path", "label"]
    assert {(r.label, r["count"]) for r in mini.groupBy("label").count().collect()} == {("数学", 3), ("物理", 1)}
