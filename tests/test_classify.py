import pytest
from pyspark.sql import functions as F

from topicweir.operators import classify
from topicweir.sources.dictionary import KeywordDictionary, default_dictionary

SMALL = KeywordDictionary.of({"bio": ["DNA", "cell", "gene", "gen"], "chem": ["acid", "salt", "ion", "gene"]})


def results(spark, texts, dictionary=SMALL, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rows = classify.keyword_classify(df, dictionary, **kw).orderBy("doc_id").collect()
    return [(r.subject, round(r.confidence, 6)) for r in rows]


def model(text, dictionary):
    """Straight reading of the scoring rule."""
    best = ("未知", 0.0)
    for subject, kws in dictionary.entries:
        count = sum(k.lower() in (text or "").lower() for k in kws)
        score = min(count / len(kws) * (1.2 if len(text or "") > 1000 else 1.0), 1.0)
        if count and score * 10 > best[1]:
            best = (subject, score * 10)
    return best[0], round(best[1], 6)


TEXTS = ["dna", "genes", "gene salt acid", "", None, "nothing", "x" * 996 + " dna", "x" * 997 + " dna", "GEN CELL DNA gene"]


def test_scores(spark):
    assert results(spark, TEXTS) == [model(t, SMALL) for t in TEXTS]


def test_length_factor(spark):
    plain, long = results(spark, ["y" * 997 + "dna", "y" * 998 + "dna"])
    assert plain == ("bio", 2.5) and long == ("bio", 3.0)


def test_tie_goes_to_earlier_subject(spark):
    tie = KeywordDictionary.of({"b": ["x"], "a": ["y"]})
    assert results(spark, ["x y"], tie) == [("b", 10.0)]


def test_repeated_entry_counts_twice(spark):
    twice = KeywordDictionary.of({"a": ["x", "x", "q", "r"], "b": ["y", "z", "p", "s"]})
    assert results(spark, ["x y"], twice) == [("a", 5.0)]


def test_built_in_dictionary(spark):
    got = results(spark, ["函数与方程的证明", "dna 蛋白质"], default_dictionary())
    assert got == [("数学", 3.75), ("生物", 2.5)]


def fixed_model(subject, confidence):
    def score(df):
        return df.withColumns({"model_subject": F.lit(subject), "model_confidence": F.lit(confidence)})

    return score


def test_cascade(spark):
    wide = KeywordDictionary.of({"a": ["k1"] + [f"no{i}" for i in range(19)], "b": ["k2"]})
    df = spark.createDataFrame([(0, "k1"), (1, "k2"), (2, ""), (3, "zzz"), (4, None)], "doc_id int, text string")

    def run(model):
        rows = classify.cascade_classify(df, wide, model).orderBy("doc_id").collect()
        return [(r.text, r.subject, r.confidence) for r in rows]

    assert run(None) == [("k1", "a", 0.5), ("k2", "b", 10.0), ("", "未知", 0.0), ("zzz", "未知", 0.0), (None, "未知", 0.0)]
    strong = run(fixed_model("m", 1.0))
    assert strong == [("k1", "m", 0.99), ("k2", "b", 10.0), ("", "未知", 0.0), ("zzz", "m", 0.99), (None, "未知", 0.0)]
    assert run(fixed_model("m", 0.5))[0] == ("k1", "m", 0.5)
    assert run(fixed_model("m", 0.4))[0] == ("k1", "a", 0.5)


def test_model_reads_no_decided_text(spark):
    seen = []

    def score(df):
        seen.extend(r.text for r in df.collect())
        return fixed_model("m", 1.0)(df)

    df = spark.createDataFrame([("k2",), ("other",)], "text string")
    classify.cascade_classify(df, KeywordDictionary.of({"b": ["k2"]}), score).collect()
    assert sorted(seen) == ["", "other"]


def test_model_classify(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3], 0.0), ([0.5, 0.5, 0.0], 2.0), (None, 1.0)], "probability array<double>, prediction double")
    rows = classify.model_classify(df, ["x", "y", "z"]).collect()
    assert [(r.model_subject, r.model_confidence) for r in rows] == [("y", 0.5), ("x", 0.5), ("未知", 0.0)]
    rows = classify.model_classify(df, ["x", "y", "z"], probability=None).collect()
    assert [(r.model_subject, r.model_confidence) for r in rows] == [("x", 0.7), ("z", 0.7), ("y", 0.7)]


def test_keyword_only_reads_first_slides(spark):
    rows = [("d", i, "salt" if i == 10 else "word") for i in range(12)]
    df = spark.createDataFrame(rows, "path string, slide_idx int, text string")
    assert classify.keyword_only(df, SMALL).first().subject == "未知"
    assert classify.keyword_only(df, SMALL, max_slides=11).first().subject == "chem"


def test_incremental(spark):
    new = spark.createDataFrame([("a", 1, "dna"), ("b", 2, "salt"), ("c", 3, "cell")], "path string, length int, text string")
    old = spark.createDataFrame(
        [("a", 1, "kept", 0.1), ("b", 9, "stale", 0.2), ("gone", 1, "x", 0.3)],
        "path string, length int, subject string, confidence double",
    )
    rows = classify.incremental_classify(new, old, SMALL, ["path", "length"]).orderBy("path").collect()
    assert [(r.path, r.subject, r.reused) for r in rows] == [("a", "kept", True), ("b", "chem", False), ("c", "bio", False)]


def test_incremental_keeps_null_keys_and_single_rows(spark):
    new = spark.createDataFrame([("a", None, "dna"), (None, 1, "acid"), ("c", 3, "salt"), ("c", 3, "salt")], "path string, length int, text string")
    old = spark.createDataFrame(
        [("a", None, "chem", 0.5), ("c", 3, "bio", 0.2), ("c", 3, "chem", 0.9)], "path string, length int, subject string, confidence double"
    )
    rows = classify.incremental_classify(new, old, SMALL, ["path", "length"]).collect()
    got = sorted(((r.path, r.length, r.subject, r.reused) for r in rows), key=str)
    assert got == [("a", None, "chem", True), ("c", 3, "chem", True), ("c", 3, "chem", True), (None, 1, "chem", False)]
