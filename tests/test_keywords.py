import json

import pytest

from topicweir.functions.fixed_values import DEFAULT_KEYWORDS, SUBJECTS
from topicweir.operators import keywords
from topicweir.sources import dictionary as dictionaries
from topicweir.sources.dictionary import KeywordDictionary, default_dictionary, load_dictionary, save_dictionary


def test_dictionary_round_trip(spark, tmp_path):
    packed = KeywordDictionary.of({"数学": ["函数", 'quote"d', "函数"], "a": ["x"], "empty": []})
    save_dictionary(packed.to_frame(spark), str(tmp_path / "d"))
    text = spark.read.text(str(tmp_path / "d"), wholetext=True).first()[0]
    assert "函数" in text and list(json.loads(text)) == ["数学", "a"]
    assert KeywordDictionary.from_frame(load_dictionary(spark, str(tmp_path / "d"))).entries == packed.entries[:2]


def test_load_plain_json_file(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"b": ["2", "1"], "a": ["3"]}, indent=2))
    got = load_dictionary(spark, str(tmp_path / "k.json")).orderBy("subject_ord", "kw_ord").collect()
    assert [tuple(r) for r in got] == [("b", 0, 0, "2"), ("b", 0, 1, "1"), ("a", 1, 0, "3")]


def test_missing_or_unreadable_file_gives_default(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    for name in ("none.json", "bad.json"):
        got = KeywordDictionary.from_frame(load_dictionary(spark, str(tmp_path / name)))
        assert got == default_dictionary()
    assert default_dictionary().size == 47 and list(DEFAULT_KEYWORDS) == SUBJECTS


def test_packed_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(dictionaries, "MAX_PACKED_ENTRIES", 10)
    with pytest.raises(ValueError):
        KeywordDictionary.from_frame(default_dictionary().to_frame(spark))


def test_doc_keywords(spark):
    texts = ["dog cat dog bird cat ant", "", "slide slide fox", "数学数学"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rows = keywords.doc_keywords(df, 3).orderBy("doc_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.token, r.n))
    assert got == {0: [("dog", 2), ("cat", 2), ("bird", 1)], 2: [("fox", 1)], 3: [("数学", 2), ("学数", 1)]}


def test_class_keywords(spark):
    df = spark.createDataFrame([("a", "Red red blue ppt"), ("a", "blue 是 x"), ("b", ""), ("z", "other")], "label string, text string")
    rows = keywords.class_keywords(df, ["a", "b"], 2).orderBy("kw_ord").collect()
    assert [(r.subject, r.keyword, r.n) for r in rows] == [("a", "blue", 2), ("a", "red", 2)]


def frame(spark, **subjects):
    return KeywordDictionary.of(subjects).to_frame(spark)


def test_merge(spark):
    old, new = frame(spark, a=["bb", "ccc"], b=["q"]), frame(spark, a=["dd", "bb", "aaa"], c=["no"])
    base = frame(spark, a=["dd", "unused"])

    def run(**kw):
        rows = keywords.merge_dictionaries(old, new, base, ["a", "b"], **kw).orderBy("subject_ord", "kw_ord").collect()
        return [(r.subject, r.keyword) for r in rows]

    assert run() == [("a", "aaa"), ("a", "ccc"), ("a", "dd"), ("a", "bb"), ("b", "q")]
    assert run(keep_existing=False) == [("a", "aaa"), ("a", "dd"), ("a", "bb")]
    assert run(limit=1) == [("a", "aaa"), ("b", "q")]


def test_hit_rate(spark):
    packed = KeywordDictionary.of({"a": ["red", "red", "DNA"], "b": ["x"]})
    df = spark.createDataFrame([("a", "Red dna car"), ("a", "red"), ("b", ""), ("q", "one two")], "label string, text string")
    got = {r.label: r.hit_rate for r in keywords.keyword_hit_rate(df, packed).collect()}
    assert got == {"a": 0.5, "b": 0.0, "q": 0.0}
    only = keywords.keyword_hit_rate(df.filter("label = 'a'"), packed).collect()
    assert {r.label: (r.hits, r.words, r.hit_rate) for r in only} == {"a": (2, 4, 0.5), "b": (0, 0, 0.0)}
    low = {r.label: r.hit_rate for r in keywords.keyword_hit_rate(df, packed, lower_keywords=True).collect()}
    assert low["a"] == 0.75


def test_stats_and_ambiguous(spark):
    table = frame(spark, a=["DNA", "基因x", "酶", "x", "y", "z"], b=["x", "DNA"], c=["x", "w", "w"])
    got = {r.subject: r for r in keywords.dictionary_stats(table).collect()}
    assert (got["a"].n, got["a"].chinese_count, got["a"].english_count) == (6, 2, 4)
    assert got["a"].avg_length == pytest.approx(10 / 6) and got["a"].examples == ["DNA", "基因x", "酶", "x", "y"]
    rows = keywords.ambiguous_keywords(table).collect()
    assert [(r.keyword, r.subjects) for r in rows] == [("x", ["a", "b", "c"]), ("DNA", ["a", "b"]), ("w", ["c", "c"])]


def test_export_and_segment_terms(spark):
    table = frame(spark, 数学=["函数", "x", "pH值"], other=["word"])
    rows = keywords.export_described(table).orderBy("subject_ord", "kw_ord").collect()
    assert [r.keyword for r in rows] == ["数学公式、几何、代数、计算", "函数", "x", "pH值", "word"]
    assert [r.kw_ord for r in rows] == [0, 1, 2, 3, 0]
    assert {r.keyword for r in keywords.segment_terms(table).collect()} == {"函数", "pH值"}


def test_class_keywords_are_not_capped(spark):
    df = spark.range(1).selectExpr("'a' AS label", "array_join(transform(sequence(1, 3000), i -> concat('w', i)), ' ') AS text")
    assert keywords.class_keywords(df, ["a"], 2000).count() == 2000
    assert keywords.class_keywords(df, ["a"], 2000, max_terms=1000).count() == 1000
