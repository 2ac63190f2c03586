import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from topicweir.functions import scores, text as tx
from topicweir.functions.fixed_values import NOT_WORD_OR_SPACE, SPACE, SPACE_CLASS, SPACE_NOT_PLAIN, WORD_CLASS

PUNCT = r"[.,!?;:\-()]{2,}"


def clean_model(s: str) -> str:
    out = re.sub(r"\s+", " ", s.lower())
    out = re.sub(r"[^\w\s一-鿿.,!?;:\-()]", " ", out)
    return re.sub(PUNCT, " ", out).strip()


LETTERS = st.text(alphabet=st.sampled_from("aBzÉñß9_ \t\n　.,!?;:-()#%&$一数学的和DNAσΣ…—"), max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LETTERS, min_size=1, max_size=40))
def test_clean_matches_model(column, values):
    assert column(tx.basic_clean, values) == [clean_model(v) for v in values]


def test_clean_literal(column):
    assert column(tx.basic_clean, ["A  #b!! c...d (x)-y"]) == ["a  b  c d (x y"]


def test_every_character_is_space_or_not(column):
    every = "".join(chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000) + "\U0001F600"
    spaces = "".join(c for c in every if c.isspace())
    [by_replace] = column(lambda c: F.regexp_replace(c, f"{SPACE}+", ""), [every])
    [by_class] = column(lambda c: F.regexp_replace(c, f"[^{SPACE_CLASS}]", ""), [every])
    [no_words] = column(lambda c: F.regexp_replace(c, NOT_WORD_OR_SPACE, ""), [every])
    [no_words_by_class] = column(lambda c: F.regexp_replace(c, f"[^{WORD_CLASS}{SPACE_CLASS}]", ""), [every])
    [plain_kept] = column(lambda c: F.regexp_replace(c, SPACE_NOT_PLAIN, ""), [" \t \n"])
    assert by_class == spaces and plain_kept == "  "
    assert by_replace == "".join(c for c in every if not c.isspace())
    assert no_words == no_words_by_class


def test_runs(column):
    assert column(tx.latin_words, ["été café ab"]) == [["caf", "ab"]]
    assert column(tx.extract_english, ["été café ab"]) == ["caf ab"]
    assert column(tx.extract_chinese, ["数学 é é x 物理题"]) == ["数学 物理题"]


def test_english_filter(column):
    kept = column(lambda c: tx.process_english(tx.latin_words(c)), ["The cat WAS in Of ab abc"])
    assert kept == [["cat", "abc"]]


def test_segment(column):
    assert column(tx.segment_chinese, ["数学题 好 一个 x"]) == [["数学", "学题"]]
    with_terms = column(lambda c: tx.segment_chinese(c, ["蛋白质", "数学"]), ["蛋白质和"])
    assert with_terms == [["蛋白质"]]


def test_process_text(column):
    texts = ["", None, "a 1 !", "数学函数 The Reading of books", "AB"]
    assert column(tx.process_text, texts) == ["", "", "a 1 !", "数学 学函 函数 reading books", "ab"]
    assert column(lambda c: tx.process_text(c, keep_english=False), ["数学 reading"]) == ["数学"]


def test_stopwords_custom():
    words = tx.stopwords(["foo", "page"])
    assert "foo" in words and words.count("page") == 1


def test_jaccard(spark):
    rows = [("red green blue", "green blue pink"), ("", "green"), ("red", "red"), ("the", "of")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(tx.jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0.0, 1.0, 0.0]


def test_text_runs(column):
    xml = '<a:t>A</a:t><a:t lang="x"> B &amp; C\n</a:t><a:t></a:t><a:t> </a:t>'
    assert column(tx.text_runs, [xml]) == ["A B &amp; C"]
    assert column(lambda c: tx.text_runs(c, unescape=True), [xml, "<a:t>&amp;lt;</a:t>"]) == ["A B & C", "&lt;"]


def test_first_text(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(tx.first_text(F.col("a"), F.col("b"))).collect()] == ["a", "b", ""]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.lists(st.floats(0, 1), min_size=2, max_size=6), min_size=1, max_size=20),
    st.sampled_from([0.5, 2.0, 5.0]),
)
def test_temperature(spark, rows, t):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<double>")
    got = [r.q for r in df.select("i", scores.temperature_scale(F.col("p"), t).alias("q")).orderBy("i").collect()]
    for p, q in zip(rows, got):
        powered = [min(max(x, 1e-10), 1 - 1e-10) ** (1 / t) for x in p]
        assert q == pytest.approx([x / sum(powered) for x in powered])
        assert sum(q) == pytest.approx(1)


def test_small_columns(spark):
    df = spark.createDataFrame([(0.9, [0.2, 0.5, 0.5]), (0.8, [1.0]), (0.6, [0.0, 0.0])], "c double, p array<double>")
    rows = df.select(
        scores.confidence_band(F.col("c")), scores.arg_max(F.col("p")), scores.align_width(F.col("p"), 2)
    ).collect()
    assert [tuple(r) for r in rows] == [("high", 2, [0.2, 0.5]), ("medium", 1, [1.0, 0.0]), ("low", 1, [0.0, 0.0])]
