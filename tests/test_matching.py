import random
import re

from pyspark.sql import functions as F

from conftest import plan_of
from topicweir.functions.matching import keyword_counts, own_class_count, prefix_pattern
from topicweir.sources.dictionary import KeywordDictionary


def model(text, dictionary):
    return [sum(k in text for k in kws) for _, kws in dictionary.entries]


def dictionary_of(rng, size, letters):
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(size)]
    return KeywordDictionary.of({s: words[i::3] for i, s in enumerate("abc")})


def test_pattern_takes_the_longest_entry():
    rng = random.Random(3)
    for letters in ("ab", "abcdefghijklmnop", "数学分析取蛋白.*+(["):
        words = ["".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(80)]
        pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U%08x" % int(m[1], 16), prefix_pattern(words)))
        for _ in range(200):
            text = "".join(rng.choices(letters, k=9))
            found = pattern.match(text)
            want = max((w for w in words if text.startswith(w)), key=len, default=None)
            assert (found.group() if found else None) == want


def test_counts_against_contains(spark):
    rng = random.Random(4)
    for size, letters in ((3, "ab"), (40, "abc d"), (900, "abcdefghijklm"), (300, "数学分析取蛋白质a-.*+?()[]{}|^$\\#&~ \n\t")):
        packed = dictionary_of(rng, size, letters)
        texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(60)] + ["", " "]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, low string").repartition(3)
        out = df.select("i", keyword_counts(F.col("low"), packed).alias("n"))
        assert "Python" not in plan_of(out) and "Arrow" not in plan_of(out).replace("ArrowEvalPython", "Python")
        assert [r.n for r in out.orderBy("i").collect()] == [model(t, packed) for t in texts]


def test_empty_entries_and_subjects(spark):
    packed = KeywordDictionary.of({"a": ["", "", "x"], "b": [], "c": ["𝔘𝔫", "x", "x"]})
    df = spark.createDataFrame([(0, "x"), (1, ""), (2, "y𝔘𝔫y")], "i int, low string")
    assert [r.n for r in df.orderBy("i").select(keyword_counts(F.col("low"), packed).alias("n")).collect()] == [[3, 0, 2], [2, 0, 0], [2, 0, 1]]
    only = KeywordDictionary.of({"a": [""], "b": []})
    assert df.select(keyword_counts(F.col("low"), only).alias("n")).first().n == [1, 0]
    own = own_class_count(F.col("low"), F.when(F.col("i") == 0, "c").otherwise("?"), packed)
    assert [r.n for r in df.orderBy("i").select(own.alias("n")).collect()] == [2, 0, 0]


def test_long_entries_and_text(spark):
    packed = KeywordDictionary.of({"a": ["z" * n for n in (1, 5, 3000)], "b": ["q" * 2000 + "r"]})
    df = spark.createDataFrame([("z" * 50_000,), ("q" * 40_000 + "r",)], "low string")
    assert [r.n for r in df.select(keyword_counts(F.col("low"), packed).alias("n")).collect()] == [[3, 0], [0, 1]]


def test_few_entries_without_a_pattern(spark):
    packed = KeywordDictionary.of({"a": ["ab", "b", "ab"], "b": ["c d"]})
    df = spark.createDataFrame([("xaby",), ("c d b",), (None,)], "low string")
    out = df.select(keyword_counts(F.col("low"), packed, 3).alias("n"))
    assert [r.n for r in out.collect()] == [[3, 0], [1, 1], [0, 0]]
    assert "regexp" not in plan_of(out)
    assert "regexp" in plan_of(df.select(keyword_counts(F.col("low"), packed, 2).alias("n")))
