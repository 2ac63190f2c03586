import math
import random

from pyspark.sql import functions as F

from conftest import plan_of
from topicweir.functions import text as tx
from topicweir.functions.segmentation import SCALE, Lattice


def enumerated(run, terms):
    """The best of all segmentations; of equal ones that with the longer piece where they first differ."""
    total = sum(terms.values()) + 1
    letter = round(-SCALE * math.log(total)) - 1
    score = {t: round(SCALE * math.log(f / total)) for t, f in terms.items()}

    def rests(i):
        if i == len(run):
            return [(0, ())]
        out = [(letter + s, (1, *p)) for s, p in rests(i + 1)]
        for t in terms:
            if run.startswith(t, i):
                out += [(score[t] + s, (len(t), *p)) for s, p in rests(i + len(t))]
        return out

    best = max(rests(0))[1]
    words, i, stretch = [], 0, ""
    for n in (*best, 0):
        if n != 1:
            words += [stretch[k : k + 2] for k in range(len(stretch) - 1)]
            stretch = ""
            words += [run[i : i + n]] if n else []
        else:
            stretch += run[i]
        i += n
    return words


def test_terms_as_often_as_they_stand(column):
    cut = lambda c: tx.segment_chinese(c, ["蛋白质", "数学", "数学分析", "析取"])
    assert column(cut, ["蛋白质和蛋白质", "数学分析", "数学分析取", "分析取数学", "蛋白", "", "题 题"]) == [
        ["蛋白质", "蛋白质"],
        ["数学分析"],
        ["数学分析"],
        ["析取", "数学"],
        ["蛋白"],
        [],
        [],
    ]


def test_frequencies_decide(column):
    assert column(lambda c: tx.segment_chinese(c, {"研究生": 10, "研究": 500, "生命": 500}), ["研究生命"]) == [["研究", "生命"]]
    assert column(lambda c: tx.segment_chinese(c, {"研究生": 10**9, "研究": 1, "生命": 1}), ["研究生命"]) == [["研究生"]]


def test_best_path_against_all_paths(column):
    rng = random.Random(8)
    letters = "数学分析取蛋白"
    for _ in range(6):
        terms = {"".join(rng.choices(letters, k=rng.randrange(2, 5))): rng.choice([1, 5, 5, 1000]) for _ in range(14)}
        runs = ["".join(rng.choices(letters, k=rng.randrange(2, 11))) for _ in range(60)]
        got = column(lambda c: tx.segment_chinese(c, terms, stop=()), runs)
        assert got == [enumerated(r, terms) for r in runs]


def test_every_place_of_a_large_dictionary(column):
    rng = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(400)]
    terms = sorted({"".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(800)})
    text = "，".join("的".join(rng.choices(terms, k=5)) for _ in range(40))
    found = column(lambda c: tx.segment_chinese(c, terms, stop=()), [text])[0]
    assert [w for w in found if w in terms] == [w for part in text.split("，") for w in part.split("的")]


def test_long_run_and_plan(spark, column):
    run = "蛋白质和" * 1500
    assert column(lambda c: F.size(tx.segment_chinese(c, ["蛋白质"])), [run]) == [1500]
    df = spark.range(1).select(tx.process_text(F.lit("数学").substr(F.lit(1), F.col("id").cast("int") + 2), terms=["数学"]))
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)


def test_lattice_refuses_frequency_zero():
    try:
        Lattice.of({"数学": 0})
    except ValueError:
        return
    raise AssertionError


def test_paths_of_known_islands_and_of_long_ones(column):
    """Islands in the constant table and longer ones, next to letters outside the plane of two-byte letters."""
    terms = {"ab": 5, "ba": 9, "abc": 2, "cab": 7, "𠀀a": 3}
    runs = ["abab", "abababababab", "xabyz", "cabcabcab", "𠀀abx𠀀𠀁a", "xyz", "ab", "bacabxba+"]
    got = column(lambda c: tx.segment_chinese(c, terms, stop=(), chars="a-z+\\x{20000}-\\x{20001}"), runs)
    assert got == [enumerated(r, terms) for r in runs]


def test_islands_are_cut_by_one_kept_pattern(spark):
    """A pattern of `split` is compiled for each value, so only blanks are split at, and letters in islands that are not known."""
    lattice = Lattice.of({"ab": 5, "ba": 9, "abc": 2})
    assert lattice._written("xabcx") == "x +abc x" and set(lattice._islands()) >= {"ab", "aba", "abab", "babc"}
    plan = plan_of(spark.range(1).select(lattice.pieces(F.concat(F.lit("ab"), F.col("id").cast("string"))).alias("p")))
    assert plan.index("regexp_replace(") > 0
