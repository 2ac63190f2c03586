import random

import pytest

from topicweir.llm.line_dedup import dedup_lines


def brute(rows, window, unit_words):
    """Texts left, deciding each window of units by comparing it with all earlier ones."""
    documents = sorted({(d, t) for d, t in rows if t}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, left = set(), {}
    for doc in documents:
        units = [
            (line.strip(), u, number)
            for number, line in enumerate(doc[1].split("\n")) if line.strip()
            for u in range(-(-len(line.split()) // unit_words))
        ]
        gone = set()
        for s in range(len(units) - window + 1):
            key = tuple(x[:2] for x in units[s : s + window])
            if key in seen:
                gone.update(x[2] for x in units[s : s + window])
            seen.add(key)
        left[doc] = "\n".join(x for i, x in enumerate(doc[1].split("\n")) if i not in gone)
    return sorted(((d, left.get((d, t), t)) for d, t in rows), key=str)


@pytest.mark.parametrize("window,unit_words", [(1, 4), (2, 3), (3, 2), (4, 100)])
@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_earlier_windows(spark, window, unit_words, seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14)))) for i in range(40)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, None), (102, ""), (None, rows[5][1]), (103, "\n\n")]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, start int, first string").repartition(3)
    got = dedup_lines(df, window, unit_words)
    assert got.columns == ["doc_id", "text", "start", "first", "_lines", "_removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(rows, window, unit_words)


def test_one_long_line_weighs_as_several(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"alpha\n{passage}\nbeta"), (2, f"gamma\n{passage}\ndelta"), (3, "alpha\nbeta"), (4, "short line\nalpha")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "gamma\ndelta", 3: "alpha\nbeta", 4: "short line\nalpha"}


def test_one_line_of_nine_words_goes_alone_and_shorter_ones_in_runs(spark):
    nine, eight = " ".join(f"n{i}" for i in range(9)), " ".join(f"e{i}" for i in range(8))
    rows = [(i, f"own{i}\n{nine}\nlast{i}\n{eight}") for i in range(5)]
    rows += [(10, f"{eight}\nshort"), (11, f"x\n{eight}\nshort\ny"), (12, f"{nine} more\n{nine}")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {0: rows[0][1]} | {i: f"own{i}\nlast{i}\n{eight}" for i in range(1, 5)}
    assert got == want | {10: rows[5][1], 11: "x\ny", 12: f"{nine} more"}


def test_empty_table(no_docs):
    assert dedup_lines(no_docs).count() == 0
