import random

import pytest

from conftest import plan_of
from topicweir.operators import similarity
from topicweir.operators.similarity import similar_pairs
from topicweir.runtime import literal_array


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.8, 1.0])
def test_all_pairs_above_the_threshold(spark, threshold):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "abcd" for b in "xyz" for c in "mnopqr"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [rng.choices(words, weights, k=rng.randrange(0, 25)) for _ in range(70)]
    texts += [t + rng.choices(words, k=2) for t in texts[:25]] + texts[:5] + [["the", "of"], []]
    rows = [(i, None if i == 3 else " ".join(t)) for i, t in enumerate(texts)]
    left = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(rows[::3], "item_id long, text string")
    sets = {i: set((t or "").split()) - {"the"} for i, t in rows}
    want = {}
    for a, x in sets.items():
        for b in list(sets)[::3]:
            y = sets[b]
            if x and y and len(x & y) / len(x | y) >= threshold:
                want[a, b] = len(x & y) / len(x | y)
    got = {(r.doc_id, r.item_id): r.similarity for r in similar_pairs(left, right, threshold).collect()}
    assert {k: v for k, v in got.items() if k[0] != 100} == pytest.approx({k: v for k, v in want.items() if k[0] != 100})
    assert similar_pairs(left.limit(0), right, threshold).count() == 0


def test_threshold_range(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    for bad in (0, 1.1):
        with pytest.raises(ValueError):
            similar_pairs(df, df, bad)


def test_a_right_table_too_large_to_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(f"word{chr(97 + (i * k) % 11)}" for k in range(6))) for i in range(40)]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    right = spark.createDataFrame(rows[::2], "item_id long, text string")
    want = sorted(map(tuple, similar_pairs(left, right, 0.5).collect()))
    monkeypatch.setattr(similarity, "BROADCAST", 0)
    assert want and sorted(map(tuple, similar_pairs(left, right, 0.5).collect())) == want


def test_prefixes_without_a_shuffle_and_without_tokens_of_one_side(spark):
    one = spark.createDataFrame([(1, ["a", "b", "c", "d"], 4), (2, ["a", "b"], 2), (3, ["x"], 1)], "id long, tokens array<string>, size int")
    two = spark.createDataFrame([(7, ["b", "a", "y"], 3)], "id long, tokens array<string>, size int")
    order = literal_array(similarity._order(one, two), "int")
    rows = similarity._prefixes(one, order, 0.5)
    assert "Exchange" not in plan_of(rows)
    # c and d are on one side only, so they come first, and no partner can hold them
    assert sorted((r.id, r.token) for r in similarity._prefixes(one, order, 0.1).collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert len(rows.collect()) == 3 and {r.id for r in rows.collect()} == {1, 2}


def test_repeated_rows_lose_no_pair(spark):
    """A row that stands twice has its pairs twice, as in the SQL; its tokens are not taken for twice as many."""
    words = [f"word{c}" for c in "abcdefghijkl"]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:6]))]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    right = spark.createDataFrame([(7, " ".join([*words[6:], "other", "more"]))], "item_id long, text string")
    got = sorted(map(tuple, similar_pairs(left, right, 0.3).collect()))
    assert got == [(1, 7, pytest.approx(6 / 14)), (1, 7, pytest.approx(6 / 14))]
