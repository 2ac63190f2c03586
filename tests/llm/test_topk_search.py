import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweir.llm import topk_search
from topicweir.llm.topk_search import candidates_for, top_k


def brute(rows, k, every):
    good = {
        (i, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for q, qv in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 0.05, 2.0])
@pytest.mark.parametrize("block", [16, 4096])
def test_against_all_products(spark, spread, block):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 8))
    vectors = [(centers[i % 5] + rng.normal(size=8) * 0.2) * np.exp(rng.normal() * spread) for i in range(150)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # one vector many times: ties
    rows += [(300, None), (310, [1.0, None] + [0.0] * 6), (320, [float("nan")] * 8), (330, [float("inf")] * 8)]
    rows += [(340, [0.0] * 8), (350, []), (360, [1.0, 2.0]), (10, rows[10][1]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, score int, `rank` int").repartition(3)
    got = top_k(df, F.col("vec_id") % 10 == 0, block=block, query_block=7, seeds=40)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10)


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(one, F.col("vec_id") == 0).collect()] == [(0, 1, 1, -65536)]
    assert top_k(one.limit(0), F.col("vec_id") == 0).count() == 0


def test_pruning_keeps_all_that_reach_the_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        block = rng.integers(-300, 300, size=(60, 6)) * rng.integers(1, 4, size=(60, 1))
        query = rng.integers(-300, 300, size=6)
        lengths = np.sqrt((block.astype(float) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        block, lengths = block[order], lengths[order]
        scores = block @ query
        least = float(np.sort(scores)[-5])
        assert set(np.flatnonzero(scores >= least)) <= set(candidates_for(query, least, block, lengths).tolist())


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_tiles_meet_groups_of_queries(spark, monkeypatch, spread):
    monkeypatch.setattr(topk_search, "GROUP", 12)
    monkeypatch.setattr(topk_search, "LEAST_BLOCKS", 2)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=5) * np.exp(rng.normal() * spread)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = top_k(df, F.col("vec_id") % 4 == 0, block=16, query_block=6, seeds=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4)
    # A matrix never stands beside another in a row, so rows and batches do not grow by pairs of blocks.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert not any("mapInPandas" in line or "MapInPandas" in line for line in plan.split("\n"))


def test_products_are_exact_in_the_narrowest_type():
    rng = np.random.default_rng(9)
    for top in (100, 10**5, 10**8):
        one, many = rng.integers(-top, top, size=(7, 6)), rng.integers(-top, top, size=(9, 4))
        assert (topk_search._cross(one, many).astype(np.int64) == one[:, :4] @ many.T).all()
        stored = topk_search._stored(many)
        assert (topk_search._loaded(stored, 9, 4) == many).all()
    assert topk_search._cross(np.ones((1, 3), int), np.ones((2, 3), int)).dtype == np.float32
    assert len(topk_search._stored(np.ones((2, 3), int))) == 12
