import hashlib
import random

import numpy as np
import pytest

from topicweir.llm.fm_index import FMIndex, WaveletMatrix
from topicweir.llm.substring_dedup import dedup_passages

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in WHITE else c for c in text or "").split(" ") if w]


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"window": 4, "gram": 2}, {"window": 5, "gram": 2, "shard": 40, "hot": 5}, {"window": 13, "gram": 5, "hot": 12}])
@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_windows(spark, sizes, seed):
    rng = random.Random(seed)
    text = lambda n, k=9: " ".join(rng.choice("abcdefghijkl"[:k]) for _ in range(n))
    passages = [text(n) for n in (13, 14, 20, 40)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 20))]
        parts += [rng.choice(passages) for _ in range(rng.randrange(0, 3))] + [text(rng.randrange(0, 9), 12)]
        rows.append((i * 7 % 61, "\n".join(parts)))
    rows += [(100, "a b " * 60), (101, "a b " * 40), (102, None), (103, ""), (None, passages[3]), (104, "\t".join(passages[3].split()))]
    rows += [(105, passages[3] + " x"), (105, passages[3] + " x"), (105, "y " + passages[2]), (106, "É " + passages[1] + " \x85z")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, `print` string").repartition(3)
    got = dedup_passages(df, **sizes)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, sizes["window"])


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, dedup_passages(docs).collect()), key=str) == brute([tuple(r) for r in docs.collect()], 13)


def test_empty_table(no_docs):
    assert dedup_passages(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_backward_search_counts_occurrences(seed):
    rng = np.random.default_rng(seed)
    sequences = [rng.integers(1, 5, size=rng.integers(3, 30)) for _ in range(12)]
    index = FMIndex(sequences, 4)
    patterns = rng.integers(1, 5, size=(80, 3))
    values = rng.integers(0, 100, size=12)
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        found = [k for k, s in enumerate(sequences) for i in range(len(s) - 2) if (s[i : i + 3] == p).all()]
        assert b - a == len(found)
        assert sorted(index.sequence[index.suffixes[a:b]].tolist()) == sorted(found)
    there = high > low
    want = [min(values[index.sequence[index.suffixes[a:b]]]) for a, b in zip(low[there], high[there])]
    assert index.least(low[there], high[there], values).tolist() == want


def test_rank_of_every_symbol():
    values = np.random.default_rng(1).integers(0, 9, size=300)
    matrix = WaveletMatrix(values, 8)
    for c in range(9):
        got = matrix.rank(np.full(301, c), np.arange(301))
        assert got.tolist() == np.r_[0, np.cumsum(values == c)].tolist()
