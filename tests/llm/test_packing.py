import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicweir.llm import packing
from topicweir.llm.packing import best_pattern, cutting_stock, fullest, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, packed, limit):
    """Every id in one piece, gapless sequences of at most `limit`; gives the padding."""
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((r.doc_id, ids))
    rows = packed.collect()
    left = {}
    for r in rows:
        assert r.length > 0
        left.setdefault((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens), []).append(r)
    total = 0
    for doc_id, ids in want:
        at = 0
        while at < len(ids):
            key = next(
                k for k in left if left[k] and k[0] == doc_id and k[1] == at and k[4] == len(ids)
                and k[3] == zlib.crc32(ids[at : at + k[2]].tobytes())
            )
            left[key].pop()
            at += key[2]
        assert at == len(ids)
        total += at
    assert not any(left.values())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding, total


@pytest.mark.parametrize("limit,units,filler", [(64, 16, 4), (128, 128, 8), (4096, 256, 16)])
def test_every_id_once_and_little_padding(spark, sf, limit, units, filler):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).repartition(3)
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3)
    padding, total = check(docs, pack(docs, PATH, limit=limit, units=units, filler=filler), limit)
    assert padding <= 0.01 * total + limit


@pytest.mark.parametrize("others", [350, 3000])
def test_a_third_of_all_rows_a_little_over_half_a_sequence(spark, others):
    text = lambda n, i: " ".join(["the"] * (n - 2) + [f"{'abcdefghij'[i % 10]}"])
    rows = [(i if i % 5 else None, text(2100, 0) if i % 3 == 0 else text(others - i % 7, i)) for i in range(150)]
    rows += [rows[3], rows[3], (rows[6][0], text(2090, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")
    packed = pack(docs, PATH)
    padding, total = check(docs, packed, 4096)
    assert padding == 0
    assert packed.select("sequence_id").distinct().count() <= total // 4096 + 12


def test_sequences_given_up_are_the_emptiest():
    cuts = [(3, np.array([0, 0, 1, 0])), (2, np.array([4, 0, 0, 0])), (1, np.array([0, 1, 0, 0]))]
    kept = fullest(cuts, 4)
    assert [(t, p.tolist()) for t, p in kept] == [(2, [4, 0, 0, 0]), (2, [0, 0, 1, 0])]
    assert fullest(cuts, 0) == []


def test_odd_texts_and_repeated_rows(odd_docs):
    check(odd_docs, pack(odd_docs, PATH, limit=64, units=16, filler=3), 64)


def test_empty_table(no_docs):
    assert pack(no_docs, PATH).count() == 0


def test_knapsack_matches_enumeration():
    prices = np.array([0.1, 0.35, 0.3, 0.62, 0.0, 0.9])
    best = [0.0] * 7
    for room in range(1, 7):
        best[room] = max([best[room - 1], *(best[room - c - 1] + prices[c] for c in range(room))])
    value, counts = best_pattern(prices)
    assert value == pytest.approx(best[6])
    assert (counts * prices).sum() == pytest.approx(value) and (counts * np.arange(1, 7)).sum() <= 6


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_the_demand_and_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 200, size=64)
    demand[rng.integers(0, 64, size=20)] = 0
    cuts = cutting_stock(demand)
    assert (sum(t * p for t, p in cuts) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for _, p in cuts)
    widths = np.arange(1, 65)
    bound = max((demand * widths).sum() / 64, demand[widths > 32].sum())
    assert sum(t for t, _ in cuts) <= 1.12 * bound + 64


def test_no_demand():
    assert cutting_stock(np.zeros(8, dtype=np.int64)) == []


def test_words_are_held_once_for_all_their_chunks(monkeypatch):
    from topicweir.llm import common

    made = []
    monkeypatch.setattr(packing, "Recent", lambda make, size: made.append(common.Recent(make, size)) or made[-1])
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 4)
    ids_of = packing._build_word_ids(PATH, 2)
    text = "Straße straße, STRASSE. word Word word, WORD. a.b , . 12, 東京  été\nété, Été. ẞ İ"
    tokenizer = common.load_tokenizer(PATH, "packing")
    for _ in range(3):
        assert np.frombuffer(ids_of(text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert len(made) == 1
