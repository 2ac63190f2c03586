import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_jaccard_join import edited, shingle_set
from topicweir.llm import minhash
from topicweir.llm.jaccard_join import shingles_of
from topicweir.llm.minhash import AGREEING, COORDINATES, band_keys, near_copies, sketch


def expected(rows):
    """By all pairs; rows of one id are one document."""
    sets = [(d, shingle_set(t, 2)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    return sorted(((d, len(x), *((None, None) if d is None else (find(d), find(d) == d))) for d, x in sets), key=str)


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_components_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 33, 64, 130, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for n in (0, 0, 1, 1, 2, 3, 5, 8):
            rows.append(" ".join(edited(rng, base, n) if size > n + 1 else base))
        rows.append("\t".join(base).upper() + "\n")
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 3, 5, 8, 9, 10, 12, 20, 30, 40) for _ in range(3)]
    rows += [None, "", " \n", "solo", "É é", "É é", "é é", "a b a b a b a", "b a b"]
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)] + [(None, "solo"), (9, rows[9])] + [(12, rows[4])] * 3
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, node int, key string").repartition(3)
    assert result(near_copies(df)) == expected(rows)


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = ("one two three four five six seven", "red green blue black white", "x y z")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (5, c), (5, ""), (6, None), (6, c), (7, "")]
    got = result(near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == expected(rows)
    assert {r[0]: r[2] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}


def test_a_key_of_many_unlinked_nodes(spark):
    """A passage in all texts, more of them than a tile holds, with a few links among them."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    tails = [[f"t{rng.randrange(10**6)}" for _ in range(30)] for _ in range(1300)]
    for i in range(0, 200, 2):
        tails[i + 1] = tails[i][:27] + ["q", "r", "s"]
    rows = [(i, passage + " " + " ".join(t)) for i, t in enumerate(tails)]
    rng.shuffle(rows)
    got = {r[0]: r[2] for r in result(near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))}
    assert got == {i: i - i % 2 if i < 200 else i for i in range(1300)}


def test_pairs_merely_alike_are_no_rows(spark, monkeypatch):
    """Texts all alike, but less than they would have to be: no step makes a row for each pair."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(72))
    tails = [[f"t{rng.randrange(10**6)}" for _ in range(14)] for _ in range(300)]
    for i in range(0, 40, 2):
        tails[i + 1] = tails[i][:10] + ["q", "r", "s", "t"]
    rows = [(i, passage + " " + " ".join(t)) for i, t in enumerate(tails)]
    made = {}

    class Counted(minhash.Scratch):
        def table(self, df, name):
            out = super().table(df, name)
            made[name] = out.count()
            return out

    monkeypatch.setattr(minhash, "Scratch", Counted)
    got = {r[0]: r[2] for r in result(near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))}
    assert got == {i: i - i % 2 if i < 40 else i for i in range(300)}
    assert made["star-alike"] > 200 and max(made.values()) <= 51 * 300


def test_partners_of_a_key_that_agree_by_chance_in_bytes_elsewhere():
    """Bytes of an earlier band may all agree where its key does not; the pair is still compared in this key."""
    sketch_bytes = bytes(range(256))
    shingles = list(range(100))
    rows = [(9, 0, 0, 0, node, node, 100, sketch_bytes, [*shingles[:95], *range(1000 * node, 1000 * node + 5)]) for node in (1, 2, 3)]
    rows.append((9, 0, 0, 0, 4, 4, 100, sketch_bytes, [*shingles[:60], *range(4000, 4040)]))
    names = ["key", "low", "high", "tile", "comp", "node", "size", "sketch", "shingles"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    near = list(minhash._with_partner(80)(iter([batch.slice(0, 1), batch.slice(1)])))
    assert sum(map(len, near)) == 4
    found = [tuple(r.values()) for b in minhash._joining(80)(iter(near)) for r in b.to_pylist()]
    assert found == [(1, 2), (1, 3)]


def test_a_pair_of_several_keys_is_taken_in_the_first_one():
    """Nodes that share many keys meet in each, but go on with their full sets from the first only."""
    sketch_bytes = bytes(range(256))
    keys = {1: [11, 12, 13], 2: [11, 12, 13], 3: [31, 12, 13], 4: [41, 42, 13]}
    names = ["key", "low", "high", "tile", "comp", "node", "size", "sketch", "keys"]
    kept = []
    for key in (11, 12, 13):
        rows = [(key, 0, 0, 0, node, node, 100, sketch_bytes, of) for node, of in keys.items() if key in of]
        for out in minhash._with_partner(80)(iter([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])])):
            unit = pa.Table.from_batches([out])
            node = out.column("node").to_pylist()
            kept += [(key, node[i], node[j]) for i, j in zip(*minhash._partners(unit, 80))]
    assert kept == [(11, 1, 2), (12, 1, 3), (12, 2, 3), (13, 1, 4), (13, 2, 4), (13, 3, 4)]


def test_rows_with_full_sets_are_few_in_a_group_of_near_copies(spark, monkeypatch):
    """Near copies of one text share many keys; their sets are not shipped once per key and tile."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 9))) for i in range(900)]
    seen = spark.sparkContext.accumulator(0)
    joining = minhash._joining

    def counted(share):
        run = joining(share)

        def count(batches):
            def each():
                for batch in batches:
                    seen.add(len(batch))
                    yield batch

            yield from run(each())

        return count

    monkeypatch.setattr(minhash, "_joining", counted)
    got = result(near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == expected(rows)
    assert 0 < seen.value < 16 * len(rows)


def test_sketches_fill_and_agree():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 17, 100, 1000, 5000):
        worst = COORDINATES
        for _ in range(30):
            words = [str(rng.random()) for _ in range(n * 9 // 8 + 1)]
            a, b = shingles_of(" ".join(words[:n]), 1), shingles_of(" ".join(words[-n:]), 1)
            flat, owner = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            s = sketch(flat, owner, 2)
            assert (s != np.uint64(2**64 - 1)).all()
            alone = sketch(b, np.zeros(len(b), np.int64), 1)  # does not depend on its neighbours
            assert (alone[0] == s[1]).all()
            share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs((s[0] == s[1]).mean() - share) < 0.2
            if share >= 0.8:
                keys, small = band_keys(s)
                worst = min(worst, (small[0] == small[1]).sum())
                assert (keys[0] == keys[1]).any()
        assert worst >= AGREEING


def test_odd_and_empty(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(near_copies(odd_docs)) == expected(rows)
    assert near_copies(no_docs).count() == 0
