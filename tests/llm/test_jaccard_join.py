import random

import pytest

from topicweir.llm.jaccard_join import block_keys, link_documents, shingles_of

WHITE = " \t\n\x0b\x0c\r"


def shingle_set(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else " " if c in WHITE else c for c in text or "").split(" ")
    words = [w for w in words if w]
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, share=80):
    """doc_id -> (sizes, component) by comparing all pairs."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= share * len(x | y):
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    return sorted(((d, len(x), None if d is None else find(d)) for d, x in sets), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        if rng.random() < 0.5:
            words[i] = rng.choice("pqrstuvw") * 2
        else:
            del words[i]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_components_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for size in (1, 2, 4, 5, 6, 9, 12, 20, 33, 60, 64, 70, 130, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for n in (0, 0, 1, 1, 2, 3, 5, 8):
            words = edited(rng, base, n) if size > n + 2 else base
            rows.append(" ".join(words))
        rows.append(" ".join(base + edited(rng, base, 1) if size > 3 else base))  # one that grew
        rows.append("\t".join(base).upper() + "\n")
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 3, 5, 8, 9, 10, 12, 20, 30, 40)]
    rows += [None, "", " \n", "solo", "É é", "É é", "é é"]
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)] + [(5, "same id one two three"), (5, "same id four five six"), (None, "solo"), (9, rows[9])]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, node int, key string").repartition(3)
    got = link_documents(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_key(seed):
    """The pigeonhole bound over sizes on both sides of every band."""
    rng = random.Random(seed)
    for _ in range(400):
        n = rng.choice([4, 5, 7, 8, 9, 13, 16, 17, 31, 32, 40, 63, 64, 65, 100, 127, 128, 150, 255, 256, 600])
        a = rng.sample(range(10**6), n)
        gone = rng.randrange(0, n // 4 + 1)
        b = a[gone:] + [10**6 + i for i in range(rng.randrange(0, n // 4 + 1))]
        x, y = (shingles_of(" ".join(f"{w}" for w in sorted(s)), 1) for s in (a, b))
        both = len(set(a) & set(b))
        if set(a) != set(b) and 100 * both >= 80 * len(set(a) | set(b)):
            assert set(block_keys(x)) & set(block_keys(y)), (n, gone)


def test_empty_table(no_docs):
    assert link_documents(no_docs).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = ("one two three four five six seven", "red green blue black white grey", "u v w x y z")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (5, c), (5, ""), (6, None), (6, c), (7, ""), (None, a)]
    got = sorted(map(tuple, link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert {r[0]: r[2] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, None: None}
