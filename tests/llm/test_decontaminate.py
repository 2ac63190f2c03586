import hashlib
import random
import re

import pytest

from topicweir.llm.decontaminate import Automaton, decontaminate, find_leaks, leak_report, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_UPPER = {c: c + 32 for c in range(65, 91)}


def brute(text, items, window=10):
    """(n_words, hit word positions, items) straight from the definition."""
    words = WORD.findall((text or "").translate(ASCII_UPPER))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(ASCII_UPPER))
        size = min(window, len(own))
        for s in range(len(own) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[s : s + size]:
                    hit.update(range(at, at + size))
                    found.add(str(item))
    return len(words), hit, sorted(found)


def report(spark, docs, items, **blocks):
    d = spark.createDataFrame(docs, "doc_id long, text string, n_items int, `_x` string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in leak_report(find_leaks(d, i, **blocks)).collect()}


def same(got, docs, items):
    for doc_id, text, *_ in docs:
        n, hit, names = brute(text, items)
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


@pytest.mark.parametrize("blocks", [{}, {"block_bytes": 60, "pass_bytes": 100}])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_the_definition(spark, seed, blocks):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "É", "é", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 10, 14, 25]))) for i in range(8)] + [(100, None), (101, "--"), (102, ""), (9, "a b c")]
    items.append((55, items[0][1]))
    docs = [(i, text(rng.randrange(0, 60)), 1, "x") for i in range(25)]
    docs += [(100 + i, f"{text(4)}\n{b}. {text(3)}", 1, "x") for i, b in items if b]
    docs += [(300, None, None, None), (301, "", 0, ""), (302, "Zq zq", 0, "")]
    same(report(spark, docs, items, **blocks), docs, items)


def test_no_items_and_no_documents(spark, no_docs):
    docs = [(1, "one two", 0, "")]
    assert not report(spark, docs, [])[1].contaminated
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert leak_report(find_leaks(no_docs, items)).count() == 0


def test_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in leak_report(find_leaks(docs, items)).collect()}
    assert len(got) == docs.count()
    bench = [(r.item_id, r.text) for r in items.collect()]
    # The definition is quadratic: documents that share three words in a row with an item, and some that do not.
    grams = {tuple(w[i : i + 10]) for _, t in bench for w in [words_of(t)] for i in range(max(1, len(w) - 9))}
    for r in docs.collect():
        w = words_of(r.text)
        if any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9)) or r.doc_id % 40 == 0:
            n, hit, names = brute(r.text, bench)
            assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].n_items) == (n, len(hit), len(names))


def test_removal_leaves_the_rest_alone(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"Before, it. {item.upper()}! After.\nEnd"), (2, item), (3, "clean  text\n"), (4, None)], "doc_id long, text string"
    )
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate(docs, items, max_coverage=0.9).collect()}
    assert got == {1: "Before, it. ! After.\nEnd", 3: "clean  text\n", 4: None}


def test_automaton_of_nothing():
    assert Automaton([], 10).match([b"a"]) == ([], set())
