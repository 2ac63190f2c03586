import random
import zlib
from collections import Counter

from topicweir.llm.spelling import intervals, variant_forms

LETTERS = {chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]}


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c in LETTERS else " " for c in low).split(" ")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damage=None):
    counts = Counter()
    for d, text in rows:
        for w in filter(None, words_of(text)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def test_intervals_cover_each_place_once():
    for length in range(1, 70):
        assert sorted(p for i, j in intervals(length) for p in range(i, j)) == list(range(length))
        assert all(j - i <= 2 for i, j in intervals(length))


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("aabcé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "ababa", "common" * 6]
    for w in list(base):
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            base.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ") + w[i:], w[:i] + rng.choice("abÀ") + w[i + 1 :]]))
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choice([str, str.upper])(w) if rng.random() < 0.1 else w for w in rng.choices(base, k=60)) + ". Ünder_score's 4x"))
    rows += [(None, " ".join(base)), (3, None), (4, ""), (5, "...")] + rows[:3]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert got(variant_forms(df)) == brute(rows)
    assert got(variant_forms(df, damage=7)) == brute(rows, 7)


def test_one_prefix_in_all_words(spark):
    """Words that share all but their last code points, and forms that chain."""
    many = [f"prefix{a}{b}" for a in "abcdefghijkl" for b in "mnopqrstuvwxyzé"]
    chain = ["chainx"] * 3 + ["chainxy"] * 7 + ["chainxyz"] * 15 + ["chainxyzz"] * 40 + ["tiesa"] * 3 + ["tiesb"] * 6 + ["tiesc"] * 6
    rows = [(i, " ".join(many * (1 + i) + chain)) for i in range(3)]
    result = got(variant_forms(spark.createDataFrame(rows, "doc_id long, text string")))
    assert result == brute(rows)
    assert {r[0]: r[2] for r in result}["chainx"] == "chainxyzz"
    assert {r[0]: r[1] for r in result}["tiesa"] == "tiesb"


def test_odd_and_empty(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(variant_forms(odd_docs)) == brute(rows)
    long = [(1, "z" * 3000 + " " + "z" * 2999), (2, "z" * 3000 + " " + "z" * 2999), (3, "z" * 3000 + " " + "z" * 2999 + "q")] * 2
    assert got(variant_forms(spark.createDataFrame(long, "doc_id long, text string"))) == brute(long)
    assert variant_forms(no_docs).count() == 0
