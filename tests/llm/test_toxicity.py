import random
import zlib

import numpy as np

from topicweir.llm.toxicity import features_of, fit, labelled_rows, score, swapped, toxicity_report, words_of


def auc(labels, scores):
    good = [s for y, s in zip(labels, scores) if y]
    bad = [s for y, s in zip(labels, scores) if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def made(rng, n):
    """Texts of which some hold a bad word; group names stand in bad and good ones."""
    rows = []
    for i in range(n):
        words = [rng.choice(["river", "stone", "cloud", "lamp", "paper", "glass", "music"]) + rng.choice("abcdef") for _ in range(30)]
        bad = rng.random() < 0.4
        if bad:
            words.insert(rng.randrange(30), rng.choice(["vilka", "vilko", "gromp"]))
        if rng.random() < (0.7 if bad else 0.2):
            words.insert(0, rng.choice(["muslims", "women"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = made(random.Random(0), 900)
    docs = [(i, t, "x", 1.0) for i, t, _ in rows] + [(5000, None, None, None), (5001, "", "", 0.0), (None, "vilka", "x", 0.0), (5, rows[5][1], "x", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, words string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, rows[5][2]), (8000, 1), (None, 1), (5001, None)], "doc_id long, toxic int")
    scored = score(df, labels)
    assert scored.columns == ["doc_id", "text", "words", "score", "_score"]
    got = toxicity_report(scored).collect()
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert auc([truth[r.doc_id] for r in held], [r.score for r in held]) > 0.98
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.95


def test_learns_nothing_from_the_held_out_fold(spark):
    rows = made(random.Random(1), 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    usable = labelled_rows(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert usable.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows)


def test_the_penalty_takes_weight_off_group_names():
    rows = made(random.Random(2), 600)
    names = {}
    code = lambda ws: [names.setdefault(f, len(names)) for w in sorted(ws) for f in features_of(w)]
    coded = []
    for _, text, y in rows:
        words = words_of(text)
        other = swapped(words)
        coded.append((y, code(words), code(words - other), code(other - words)))
    change = lambda w: np.mean([abs(sum(w[g]) - sum(w[q])) for _, _, q, g in coded if q or g])
    free, _ = fit(coded, len(names), 0.0)
    held, _ = fit(coded, len(names), 10.0)
    assert change(held) < 0.3 * change(free)


def test_without_labels_and_without_documents(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.score for r in toxicity_report(score(docs, labels)).collect()] == [0.5]
    assert score(no_docs, labels).count() == 0
