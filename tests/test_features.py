import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.ml.linalg import Vectors

from topicweir.config import TrainSettings
from topicweir.operators import features
from topicweir.sources.dictionary import KeywordDictionary

WORDS = KeywordDictionary.of({"a": ["DNA", "cell"], "b": ["x y"]})


def brute_vocabulary(texts, top, n_max=4, min_df=2, max_df=0.9):
    tf, df = Counter(), Counter()
    for t in texts:
        toks = re.findall(r"\b\w\w+\b", t.lower())
        grams = [" ".join(toks[i : i + n]) for n in range(1, n_max + 1) for i in range(len(toks) - n + 1)]
        tf.update(grams)
        df.update(set(grams))
    kept = [g for g in tf if min_df <= df[g] <= max_df * len(texts)]
    return sorted(sorted(kept, key=lambda g: (-tf[g], g))[:top]), tf, df


@pytest.mark.parametrize("top", [5, 40, 10_000])
@pytest.mark.parametrize("buckets", [1 << 12, 64], ids=["roomy", "crowded"])
@pytest.mark.parametrize("n_max", [1, 2, 4])
def test_vocabulary_equals_brute_force(spark, monkeypatch, top, buckets, n_max):
    monkeypatch.setattr(features, "LEAST_BUCKETS", buckets)
    monkeypatch.setattr(features, "BUCKETS_PER_TERM", 1)
    rng = random.Random(top)
    # one phrase is in most documents, a rare one repeats inside a single document
    texts = [
        " ".join(rng.choice(["alpha beta gamma delta", "x", "zeta", "eta theta", f"w{rng.randrange(9)}"]) for _ in range(rng.randrange(12)))
        for _ in range(60)
    ] + ["solo act " * 30, "", "Alpha BETA"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = features.fit_vocabulary(df, ngram_max=n_max, max_features=top)
    terms, tf, doc = brute_vocabulary(texts, top, n_max)
    assert list(got.terms) == terms
    assert [(a, b) for a, b in zip(got.tf, got.df)] == [(tf[t], doc[t]) for t in terms]


def test_tasks_hand_on_counts_and_not_places(monkeypatch):
    monkeypatch.setattr(features, "SLICE", 7)
    rows = [["a", "b", "c"], [], ["a", "b", "c", "a", "b"] * 4, ["c"], ["ab", "c"]] * 3
    batch = features.pa.RecordBatch.from_arrays([features.pa.array(rows, features.pa.list_(features.pa.string()))], names=["_n1"])
    grams = [[tuple(r[i : i + n]) for n in (1, 2, 3) for i in range(len(r) - n + 1)] for r in rows]
    (buckets,) = features._bucket_counts(3, 64)([batch, batch])
    assert len(set(buckets["bucket"].to_pylist())) == len(buckets) <= len({g for gs in grams for g in gs})
    assert sum(buckets["n"].to_pylist()) == 2 * sum(map(len, grams))
    tf, df = Counter(), Counter()
    for counted in features._marked_grams({n: range(64) for n in (1, 2, 3)}, 64)([batch]):
        for r in counted.to_pylist():
            tf[r["term"]] += r["tf"]
            df[r["term"]] += r["df"]
    assert tf == Counter(" ".join(g) for gs in grams for g in gs)
    assert df == Counter(" ".join(g) for gs in grams for g in set(gs))


def test_no_terms_is_an_error(spark):
    with pytest.raises(ValueError):
        features.fit_vocabulary(spark.createDataFrame([("one",), ("two",)], "text string"))


def test_tfidf_weights(spark):
    texts = ["red blue red", "blue green", "red green green", "sky"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    vocabulary = features.fit_vocabulary(df, ngram_max=1)
    assert vocabulary.terms == ("blue", "green", "red")
    out = features.tfidf_transform(df, vocabulary).orderBy("doc_id").collect()
    idf = math.log(5 / 3) + 1
    first = np.array([idf, 0, 2 * idf])
    assert out[0].tfidf.toArray() == pytest.approx(first / np.linalg.norm(first))
    assert out[3].tfidf.numNonzeros() == 0
    assert out[0].asDict().keys() == {"doc_id", "text", "tfidf"}


CHARS = st.text(alphabet=st.sampled_from("aZé 1٣数!—\t\n_　."), max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(CHARS, min_size=1, max_size=30))
def test_stats_match_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = features.stat_features(df).orderBy("i").collect()
    for text, row in zip(texts, rows):
        n = len(text)
        counts = [len(re.findall(p, text)) for p in (r"[一-鿿]", "[a-zA-Z]", r"\d", r"[^\w\s]")]
        words = len(text.split())
        want = [n, words, n / max(words, 1), *counts, *[c / max(n, 1) for c in counts[:3]]]
        assert [row[name] for name in features.STAT_NAMES] == pytest.approx(want)


def test_keyword_features_keep_case(spark):
    df = spark.createDataFrame([("dna Cell x y",), (None,)], "text string")
    got = [r.keyword_counts for r in features.keyword_features(df, WORDS).collect()]
    assert got == [[1, 1], [0, 0]]
    assert features.keyword_features(df, WORDS, lower_keywords=True).first().keyword_counts == [2, 1]
    light = features.light_features(df, WORDS, 5).first().light
    assert light == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert features.light_features(df, WORDS, 1).first().light == [1.0]


def test_attach_embeddings(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    vectors = spark.createDataFrame([(1, [0.5, 1.5])], "vec_id long, embedding array<float>")
    got = {r.doc_id: (r.embedding, r.has_embedding) for r in features.attach_embeddings(docs, vectors, 2).collect()}
    assert got == {1: ([0.5, 1.5], True), 2: ([0.0, 0.0], False)}


def test_variance_topk_and_selection(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) * [1, 5, 0, 3, 5, 2] + [1e4, 0, 7, 0, 0, 0]
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["i", "features"]).repartition(5)
    top = features.variance_topk(df, 3).orderBy("rank").collect()
    want = np.argsort(-x.var(axis=0), kind="stable")[:3]
    assert [r.idx for r in top] == list(want)
    assert [r.variance for r in top] == pytest.approx(list(x.var(axis=0)[want]))
    chosen = features.apply_selection(df, [r.idx for r in top]).filter("i = 0").first().selected
    assert chosen.toArray() == pytest.approx(x[0][want])


def test_importance(spark):
    weights = spark.createDataFrame([(0, 0, -1.0), (1, 0, 3.0), (0, 1, 0.5), (1, 1, 0.5)], "class int, feature int, value double")
    got = {r.name: r.importance for r in features.feature_importance(weights, ["p", "q"]).collect()}
    assert got == {"p": 2.0, "q": 0.5}
    assert features.feature_importance(weights, ["p"]).count() == 0


def corpus(spark):
    texts = [("cell wall cell division" if i % 2 else "forward motion and force") + f" w{i % 5}" for i in range(40)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_feature_model_is_stable_on_new_rows(spark):
    df = corpus(spark)
    model = features.fit_features(df, WORDS, cfg=TrainSettings(max_features=10))
    out = model.transform(df).collect()
    assert {r.features.size for r in out} == {len(model.names)} == {10 + 10 + 2}
    new = spark.createDataFrame([(1, "unseen words only"), (2, None)], "doc_id int, text string")
    assert {r.features.size for r in model.transform(new).collect()} == {22}


def test_feature_selection_is_part_of_the_model(spark):
    df = corpus(spark)
    model = features.fit_features(df, WORDS, cfg=TrainSettings(max_features=20, selected_features=4))
    assert len(model.names) == 4 and "text_length" in model.names
    full = features.FeatureModel(model.vocabulary, WORDS).transform(df).orderBy("doc_id").first().features.toArray()
    assert model.transform(df).orderBy("doc_id").first().features.toArray() == pytest.approx(full[list(model.selected)])


def test_counting_filter_bounds_what_is_counted(spark, monkeypatch):
    """With many features and no document limit few more n-grams are counted than stay."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(10**6)}" for _ in range(60)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = []
    inner = features._term_counts

    def spy(rows, grams):
        out = inner(rows, grams)
        counted.append(out.count())
        return out

    monkeypatch.setattr(features, "_term_counts", spy)
    got = features.fit_vocabulary(df, min_df=1, max_df=1.0, max_features=1000)
    terms, tf, _ = brute_vocabulary(texts, 1000, 4, 1, 1.0)
    assert list(got.terms) == terms
    assert sum(counted) <= 12 * 1000 < len(tf) / 4


def test_transform_hashes_as_the_jvm_does(spark):
    texts = ["straße été 東京都 naïve straße été", "été 東京都 naïve été 東京都"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocabulary = features.fit_vocabulary(df, min_df=1, max_df=1.0)
    rows = features.vector_entries(features.tfidf_transform(df, vocabulary), "tfidf", vocabulary.terms, ["text"]).collect()
    toks = [t.split() for t in texts]
    grams = [{" ".join(t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1)} for t in toks]
    assert {(r.text, r.term) for r in rows} == {(t, g) for t, gs in zip(texts, grams) for g in gs}


def test_entries_and_variance_of_sparse_vectors(spark):
    rows = [(0, Vectors.sparse(5, {1: 2.0, 3: 0.0})), (1, Vectors.dense([0.0, 4.0, 0.0, 0.0, 1.0])), (2, Vectors.sparse(5, {}))]
    df = spark.createDataFrame(rows, ["i", "features"]).repartition(2)
    got = df.select("i", features.F.inline(features.entries("features"))).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2.0), (1, 1, 4.0), (1, 4, 1.0)]
    x = np.array([r[1].toArray() for r in rows])
    top = features.variance_topk(df, 5).orderBy("rank").collect()
    assert [r.idx for r in top] == [1, 4, 0, 2, 3]
    assert [r.variance for r in top] == pytest.approx(list(x.var(axis=0)[[1, 4, 0, 2, 3]]))
    assert features.variance_topk(df.limit(0), 3).count() == 0


def test_tfidf_walks_paths_of_tokens(spark):
    texts = ["a1 b1 c1 d1 e1", "b1 c1 d1", "a1 b1 x a1 b1 c1", None, "", "C1 d1 zz b1 c1", "a1 b1 c1 d1 a1 b1 c1 d1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    terms = ("a1", "a1 b1 c1", "b1 c1", "c1", "b1 c1 d1 e1", "e1", "q1 a1")
    vocabulary = features.Vocabulary(terms, (1,) * 7, (1, 2, 3, 4, 1, 2, 1), 9, 4)
    out = features.tfidf_transform(df, vocabulary)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "CountVectorizer" not in plan
    idf = [math.log(10 / (1 + d)) + 1 for d in vocabulary.df]
    for row in out.orderBy("doc_id").collect():
        words = [w for w in (texts[row.doc_id] or "").lower().split() if len(w) > 1]
        grams = Counter(" ".join(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
        want = np.array([grams[t] * w for t, w in zip(terms, idf)])
        assert row.tfidf.toArray() == pytest.approx(want / (np.linalg.norm(want) or 1.0))
    few = features._weigher(terms, idf)
    slices, features._token_slices.__defaults__ = features._token_slices.__defaults__, (3,)
    try:
        import pyarrow as pa

        lists = pa.array([(t or "").lower().split() for t in texts], pa.list_(pa.string()))
        got = few(lists).to_pylist()
    finally:
        features._token_slices.__defaults__ = slices
    assert [len(r["indices"]) for r in got] == [r.tfidf.numNonzeros() for r in out.orderBy("doc_id").collect()]
