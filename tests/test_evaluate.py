from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from topicweir.operators import evaluate, report, training

PAIRS = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd")), min_size=1, max_size=60)


def brute(pairs):
    classes = sorted({x for p in pairs for x in p})
    table = {}
    for c in classes:
        tp = sum(t == c == p for t, p in pairs)
        predicted, support = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        pr, rc = (tp / predicted if predicted else 0), (tp / support if support else 0)
        table[c] = (pr, rc, 2 * pr * rc / (pr + rc) if pr + rc else 0, support)
    return table


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(PAIRS)
def test_metrics_match_brute_force(spark, pairs):
    p = spark.createDataFrame(pairs, "label string, prediction string")
    table = brute(pairs)
    got = {r["class"]: (r.precision, r.recall, r.f1) for r in evaluate.class_metrics(p).collect()}
    assert got.keys() == table.keys()
    for c in table:
        assert got[c] == pytest.approx(table[c][:3])
    hits = sum(t == q for t, q in pairs) / len(pairs)
    assert evaluate.accuracy(p).first()[0] == pytest.approx(hits)
    macro = evaluate.macro_metrics(p).first()
    means = [sum(v[i] for v in table.values()) / len(table) for i in range(3)]
    assert tuple(macro) == pytest.approx((hits, *means))
    cells = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(p).collect()}
    counts = Counter(pairs)
    assert cells == {(a, b): counts[a, b] for a in table for b in table}
    rows = {r.name: r for r in evaluate.classification_report(p).collect()}
    assert rows["accuracy"].f1 == pytest.approx(hits)
    weighted = sum(v[2] * v[3] for v in table.values()) / len(pairs)
    assert rows["weighted avg"].f1 == pytest.approx(weighted)
    assert rows["macro avg"].support == len(pairs)


def test_wide_and_models(spark):
    p = spark.createDataFrame([("m", "a", "a"), ("m", "b", "a"), ("n", "a", "b"), ("n", "b", "b")], "model string, label string, prediction string")
    rows = {r.label: (r.a, r.b) for r in evaluate.confusion_wide(p.filter("model = 'm'"), ["a", "b"]).collect()}
    assert rows == {"a": (1, 0), "b": (1, 0)}
    got = {r.model: (r.accuracy, round(r.f1_macro, 6)) for r in evaluate.compare_models(p).collect()}
    assert got == {"m": (0.5, 0.333333), "n": (0.5, 0.333333)}


def test_errors(spark):
    rows = [(1, "a", "b", "t" * 101, [0.25, 0.75]), (2, "a", "a", "ok", [1.0, 0.0]), (3, "b", "zz", "u" * 100, [0.5, 0.5])]
    p = spark.createDataFrame(rows, "doc_id int, label string, prediction string, text string, probs array<double>")
    found = evaluate.analyze_errors(p, classes=["a", "b"], probability="probs").orderBy("doc_id")
    one, three = found.collect()
    assert (one.true_prob, one.pred_prob, one.sample) == (0.25, 0.75, "t" * 100 + "...")
    assert (three.true_prob, three.pred_prob, three.sample) == (0.5, None, "u" * 100)
    shown = evaluate.top_errors(found, 1).collect()
    assert [(r.doc_id, r.true_prob, r.pred_prob) for r in shown] == [(1, "0.250", "0.750")]
    plain = evaluate.analyze_errors(p, text=None)
    assert evaluate.top_errors(plain).first().true_prob == "N/A" and "sample" not in plain.columns


def test_reports(spark):
    rows = [("a", 0.6, 1.0), ("a", 1.0, 2.0), ("b", 0.2, 0.0), ("未知", 0.0, 1.0), ("错误", 0.0, 0.0), ("odd", 2.5, 1.0)]
    r = spark.createDataFrame(rows, "subject string, confidence double, seconds double")
    got = report.subject_report(r, ["b", "a", "c"]).orderBy("ord").collect()
    assert [(x.subject, x.n) for x in got] == [("b", 1), ("a", 2), ("未知", 1), ("错误", 1)]
    assert got[1].percent == pytest.approx(100 / 3)
    s = report.confidence_summary(r).first()
    assert (s.avg_confidence, s.max_confidence, s.min_confidence) == pytest.approx((4.3 / 4, 2.5, 0.2))
    assert s.avg_known == pytest.approx(4.3 / 5)
    bins = {x.name: (x.n, x.percent) for x in report.confidence_histogram(r, False).collect()}
    assert bins == {"<50%": (1, 25.0), "50-70%": (1, 25.0)}
    assert {x.name: x.n for x in report.confidence_histogram(r, True).collect()}[">=100%"] == 2
    t = report.timing_summary(r).first()
    assert (t.total_seconds, t.avg_seconds, t.min_seconds, t.max_seconds, t.files) == (5.0, 1.25, 1.0, 2.0, 6)
    assert t.files_per_second == pytest.approx(1.2) and t.avg_seconds_all == pytest.approx(5 / 6)
    assert report.timing_summary(r.limit(1)).first().files_per_second is None


def test_missing_predictions_count_as_wrong(spark):
    p = spark.createDataFrame([(1, "a", "a"), (2, "b", "b"), (3, "a", None), (4, "b", None)], "doc_id int, label string, prediction string")
    assert evaluate.accuracy(p).first().accuracy == 0.5
    assert evaluate.macro_metrics(p).first().accuracy == 0.5
    cells = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(p).collect()}
    assert cells["a", evaluate.NO_CLASS] == 1 and cells["a", "a"] == 1 and sum(cells.values()) == 4
    assert {r.doc_id for r in evaluate.analyze_errors(p, text=None).collect()} == {3, 4}
    both = p.withColumnRenamed("prediction", "x")
    assert training.agreement_rate(both, "label", "x").first().agreement == 0.5
    assert training.distillation_accuracy(both.withColumn("y", both.x), "label", "x", "y").first().teacher_accuracy == 0.5
