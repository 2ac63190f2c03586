"""Counterfactually regularised toxicity classifier.

A logistic model over the distinct words of a text and the stems of these words. For every
labelled text that names a group of people, the group is swapped for another of its kind, and
the squared change of the model's margin is penalised, so that neutral mentions of a group move
no score. The model is fitted on at most `max_rows` labelled rows; which ones are taken depends
on a hash of their ids alone. All texts are scored whole.
"""

import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from topicweir.llm.common import Recent, tidy
from topicweir.runtime import Scratch

MAX_ROWS = 12_000
MAX_FEATURES = 50_000
MIN_USES = 4
MIN_Z = 2.5
THRESHOLD = 0.7
SWAP_PENALTY = 1.0
STEMS = (3, 4, 5)

# Words that name groups of people, in groups that can stand for each other.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["she", "he"],
    ["her", "his"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer"],
    ["black", "white", "asian", "latino", "african", "european", "american", "arab"],
    ["immigrants", "natives", "foreigners", "refugees", "citizens"],
    ["old", "young", "elderly", "disabled", "blind", "deaf"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
]

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swapped(words: set[str], terms=None) -> set[str]:
    """`words` with every identity term replaced by the next one of its group."""
    following = {w: g[(i + 1) % len(g)] for g in terms or IDENTITY_TERMS for i, w in enumerate(g)}
    return {following.get(w, w) for w in words}


def features_of(word: str) -> list[str]:
    """The word and its stems; stems end in a mark that no word has."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


def _sample(batches):
    """Labelled texts -> their words, and the words that a swap takes away and brings."""
    import pyarrow as pa

    for batch in batches:
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        other = [swapped(w) for w in words]
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("toxic"),
                pa.array([sorted(w) for w in words], strings),
                pa.array([sorted(w - o) for w, o in zip(words, other)], strings),
                pa.array([sorted(o - w) for w, o in zip(words, other)], strings),
            ],
            names=["toxic", "words", "lost", "gained"],
        )


def _coded(vocabulary: dict[str, int]):
    """Words -> feature numbers, repeated as often as words have them."""

    def run(batches):
        import pyarrow as pa

        def codes(lists):
            return pa.array(
                [[n for w in ws for f in features_of(w) if (n := vocabulary.get(f)) is not None] for ws in lists.to_pylist()],
                pa.list_(pa.int32()),
            )

        for b in batches:
            names = ["words", "lost", "gained"]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(codes(b.column(n)) for n in names)], names=["toxic", *names])

    return tidy("toxicity", run)


def fit(rows, n_features: int, penalty: float, rounds: int = 250, decay: float = 3e-5, rate: float = 0.05):
    """Weights and intercept by Adam; rows are (label, words, lost, gained) as feature numbers."""
    labels = np.array([r[0] for r in rows], dtype=float)

    def flat(k):
        sizes = [len(r[k]) for r in rows]
        return np.repeat(np.arange(len(rows)), sizes), np.array([f for r in rows for f in r[k]], dtype=np.int64)

    row, column = flat(1)
    row_l, column_l = flat(2)
    row_g, column_g = flat(3)
    n = len(rows)
    pairs = max(1, len(set(row_l) | set(row_g)))
    w, b = np.zeros(n_features + 1), 0.0
    first, second = np.zeros(n_features + 2), np.zeros(n_features + 2)
    for turn in range(1, rounds + 1):
        margin = b + np.bincount(row, w[column], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels) / n
        change = np.bincount(row_g, w[column_g], minlength=n) - np.bincount(row_l, w[column_l], minlength=n)
        pull = 2 * penalty * change / pairs
        grad = np.bincount(column, error[row], minlength=n_features + 1) + decay * w
        grad += np.bincount(column_g, pull[row_g], minlength=n_features + 1)
        grad -= np.bincount(column_l, pull[row_l], minlength=n_features + 1)
        grad = np.append(grad, error.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        step = rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w[:n_features], float(b)


def train(
    labelled: DataFrame, max_features: int = MAX_FEATURES, penalty: float = SWAP_PENALTY, min_uses: int = MIN_USES
) -> tuple[dict[str, float], float]:
    """Feature weights and intercept from a frame of bounded size with `text` and `toxic`.

    Features are taken that words of the rows have `min_uses` times or more and whose share of toxic rows is at least
    MIN_Z standard errors off. Without any row, or with one label only, every score is the share of
    toxic rows (a half without rows).
    """
    with Scratch(labelled.sparkSession, "toxicity") as scratch:
        sample = scratch.table(
            labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(
                tidy("toxicity", _sample), "toxic int, words array<string>, lost array<string>, gained array<string>"
            ),
            "sample",
        )
        n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        share = (positive + 1) / (n + 2)
        prior = float(np.log(share / (1 - share)))
        if positive in (0, n):
            return {}, prior
        stems = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("~"))) for k in STEMS]
        seen = (
            sample.select("toxic", F.explode("words").alias("word"))
            .select("toxic", F.explode(F.array("word", *stems)).alias("feature"))
            .filter("feature IS NOT NULL")
        )
        z = (F.col("bad") - F.col("uses") * (positive / n)) / F.sqrt(F.col("uses") * (positive / n * (1 - positive / n)))
        chosen = (
            seen.groupBy("feature")
            .agg(F.count("*").alias("uses"), F.sum("toxic").alias("bad"))
            .withColumn("z", F.abs(z))
            .filter((F.col("uses") >= min_uses) & (F.col("z") >= MIN_Z))
            .orderBy(F.desc("z"), "feature")
            .limit(max_features)
            .select("feature")
        )
        vocabulary = {r.feature: i for i, r in enumerate(chosen.collect())}
        coded = sample.mapInArrow(_coded(vocabulary), "toxic int, words array<int>, lost array<int>, gained array<int>")
        weights, intercept = fit([tuple(r) for r in coded.collect()], len(vocabulary), penalty)
        return {f: float(weights[i]) for f, i in vocabulary.items()}, intercept


def _score(weights: dict[str, float], intercept: float):
    def run(batches):
        import pyarrow as pa

        get = weights.get
        known = Recent(lambda word: sum(get(f, 0.0) for f in features_of(word)), 100_000)
        for batch in batches:
            margins = []
            for text in batch.column("text"):
                words = words_of(text.as_py() or "")
                # Summed in one order, so that equal texts have equal scores.
                margins.append(intercept + float(np.sum(np.sort(np.fromiter(map(known.__getitem__, words), float, len(words))))))
            scores = 1 / (1 + np.exp(-np.clip(np.array(margins, dtype=float), -40, 40)))
            names = [n for n in batch.schema.names if n != "_score"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(scores, pa.float64())], names=[*names, "_score"])

    return tidy("toxicity", run)


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """`text` and `toxic` of at most about `max_rows` labelled documents outside the held-out fold."""
    usable = labels.filter((fold("doc_id") != 1) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    # A share of the hash range, so that the sample needs no sort.
    share = min(1.0, 0.95 * max_rows / max(1, total))
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Of proven size: at most max_rows pairs of id and label.
    return docs.select("doc_id", "text").join(F.broadcast(usable.limit(max_rows)), "doc_id").select("text", "toxic")


def score(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """`docs` with `_score` from 0 to 1, learnt from `labels` (doc_id, toxic) of `training_docs`.

    All columns of `docs` stay but one named `_score`, which is replaced; `doc_id` and `text` are needed. Null texts score as empty ones.
    Repeated rows score alike; of several labels of one id the toxic one counts; ids without label
    and null labels teach nothing.
    """
    weights, intercept = train(labelled_rows(training_docs if training_docs is not None else docs, labels, max_rows))
    schema = docs.drop("_score").withColumn("_score", F.lit(0.0)).schema
    return docs.mapInArrow(_score(weights, intercept), schema)


def toxicity_report(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
