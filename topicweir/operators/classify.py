"""Keyword, model and combined classification of a text column. All narrow: no shuffle."""

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from topicweir.config import ClassifySettings
from topicweir.functions.fixed_values import SLIDES_KEYWORD_ONLY, UNKNOWN
from topicweir.functions.matching import keyword_counts
from topicweir.functions.scores import arg_max
from topicweir.operators.extraction import deck_text
from topicweir.runtime import write_once
from topicweir.sources.dictionary import KeywordDictionary

DEFAULTS = ClassifySettings()


def _best(counts: Column, chars: Column, dictionary: KeywordDictionary, cfg: ClassifySettings) -> Column:
    """Struct (score, -position, subject) of the best subject; the earlier one wins a tie."""
    factor = F.when(chars > cfg.long_text_chars, cfg.long_text_factor).otherwise(1.0)
    options = [
        F.struct(
            F.least(F.get(counts, F.lit(i)) / F.lit(max(len(kws), 1)) * factor, F.lit(1.0)).alias("score"),
            F.lit(-i).alias("rank"),
            F.lit(subject).alias("subject"),
        )
        for i, (subject, kws) in enumerate(dictionary.entries)
    ]
    return F.array_max(F.array(*options))


def keyword_classify(
    df: DataFrame,
    dictionary: KeywordDictionary,
    text: str = "text",
    subject: str = "subject",
    confidence: str = "confidence",
    cfg: ClassifySettings = DEFAULTS,
) -> DataFrame:
    """Share of each subject's entries found in the text; best subject and its confidence.

    The confidence is the score times `confidence_rate`, so it can exceed 1. Both are plain columns
    that are left out of the plan where nobody reads them; `settle` them before filtering on them,
    else the filter computes them once more.
    """
    lowered = dictionary.lowered()
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_low": F.lower(body), "_chars": F.length(body)})
    out = out.withColumn("_counts", keyword_counts(F.col("_low"), lowered)).drop("_low")
    out = out.withColumn("_best", _best(F.col("_counts"), F.col("_chars"), lowered, cfg))
    hit = (F.col("_best.score") > 0) & (F.col("_chars") > 0)
    out = out.withColumns(
        {
            subject: F.when(hit, F.col("_best.subject")).otherwise(F.lit(UNKNOWN)),
            confidence: F.when(hit, F.col("_best.score") * cfg.confidence_rate).otherwise(F.lit(0.0)),
        }
    )
    return out.drop("_counts", "_chars", "_best")


def model_classify(
    df: DataFrame,
    labels: Sequence[str],
    probability: str | None = "probability",
    prediction: str = "prediction",
    subject: str = "model_subject",
    confidence: str = "model_confidence",
    cfg: ClassifySettings = DEFAULTS,
) -> DataFrame:
    """Decoded arg-max class and its probability; a fixed confidence without probabilities."""
    names = F.array(*[F.lit(name) for name in labels])
    if probability is None:
        return df.withColumns(
            {
                subject: F.coalesce(F.get(names, F.col(prediction).cast("int")), F.lit(UNKNOWN)),
                confidence: F.lit(cfg.no_probability),
            }
        )
    probs = F.col(probability)
    if not df.schema[probability].dataType.simpleString().startswith("array"):
        probs = vector_to_array(probs)
    out = df.withColumn("_probs", probs)
    out = out.withColumns(
        {
            subject: F.coalesce(F.get(names, arg_max(F.col("_probs")) - 1), F.lit(UNKNOWN)),
            confidence: F.coalesce(F.array_max("_probs"), F.lit(0.0)),
        }
    )
    return out.drop("_probs")


def combine(
    sure: Column,
    keyword_subject: Column,
    keyword_confidence: Column,
    model_subject: Column,
    model_confidence: Column,
    cfg: ClassifySettings = DEFAULTS,
) -> dict[str, Column]:
    """A sure keyword result stands; otherwise the more confident side, the model on a tie."""
    use_model = model_confidence >= keyword_confidence
    return {
        "subject": F.when(sure, keyword_subject)
        .when(use_model, model_subject)
        .otherwise(keyword_subject),
        "confidence": F.when(sure, keyword_confidence).otherwise(
            F.least(F.when(use_model, model_confidence).otherwise(keyword_confidence), F.lit(cfg.model_cap))
        ),
    }


def cascade_classify(
    df: DataFrame,
    dictionary: KeywordDictionary,
    model=None,
    text: str = "text",
    cfg: ClassifySettings = DEFAULTS,
) -> DataFrame:
    """Keywords first, the model only for rows the keywords leave undecided.

    `model` is a function that adds `model_subject` and `model_confidence` to a frame. It gets
    every row, but an empty text where the keywords already decided: the rows are read once,
    and an empty text costs the model next to nothing. Empty texts stay unknown.
    """
    scored = keyword_classify(df, dictionary, text, cfg=cfg)
    if model is None:
        return scored
    body = F.coalesce(F.col(text), F.lit(""))
    sure = (F.col("confidence") > cfg.keyword_sure) | (body == "")
    masked = scored.withColumns(
        {"_text": F.col(text), "_sure": sure, text: F.when(sure, F.lit("")).otherwise(F.col(text))}
    )
    final = combine(
        F.col("_sure"),
        F.col("subject"),
        F.col("confidence"),
        F.col("model_subject"),
        F.col("model_confidence"),
        cfg,
    )
    columns = [F.col("_text").alias(text) if c == text else F.col(c) for c in df.columns]
    out = model(masked).select(*columns, *[column.alias(name) for name, column in final.items()])
    return out


def keyword_only(
    slides: DataFrame,
    dictionary: KeywordDictionary,
    deck: str = "path",
    idx: str = "slide_idx",
    text: str = "text",
    max_slides: int = SLIDES_KEYWORD_ONLY,
) -> DataFrame:
    """Keyword result on the first slides of each deck."""
    return keyword_classify(deck_text(slides, max_slides, deck, idx, text), dictionary)


def incremental_classify(
    new: DataFrame,
    results: DataFrame,
    dictionary: KeywordDictionary,
    keys: Sequence[str] = ("path", "length", "modificationTime"),
    text: str = "text",
    model=None,
) -> DataFrame:
    """Score only rows without a stored result for the same key; return old and new results.

    A changed size or time is a new key, so the row is scored again and the old result goes.
    Every new row gives one row: keys are compared null-safe, and of several results stored under
    one key the most confident is taken. Keys are matched by themselves and written once; rows are
    then joined to that table, so texts move only if very many rows are new.
    """
    names = list(keys)
    stored = results.groupBy(*names).agg(F.max(F.struct("confidence", "subject")).alias("_stored"))
    matched = _same_keys(new.select(*names).distinct(), stored, names, "left")
    matched = write_once(matched, "matched-keys")
    kept = _same_keys(new.select(*names), matched.filter("_stored IS NOT NULL"), names, "inner").select(
        *names, F.col("_stored.subject").alias("subject"), F.col("_stored.confidence").alias("confidence"), F.lit(True).alias("reused")
    )
    todo = _same_keys(new, matched.filter("_stored IS NULL").select(*names), names, "left_semi")
    columns = [*names, "subject", "confidence"]
    fresh = cascade_classify(todo, dictionary, model, text).select(*columns)
    return kept.unionByName(fresh.withColumn("reused", F.lit(False)))


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, where nulls are equal; the keys come from the left."""
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_k_{k}" for k in keys])
