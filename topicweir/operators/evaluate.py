"""Evaluation of predictions (label, prediction) as long tables.

All class metrics come from one map-side-combined count per (label, prediction) pair; what
follows works on that table of at most classes^2 rows per model.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from topicweir.runtime import per_class_window, settle

SAMPLE_CHARS = 100
NO_CLASS = "(none)"


def is_hit(label: str, prediction: str) -> Column:
    """1.0 or 0.0 for every row; a missing label or prediction is no hit."""
    return F.coalesce((F.col(label) == F.col(prediction)).cast("double"), F.lit(0.0))


def accuracy(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return p.agg(F.avg(is_hit(label, prediction)).alias("accuracy"))


def pair_counts(
    p: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return p.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _class_table(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: true positives, support, times predicted, and the three scores."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    table = (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    )

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return table.withColumns(
        {
            "precision": ratio(tp, predicted),
            "recall": ratio(tp, support),
            "f1": ratio(2 * tp, predicted + support),
        }
    )


def class_metrics(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _class_table(pair_counts(p, label, prediction)).select("class", "precision", "recall", "f1")


def _averages(by: Sequence[str], table: DataFrame) -> DataFrame:
    return table.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def macro_metrics(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _averages([], _class_table(pair_counts(p, label, prediction)))


def compare_models(
    p: DataFrame, model: str = "model", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy and macro F1 of every named model, in one job."""
    table = _class_table(pair_counts(p, label, prediction, [model]), [model])
    return _averages([model], table).select(model, "accuracy", "f1_macro")


def confusion_matrix(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every (true, predicted) cell over the sorted classes seen on either side, zeros included.

    Classes are text; a missing one is counted as the class NO_CLASS.
    """
    p = p.select(*[F.coalesce(F.col(c).cast("string"), F.lit(NO_CLASS)).alias(c) for c in dict.fromkeys((label, prediction))])
    sides = F.array(
        F.struct("label", F.struct("prediction", "n").alias("cell")),
        # a class that is only predicted gets a row of zeros
        F.struct(F.col("prediction").alias("label"), F.lit(None).cast("struct<prediction:string,n:bigint>").alias("cell")),
    )
    rows = (
        pair_counts(p, label, prediction)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(F.map_from_entries(F.collect_list("cell")).alias("cells"))
        .withColumn("classes", F.sort_array(F.collect_set("label").over(per_class_window())))
    )
    cells = rows.select("label", "cells", F.explode("classes").alias("prediction"))
    return cells.select("label", "prediction", F.coalesce(F.col("cells")[F.col("prediction")], F.lit(0)).alias("n"))


def confusion_wide(
    p: DataFrame, classes: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per true class, one column per predicted class of the given list."""
    pairs = confusion_matrix(p, label, prediction)
    return pairs.groupBy("label").pivot("prediction", list(classes)).agg(F.sum("n")).na.fill(0)


def classification_report(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Class rows, then accuracy, macro average and weighted average rows.

    Every class row also enters the three summary rows with its weight, so one grouping of
    the class table gives them all. Accuracy is the recall weighted by support.
    """
    table = _class_table(pair_counts(p, label, prediction))
    scores = ["precision", "recall", "f1"]
    one, support = F.lit(1).cast("long"), F.col("support")

    def entry(kind: int, name: Column, weight: Column, *values: str) -> Column:
        cells = [F.col(v).alias(s) for v, s in zip(values, scores)]
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), weight.alias("weight"), *cells, support)

    rows = table.select(
        F.inline(
            F.array(
                entry(0, F.col("class"), one, *scores),
                entry(1, F.lit("accuracy"), support, "recall", "recall", "recall"),
                entry(2, F.lit("macro avg"), one, *scores),
                entry(3, F.lit("weighted avg"), support, *scores),
            )
        )
    )
    mean = [(F.sum(F.col(s) * F.col("weight")) / F.sum("weight")).alias(s) for s in scores]
    report = rows.groupBy("kind", "name").agg(*mean, F.sum("support").alias("support"))
    return report.orderBy("kind", "name").select("name", *scores, "support")


def analyze_errors(
    p: DataFrame,
    id_col: str = "doc_id",
    text: str | None = "text",
    classes: Sequence[str] | None = None,
    probability: str | None = None,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Wrong rows, those without a prediction included, with both classes, their probabilities where known, and a text sample.

    `classes` names the positions of the probability array.
    """
    wrong = settle(p, prediction).filter(~F.col(label).eqNullSafe(F.col(prediction)))
    if probability is None:
        true_prob = pred_prob = F.lit(None).cast("double")
    else:
        names = F.array(*[F.lit(c) for c in classes])
        probs = F.col(probability)

        def at(name: str):
            return F.get(probs, F.array_position(names, F.col(name)).cast("int") - 1)

        true_prob, pred_prob = at(label), at(prediction)
    columns = [
        F.col(id_col),
        F.col(label).alias("true_label"),
        F.col(prediction).alias("predicted_label"),
        true_prob.alias("true_prob"),
        pred_prob.alias("pred_prob"),
    ]
    if text is not None:
        head = F.substring(text, 1, SAMPLE_CHARS)
        columns.append(
            F.when(F.length(text) > SAMPLE_CHARS, F.concat(head, F.lit("..."))).otherwise(F.col(text)).alias("sample")
        )
    return wrong.select(*columns)


def top_errors(errors: DataFrame, n: int = 20, id_col: str = "doc_id") -> DataFrame:
    """The first errors by id for display; probabilities with three digits or N/A."""

    def shown(name: str):
        return F.when(F.col(name).isNull(), F.lit("N/A")).otherwise(F.format_string("%.3f", F.col(name)))

    return errors.orderBy(id_col).limit(n).withColumns({c: shown(c) for c in ("true_prob", "pred_prob")})
