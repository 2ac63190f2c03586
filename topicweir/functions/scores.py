"""Small numeric column functions."""

from pyspark.sql import Column, functions as F

from topicweir.runtime import bind


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence > 0.8, F.lit("high"))
        .when(confidence > 0.6, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def temperature_scale(probs: Column, temperature: float) -> Column:
    """Clip, raise to 1/T, renormalise."""
    if temperature == 1.0:
        return probs
    powered = F.transform(
        probs,
        lambda p: F.pow(F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10)), F.lit(1.0 / temperature)),
    )
    return bind(
        powered,
        lambda v: bind(
            F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x),
            lambda total: F.transform(v, lambda x: x / total),
        ),
    )


def align_width(values: Column, width: int) -> Column:
    """Cut or zero-pad an array to a fixed width."""
    doubles = values.cast("array<double>")
    return F.slice(F.concat(doubles, F.array_repeat(F.lit(0.0), width)), 1, width)


def arg_max(values: Column) -> Column:
    """1-based position of the first greatest element."""
    return bind(values, lambda v: F.array_position(v, F.array_max(v)).cast("int"))
