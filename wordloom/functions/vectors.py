"""Vector arithmetic on `array<double>` columns (V1-V7)."""

from __future__ import annotations

from math import lcm

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    """V6: Euclidean length."""
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda acc, x: acc + x * x))


def project_out(a: Column, b: Column, share: Column | float = 1.0) -> Column:
    """V4: `a` without `share` of its projection on the unit vector `b`."""
    k = F.lit(share) * dot(a, b) if isinstance(share, float) else share * dot(a, b)
    return F.zip_with(doubles(a), F.transform(doubles(b), lambda x: x), lambda x, y: x - k * y)


def vector_sum(v: Column) -> Column:
    """Aggregate: element-wise sum, with partial sums before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def vector_mean(v: Column) -> Column:
    """V5, aggregate: element-wise mean, with partial results before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def distance_scale(window: int, weighted: bool = True) -> int:
    """Common denominator of the weights 1/1 .. 1/window."""
    return lcm(*range(1, window + 1)) if weighted else 1


def distance_weight(distance: Column, window: int, weighted: bool = True) -> Column:
    """V1: the weight of a distance, as an integer multiple of 1/`distance_scale`.

    Integers add up to the same sum in any order.
    """
    if not weighted:
        return F.lit(1)
    scale = distance_scale(window)
    return F.element_at(F.array(*[F.lit(scale // d) for d in range(1, window + 1)]), distance)


def glove_weight(x: Column, x_max: float = 100.0, alpha: float = 0.75) -> Column:
    """V2: weight of a co-occurrence count in the loss."""
    return F.least(F.lit(1.0), F.pow(x / F.lit(x_max), F.lit(alpha)))


def combine(word_vec: Column, context_vec: Column, model: int = 2) -> Column:
    """V7: output vector from word and context parameters, each with its bias last.

    0: all parameters; 1: word vector; 2: sum of both; 3: both in a row.
    """
    bare = lambda v: F.slice(v, F.lit(1), F.size(v) - 1)
    if model == 0:
        return F.concat(word_vec, context_vec)
    if model == 1:
        return bare(word_vec)
    if model == 2:
        return plus(bare(word_vec), bare(context_vec))
    if model == 3:
        return F.concat(bare(word_vec), bare(context_vec))
    raise ValueError("model must be 0, 1, 2 or 3")
