"""Model arithmetic on ``array<double>`` columns: built-in higher-order functions only.

Sums are left folds, so results do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-5


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    return _col(x).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, not once per element of a vector."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column | str) -> Column:
    return F.aggregate(doubles(x), F.lit(0.0), lambda a, v: a + v)


def mean(x: Column | str) -> Column:
    return total(x) / F.size(_col(x))


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b))


def add(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(doubles(x), doubles(y), lambda a, b: a + b)


def position_add(x: Column | str, table: Column) -> Column:
    """Add row ``i`` of a table to vector ``i`` of an ``array<array<double>>``."""
    return F.zip_with(_col(x), F.slice(table, F.lit(1), F.size(_col(x))), add)


def linear(x: Column | str, weight: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """x W^T + b for one vector; the vector must have the length of the rows of W."""
    if not weight or not weight[0]:
        raise ValueError("weight must have at least one row and one column")
    if bias is not None and len(bias) != len(weight):
        raise ValueError("bias must have one value per row of weight")
    own = F.when(F.size(_col(x)) != len(weight[0]), F.raise_error(F.lit("last dimension must equal the input size"))).otherwise(doubles(x))
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weight])
    out = F.transform(rows, lambda row: dot(own, row))
    return out if bias is None else add(out, F.array(*[F.lit(float(b)) for b in bias]))


def layer_norm(x: Column | str, *, scale: Column | None = None, shift: Column | None = None, epsilon: float = EPSILON) -> Column:
    """(x - mean) / sqrt(biased variance + epsilon), then scale and shift."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    own = doubles(x)

    def scaled(centred: Column) -> Column:
        spread = F.sqrt(dot(centred, centred) / F.size(centred) + epsilon)
        return let(spread, lambda d: F.transform(centred, lambda v: v / d))

    out = let(let(mean(own), lambda m: F.transform(own, lambda v: v - m)), scaled)
    out = out if scale is None else F.zip_with(out, scale, lambda a, b: a * b)
    return out if shift is None else add(out, shift)


def gelu(x: Column | str) -> Column:
    """Tanh approximation of the Gaussian error linear unit of a number."""
    own = _col(x).cast("double")
    return 0.5 * own * (1.0 + F.tanh(math.sqrt(2.0 / math.pi) * (own + 0.044715 * own * own * own)))


def softmax(x: Column | str) -> Column:
    own = doubles(x)
    weight = let(F.array_max(own), lambda top: F.transform(own, lambda v: F.exp(v - top)))
    return let(weight, lambda w: let(total(w), lambda t: F.transform(w, lambda v: v / t)))


def log_sum_exp(x: Column | str) -> Column:
    own = doubles(x)
    return let(F.array_max(own), lambda top: top + F.log(total(F.transform(own, lambda v: F.exp(v - top)))))


def attention(query: Column | str, keys: Column | str, values: Column | str, mask: Column | str) -> Column:
    """One head for one query vector: softmax over unmasked keys of q k / sqrt(d), weighted sum of values."""
    q, ks, vs, m = doubles(query), _col(keys), _col(values), _col(mask)
    scores = F.transform(ks, lambda k: dot(q, k) / F.sqrt(F.size(q).cast("double")))
    scores = F.transform(scores, lambda s, i: F.when(F.get(m, i) == 1, s).otherwise(F.lit(-1.7976931348623157e308)))
    place = F.sequence(F.lit(0), F.size(F.get(vs, F.lit(0))) - 1)
    return let(softmax(scores), lambda weight: F.transform(place, lambda d: total(F.transform(weight, lambda w, i: w * F.get(F.get(vs, i), d)))))


def token_loss(logits: Column | str, label: Column | str) -> Column:
    """Log-sum-exp minus the labelled logit; null where the label is ignored (-100)."""
    own, l = _col(logits), _col(label)
    outside = (l < 0) | (l >= F.size(own))
    chosen = F.when(outside, F.raise_error(F.concat(F.lit("label is outside the logits: "), l))).otherwise(F.get(doubles(own), l.cast("int")))
    return F.when(l != -100, log_sum_exp(own) - chosen)
