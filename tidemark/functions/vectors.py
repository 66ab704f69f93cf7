"""Vectors as arrays of doubles: folds inside the engine, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda over an array of one element."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(F.struct(a.alias("v"), norm(a).alias("n")), lambda z: F.transform(z["v"], lambda x: F.when(z["n"] > 0, x.cast("double") / z["n"]).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """NULL if a side is the zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def softmax(a: Column, temperature: float = 1.0, clip: float = 50.0) -> Column:
    scaled = F.transform(a, lambda x: F.greatest(F.least(x / temperature, F.lit(clip)), F.lit(-clip)))
    shifted = let(scaled, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return let(shifted, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(v, lambda x: x / total)))


def combine(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def mean_pool(tokens: Column, mask: Column | None = None, size: int | None = None) -> Column:
    """Mean of the token vectors where ``mask`` is not 0; zeros (of ``size``) if none is."""
    kept = F.filter(tokens, lambda v: v.isNotNull()) if mask is None else F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])
    zero = F.array_repeat(F.lit(0.0), F.lit(size) if size else F.coalesce(F.size(tokens[0]), F.lit(0)))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return let(F.struct(total.alias("t"), F.size(kept).alias("n")), lambda z: F.transform(z["t"], lambda x: F.when(z["n"] > 0, x / z["n"]).otherwise(0.0)))


def max_pool(tokens: Column) -> Column:
    return F.aggregate(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), tokens[0], lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y)))


def three_point(low: Column, neutral: Column, high: Column, epsilon: float = 1e-8) -> dict[str, Column]:
    """What a low-neutral-high axis shows: its direction, both deviations from the neutral point, their summed length
    (magnitude), how straight the way is (clarity), and how far the neutral point is from the middle (curvature)."""
    minus = lambda a, b: combine(a, b, lambda x, y: x - y)
    up, down, direction = minus(high, neutral), minus(low, neutral), minus(high, low)
    middle = combine(low, high, lambda x, y: (x + y) / 2)
    magnitude = norm(up) + norm(down)
    return {"direction": direction, "high_deviation": up, "low_deviation": down, "magnitude": magnitude, "clarity": norm(direction) / (magnitude + epsilon), "curvature": norm(minus(neutral, middle))}


def bigrams(text: Column) -> Column:
    """Distinct character bigrams; a text of one character is its own."""
    n = F.char_length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))).when(n == 1, F.array(text)).otherwise(F.array().cast("array<string>"))
