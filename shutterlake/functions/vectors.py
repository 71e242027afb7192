"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector of the same direction; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def frame_midpoints(duration: Column, n: int) -> Column:
    """Times in the middle of n equal parts of a video; null without a positive duration."""
    if n < 1:
        raise ValueError("at least one frame is needed")
    return F.when(duration > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * (i + 0.5) / n))


def downscaled(width: Column, height: Column, longest: int = 768) -> Column:
    """struct(width, height) of a picture whose longer edge is at most `longest`, fractions cut off."""
    edge = F.greatest(width, height)
    scale = lambda x: F.when(edge > longest, F.greatest(F.floor(x * longest / edge), F.lit(1))).otherwise(x).cast("int")
    return F.struct(scale(width).alias("width"), scale(height).alias("height"))
