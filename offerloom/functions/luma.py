"""Columns over brightness: a frame is an array of rows of pixel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of the brightest pixels that tells a card's brightness, and what is blown out.
BRIGHT_PERCENTILE, CLIPPED_AT = 90, 250


def mean(values: Column) -> Column:
    """Null for an empty array."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def row_profile(luma: Column) -> Column:
    """Mean brightness of each row."""
    return F.transform(luma, mean)


def percentile(pixels: Column, p: float) -> Column:
    """The linear percentile of an array; null if it is empty.  One sort, no shuffle."""
    ranked = F.sort_array(pixels)
    at = (F.size(pixels) - 1) * (p / 100)
    low = F.floor(at).cast("int")
    value = lambda i: F.get(ranked, F.least(i, F.size(pixels) - 1)).cast("double")
    return F.when(F.size(pixels) > 0, value(low) + (value(low + 1) - value(low)) * (at - low))


def brightness(luma: Column) -> Column:
    """How bright the bright part is."""
    return percentile(F.flatten(luma), BRIGHT_PERCENTILE)


def clipped_share(luma: Column) -> Column:
    """Share of pixels that are blown out; 0 without pixels."""
    pixels = F.flatten(luma)
    return F.size(F.filter(pixels, lambda x: x >= CLIPPED_AT)) / F.greatest(F.size(pixels), F.lit(1))


def profile_change(a: Column, b: Column, rows: Column) -> Column:
    """Mean difference of two profiles over their first ``rows`` rows."""
    some = lambda p: F.slice(p, F.lit(1), rows)
    return mean(F.zip_with(some(a), some(b), lambda x, y: F.abs(x - y)))
