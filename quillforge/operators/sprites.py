"""Sprite planning: which images qualify, their alignment, and positions after packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vertical_candidate(x: Column, x_unit: Column, y: Column, y_unit: Column) -> Column:
    """Nothing is stated, or y is 0 or in pixels."""
    none = x.isNull() & x_unit.isNull() & y.isNull() & y_unit.isNull()
    return none | F.coalesce((y == 0) | (y_unit == "px"), F.lit(False))


def failure_reason(urls: Column, ignored: Column, shorthand: Column, longhand: Column, url_ignored: Column, repeat: Column, default_size: Column, vertical: Column) -> Column:
    """Why an image cannot be put in a sprite, null if it can; shorthand and long form together raise."""
    both = F.raise_error(F.lit("shorthand and long form of background together")).cast("string")
    once = F.coalesce(repeat == "no-repeat", F.lit(False))
    head = F.when(urls > 1, "MultipleUrls").when(ignored, "SpritingIgnore").when(shorthand & longhand, both).when(urls == 0, "NoUrl").when(url_ignored, "IgnoreUrl")
    short = F.when(~once, "BackgroundRepeatInvalid").when(~vertical, "IncorrectPosition").when(~default_size, "BackgroundSizeIsSetToNonDefaultValue")
    long = F.when(repeat.isNull(), "NoRepeat").when(~once, "BackgroundRepeatInvalid").when(~default_size, "BackgroundSizeIsSetToNonDefaultValue").when(~vertical, "IncorrectPosition")
    return head.when(shorthand, short).otherwise(long)


def place(start: Column, shift: Column, factor: Column, dpi: Column, unit: Column) -> Column:
    """A coordinate moved into the sprite, rounded half to even at three places; only 0 and pixels move."""
    moved = F.bround((start + shift / dpi) * factor, 3)
    return F.when((start == 0) | (unit == "px"), moved).otherwise(start)


def scaled(size: Column, factor: Column, dpi: Column) -> Column:
    return F.bround(size * factor / dpi, 3)
