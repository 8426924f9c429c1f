"""Boxes and square windows in whole pixels. Halves are rounded to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _round(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def pixel_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2): a box counted from one with both ends inside, as half-open pixels from zero, clipped to the image."""
    zero = F.lit(0)
    return F.struct(F.greatest(zero, x1 - 1).alias("x1"), F.greatest(zero, y1 - 1).alias("y1"), F.least(width, x2).alias("x2"), F.least(height, y2).alias("y2"))


def window_side(box: Column, width: Column, height: Column, margin: float = 1.5, least_margin: float = 1.02) -> Column:
    """Side of the square window around a box: ``margin`` times its longer side, but no more than the image's shorter side unless the box itself, with its least margin, needs that."""
    longer = F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"])
    wished, room = longer * F.lit(margin), F.least(width, height).cast("double")
    return F.greatest(_round(F.when(wished > room, F.greatest(room, longer * F.lit(least_margin))).otherwise(wished)), longer)


def placed(low: Column, high: Column, side: Column, length: Column) -> Column:
    """struct(start, pad_low, pad_high): a window of ``side`` on an axis of ``length`` around [low, high): moved inside rather than shrunk, and padded on both sides, the lower one less, only where it is longer than the axis."""
    pad = side - length
    half = F.floor(pad / 2).cast("int")
    centred = _round((low + high) / 2 - side / 2)
    around = F.least(F.greatest(centred, high - side), low)  # rounding must not cut the box
    inside = F.least(F.greatest(around, F.lit(0)), length - side)
    padded = F.struct((-half).alias("start"), half.alias("pad_low"), (pad - half).alias("pad_high"))
    return F.when(side > length, padded).otherwise(F.struct(inside.alias("start"), F.lit(0).alias("pad_low"), F.lit(0).alias("pad_high")))


def pad_fraction(side: Column, across: Column, down: Column) -> Column:
    """The share of the window that is padding."""
    inner = (side - across["pad_low"] - across["pad_high"]) * (side - down["pad_low"] - down["pad_high"])
    return (side * side - inner) / (side * side)


def box_in_window(box: Column, across: Column, down: Column, side: Column, size: int) -> Column:
    """struct(x1, y1, x2, y2): the box in the window scaled to ``size`` pixels."""
    scale = F.lit(float(size)) / side
    at = lambda name, axis: ((box[name] - axis["start"]) * scale).alias(name)
    return F.struct(at("x1", across), at("y1", down), at("x2", across), at("y2", down))
