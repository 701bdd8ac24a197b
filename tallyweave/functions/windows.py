"""Window arithmetic of scoring front-ends: which stretch of a sequence is scored for a position. All on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(column: Column) -> Column:
    return column.cast("int")


def centred(length: Column, position: Column, width: int) -> Column:
    """(first, last, relative) of the window of ``width`` residues around a position, all from 1."""
    start = F.greatest(F.lit(1), position - width // 2)
    end = F.least(length, start + width - 1)
    start = F.greatest(F.lit(1), end - width + 1)
    whole = length <= width
    first = F.when(whole, 1).otherwise(start)
    return F.struct(_int(first).alias("first"), _int(F.when(whole, length).otherwise(end)).alias("last"), _int(position - first + 1).alias("relative"))


def token_window(tokens: Column, target: Column, width: int) -> Column:
    """First of ``width`` tokens around a target index, both from 0."""
    half = width // 2
    return _int(F.when((tokens <= width) | (target < half), 0).when(target >= tokens - half, tokens - width).otherwise(target - half))


def _within(low: Column, value: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def required(length: Column, first: Column, last: Column, width: int) -> Column:
    """(first, last) of a window that holds an interval, from 1; null where the interval is wider than the window.

    The window's middle is the interval's; it is moved as little as it takes to lie inside the sequence.
    """
    begin = _within(F.lit(1), F.floor((first + last) / 2) - (width - 1) // 2, F.greatest(F.lit(1), length - width + 1))
    stop = F.least(length, begin + width - 1)
    return F.when((first >= begin) & (last <= stop) | (length <= width), F.struct(_int(begin).alias("first"), _int(stop).alias("last")))


def half_open(length: Column, position: Column, width: int) -> Column:
    """(start, stop) from 0, stop excluded: the position in the middle, moved to lie inside the sequence."""
    begin = _within(F.lit(0), position - width // 2, F.greatest(F.lit(0), length - width))
    size = F.least(length - begin, F.when((begin > 0) & (position < length - width // 2), width // 2 * 2).otherwise(width))
    return F.struct(_int(begin).alias("start"), _int(begin + size).alias("stop"))


def chunks(sequence: Column, width: int) -> Column:
    """Array of consecutive stretches of ``width`` characters; the last may be shorter. Empty for an empty text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(sequence), F.lit(1)), F.lit(width))
    return F.filter(F.transform(starts, lambda s: F.substring(sequence, s, F.lit(width))), lambda x: x != "")


def scorable_chunks(sequence: Column, width: int) -> Column:
    """As chunks; raises when it is read if one has fewer than two characters, which can't be scored."""
    cut = chunks(sequence, width)
    return F.when(F.exists(cut, lambda x: F.length(x) < 2), F.raise_error(F.lit("a chunk is too short to score")).cast("array<string>")).otherwise(cut)


def attention_cost(length: Column, width: int) -> Column:
    """Sum of squared chunk lengths of a sequence with its two end marks."""
    full, rest = F.floor((length + 2) / width), (length + 2) % width
    return (full * width * width + rest * rest).cast("bigint")


def batch_size(length: Column, requested: int, window: int) -> Column:
    """How many positions fit a batch when memory grows with the square of the length."""
    inside = F.least(length, F.lit(window))
    return _int(F.least(F.lit(requested), F.greatest(F.lit(1), F.floor(F.lit(window * window) / (inside * inside)))))
