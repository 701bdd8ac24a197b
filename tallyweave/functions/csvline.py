"""Strict reading of one comma-separated record as column expressions.

A field is quoted as a whole, quotes inside it doubled, or it contains no quote. The work is done on the pieces
between quote characters: pieces with even index lie outside quotes, odd ones inside. No regular expression runs over
a whole record, so records of any length are read without deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.arrays import let

_ESCAPE = "\x01"


def line_body(column: Column) -> Column:
    """The record without its line end; null counts as empty."""
    text = F.coalesce(column, F.lit(""))
    return F.when(F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)


def without_mark(column: Column) -> Column:
    """Without a byte order mark in front."""
    return F.when(F.startswith(column, F.lit("﻿")), F.substring(column, 2, 2147483647)).otherwise(column)


def quote_pieces(body: Column) -> Column:
    """What stands between the quote characters of a record, with a comma put in front of the record."""
    return F.split(F.concat(F.lit(","), body), '"', -1)


def sound(pieces: Column) -> Column:
    """True where every quote opens or closes a whole field or is one of a doubled pair."""

    def judge(p: Column, last: Column) -> Column:
        def bad(piece: Column, i: Column) -> Column:
            opens = (i < last) & ~F.endswith(piece, F.lit(","))
            follows = (i > 0) & ~F.startswith(piece, F.lit(","))
            doubled = (piece == "") & (i > 0) & (i < last)
            at_end = (piece == "") & (i == last)
            return (i % 2 == 0) & ~doubled & (opens | (follows & ~at_end))

        return (last % 2 == 0) & (F.size(F.filter(p, bad)) == 0)

    return let(pieces, lambda p: let(F.size(p) - 1, lambda last: judge(p, last)))


def fields(pieces: Column) -> Column:
    """The values of a sound record, quotes removed and doubled quotes halved."""
    mark, comma = F.lit(_ESCAPE + "a"), F.lit(_ESCAPE + "b")

    def flattened(p: Column, last: Column) -> Column:
        def flat(piece: Column, i: Column) -> Column:
            kept = F.replace(piece, F.lit(_ESCAPE), mark)
            return (
                F.when(i % 2 == 1, F.replace(kept, F.lit(","), comma))
                .when((piece == "") & (i > 0) & (i < last), F.lit('"'))
                .otherwise(kept)
            )

        return F.array_join(F.transform(p, flat), "")

    joined = let(pieces, lambda p: let(F.size(p) - 1, lambda last: flattened(p, last)))
    cells = F.split(F.substring(joined, 2, 2147483647), ",", -1)
    return F.transform(cells, lambda x: F.replace(F.replace(x, comma, F.lit(",")), mark, F.lit(_ESCAPE)))
