"""Substitution notation as column expressions: residue, position, other residue.

One parser serves the dialects of the scoring front-ends; they differ in separators, in whether a residue may be
replaced by itself and in how repeated positions count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.arrays import let

#: The twenty standard residues.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
_ONE = rf"^[{RESIDUES}][0-9]+[{RESIDUES}]\z"


def parts(mutant: Column, separators: str = "[+:]") -> Column:
    """Array of (wt, pos, alt) structs in the order written; null members where the notation is broken."""

    def read(x: Column) -> Column:
        ok = x.rlike(_ONE)
        return F.named_struct(
            F.lit("wt"), F.when(ok, F.left(x, F.lit(1))),
            F.lit("pos"), F.when(ok, F.substring(x, 2, F.length(x) - 2).try_cast("int")),
            F.lit("alt"), F.when(ok, F.right(x, F.lit(1))),
        )

    return F.transform(F.split(mutant, separators, -1), read)


def flat_sequence(sequence: Column) -> Column:
    """The chains of a sequence in one string."""
    return F.replace(sequence, F.lit(":"), F.lit(""))


def legal(found: Column, flat_wt: Column, synonymous: bool = False) -> Column:
    """True where every part is well formed, stands on its residue and no position occurs twice.

    A null sequence makes every mutant illegal.
    """

    def judge(parts_: Column, wt: Column) -> Column:
        def wrong(x: Column) -> Column:
            fits = (x["pos"] >= 1) & (F.substring(wt, x["pos"], F.lit(1)) == x["wt"])
            if not synonymous:
                fits = fits & (x["alt"] != x["wt"])
            return ~F.coalesce(fits, F.lit(False))

        once = F.size(F.array_distinct(F.transform(parts_, lambda x: x["pos"]))) == F.size(parts_)
        return ~F.exists(parts_, wrong) & once

    return let(found, lambda f: let(flat_wt, lambda wt: judge(f, wt)))


def ordered(found: Column) -> Column:
    """Parts by position."""
    return F.array_sort(F.transform(found, lambda x: F.named_struct(F.lit("pos"), x["pos"], F.lit("wt"), x["wt"], F.lit("alt"), x["alt"])))


def notation(found: Column, joiner: str = ":") -> Column:
    """Written form of parts, joined."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["wt"], x["pos"].cast("string"), x["alt"])), joiner)


def applied(flat_wt: Column, found: Column) -> Column:
    """The sequence with all parts put in."""
    return F.aggregate(found, flat_wt, lambda acc, x: F.overlay(acc, x["alt"], x["pos"], F.lit(1)))


def chain_bounds(sequence: Column) -> Column:
    """Array of (chain_id, start, end, sequence), all from 1, of a sequence whose chains ``:`` separates."""
    chains = F.split(sequence, ":", -1)
    names = [F.lit(n) for n in ("chain_id", "start", "end", "sequence")]
    entry = lambda *values: F.array(F.named_struct(*[x for pair in zip(names, values) for x in pair]))
    start = entry(F.lit(0), F.lit(0), F.lit(0), F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)
        return F.concat(acc, entry(before["chain_id"] + 1, before["end"] + 1, before["end"] + F.length(x), x))

    return F.slice(F.aggregate(chains, start, step), F.lit(2), F.size(chains))


def rechained(flat: Column, bounds: Column) -> Column:
    """A flat sequence cut into its chains again."""
    return let(flat, lambda f: F.array_join(F.transform(bounds, lambda b: F.substring(f, b["start"], b["end"] - b["start"] + 1)), ":"))


def dialect(mutant: Column, flat_wt: Column, name: str) -> Column:
    """(valid, error, normalized) of a mutant under one of the scorers' notations.

    ``strict``: ``+`` or ``:``, no synonymous parts. ``colon``: ``:`` only, synonymous parts allowed.
    ``mixed``: any of ``: ; , |`` or blanks, sorted. ``prefixed``: blank or ``WT`` is the wild type, a ``P.`` in front
    is dropped, a repeated part counts once. Null input is invalid with error ``empty``.
    """
    text = F.upper(F.btrim(F.coalesce(mutant, F.lit("")), F.lit(" \t\r\n")))
    wild = F.lit(False)
    if name == "prefixed":
        wild = text.isin("", "WT")
        text = F.regexp_replace(text, r"(^|[+:;,|\s])P\.", "$1")
    separators = {"strict": "[+:]", "colon": ":", "mixed": r"[:;,|\s]+", "prefixed": r"[+:;,|\s]+"}[name]
    found = parts(text, separators)
    if name == "prefixed":
        found = F.array_distinct(found)

    def judge(f: Column, wt: Column) -> Column:
        broken = F.exists(f, lambda x: x["pos"].isNull())
        outside = F.exists(f, lambda x: (x["pos"] < 1) | (x["pos"] > F.length(wt)))
        other = F.exists(f, lambda x: F.substring(wt, x["pos"], F.lit(1)) != x["wt"])
        twice = F.size(F.array_distinct(F.transform(f, lambda x: x["pos"]))) < F.size(f)
        same = F.exists(f, lambda x: x["alt"] == x["wt"]) if name == "strict" else F.lit(False)
        error = (
            F.when(wild, F.lit(None).cast("string"))
            .when((text == "") | wt.isNull(), "empty")
            .when(broken, "format")
            .when(outside, "range")
            .when(other, "residue")
            .when(same, "synonymous")
            .when(twice, "position")
        )
        shown = notation(f if name == "colon" else ordered(f))
        return let(error, lambda e: F.named_struct(F.lit("valid"), e.isNull(), F.lit("error"), e, F.lit("normalized"), F.when(wild, "WT").when(e.isNull(), shown)))

    return let(found, lambda f: let(flat_wt, lambda wt: judge(f, wt)))
