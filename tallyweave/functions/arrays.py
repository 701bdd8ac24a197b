"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials, shifted by the largest. Null for null and empty arrays."""

    def total(v: Column) -> Column:
        return let(F.array_max(v).cast("double"), lambda top: top + F.ln(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))))

    return let(values, total)


def log_softmax(values: Column) -> Column:
    return let(values, lambda v: let(log_sum_exp(v), lambda total: F.transform(v, lambda x: x.cast("double") - total)))


def normalised(values: Column, tolerance: float = 1e-5) -> Column:
    """Whether log probabilities sum to one."""
    return F.abs(log_sum_exp(values)) <= tolerance


def blend(logits: Column, prior: Column, alpha: float, times: int = 1) -> Column:
    """(1 - alpha) * logits + alpha * prior, ``times`` times over. A null prior leaves the logits."""
    out = logits
    for _ in range(times):
        out = (1 - alpha) * out + alpha * prior
    return F.coalesce(out, logits)


def blend_both(logits: Column, structure: Column, residue: Column, alpha: float) -> Column:
    """The structure prior blended in, then the residue prior, once each. A null structure prior is left out; where the residue
    prior is null, outside its alignment, the plain logits stay. With the structure prior alone it is ``blend``, once."""
    if alpha == 0:
        return logits
    return F.coalesce((1 - alpha) * blend(logits, structure, alpha) + alpha * residue, logits)


def confident(b_factor: Column, value: Column, sequence_only: Column, threshold: float | None = 70.0) -> Column:
    """``value``, but what the sequence alone gives for residues with a B-factor below ``threshold``, if there is one."""
    return F.when(b_factor < threshold, sequence_only).otherwise(value) if threshold else value


def structure_tokens(codes: Column) -> Column:
    """Codes moved by 3 between the start mark 1 and the end mark 2; null where a code is negative or null."""
    bad = F.exists(codes, lambda x: F.coalesce(x < 0, F.lit(True)))
    return F.when(~bad, F.concat(F.array(F.lit(1)), F.transform(codes, lambda x: (x + 3).cast("int")), F.array(F.lit(2))))


def key_seed(digest: Column) -> Column:
    """The first eight hex digits as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance
