"""Column expressions for text that arrives as people typed it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank, tab, line breaks.
BLANKS = " \t\r\n"
#: White space of any script.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Names of credentials with what separates them from their value, and words that are tokens.
CREDENTIAL = r"(api\s*key|api_key|authorization|bearer\s+token|access\s*token)(\s*[:=]\s*)(?:bearer\s+)?\S+"
SECRET_WORD = r"\b(?:sk|sk-proj|sk-ant|xai)-[A-Za-z0-9._-]{12,}\b"
#: The twenty standard residues.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
_DIGITS = "[0-9]+(?:_[0-9]+)*"
_LENIENT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def strip(column: Column) -> Column:
    """Remove blanks, tabs and line breaks at both ends. Null stays null."""
    return F.btrim(column, F.lit(BLANKS))


def nonblank(column: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip(column), F.lit(""))


def finite_number(column: Column) -> Column:
    """A decimal number as double; null for anything else, also for what overflows to infinity."""
    text = strip(column)
    value = text.try_cast("double")
    return F.when(text.rlike(_NUMBER) & (F.abs(value) < F.lit(float("inf"))), value)


def python_strip(column: Column) -> Column:
    """Remove white space of any script at both ends, as files are read."""
    return F.btrim(column, F.lit(WHITE))


def python_nonblank(column: Column) -> Column:
    """The text without white space of any script at its ends, null where nothing is left."""
    return F.nullif(python_strip(column), F.lit(""))


def python_float(column: Column) -> Column:
    """As a lenient float parser reads it: any white space around, single underscores between digits; null unless finite."""
    text = python_strip(column)
    value = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(text.rlike(_LENIENT) & (F.abs(value) < F.lit(float("inf"))), value)


def group_id(column: Column) -> Column:
    """Stripped name without a ``.csv`` at its end, null where nothing is left."""
    return F.nullif(F.regexp_replace(strip(column), r"\.csv\z", ""), F.lit(""))


def safe_component(column: Column, limit: int = 80) -> Column:
    """A name usable as one path component: other characters than letters, digits, ``_``, ``.``, ``-`` become ``_``, dots and
    underscores at the ends go, nothing left reads ``unknown``; a longer one is cut and ends with ten digits of its SHA-1."""
    clean = F.btrim(F.regexp_replace(column, r"[^A-Za-z0-9_.-]+", "_"), F.lit("._"))
    clean = F.when(clean == "", F.lit("unknown")).otherwise(clean)
    short = F.concat(F.left(clean, F.lit(limit - 11)), F.lit("_"), F.left(F.sha1(column), F.lit(10)))
    return F.when(F.length(clean) <= limit, clean).otherwise(short)


def redact(column: Column, secrets: list[str], mark: str = "[REDACTED]") -> Column:
    """Replace known secrets (longest first), what stands behind names of credentials, and token-shaped words."""
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        column = F.replace(column, F.lit(secret), F.lit(mark))
    column = F.regexp_replace(column, f"(?i){CREDENTIAL}", f"$1$2{mark}")
    return F.regexp_replace(column, SECRET_WORD, mark)


def residues_only(column: Column) -> Column:
    """Upper-case standard residues of a text, nothing for texts that say there is none; null reads as empty."""
    bare = python_strip(F.coalesce(column, F.lit("")))
    return F.when(F.lower(bare).isin("nan", "none", "null"), "").otherwise(F.regexp_replace(F.upper(bare), f"[^{RESIDUES}]", ""))


def joined_sequence(column: Column, gaps: bool = True) -> Column:
    """A sequence from pasted text: header lines and white space go, upper case; without ``gaps`` the ``-`` goes too."""
    lines = F.filter(F.split(F.coalesce(column, F.lit("")), r"\r\n|\r|\n", -1), lambda x: ~F.startswith(python_strip(x), F.lit(">")))
    return F.regexp_replace(F.upper(F.array_join(lines, "")), rf"[\s{'' if gaps else '-'}]", "")


def service_url(column: Column) -> Column:
    """An address without slashes at its end and with ``/v1`` behind it; null for null and for nothing."""
    bare = F.rtrim(column, F.lit("/"))
    return F.when(column != "", F.when(F.endswith(bare, F.lit("/v1")), bare).otherwise(F.concat(bare, F.lit("/v1"))))


def utc_text(column: Column) -> Column:
    """A timestamp as UTC text to the second; the session's time zone is UTC."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
