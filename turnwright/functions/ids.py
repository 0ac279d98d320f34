"""Call ids, missing values and durations as the tables spell them, read with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-ins for a missing text, compared in lower case after trimming.
MISSING = ("", "-", "--", "?", ".", "...", "nan", "none", "null", "na", "n/a", "n.a.", "<na>", "\\n", "unk", "unknown", "missing")

EDGE_BLANKS = r"(?U)^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$"


def tidy(c: Column) -> Column:
    """Trim blanks of every kind, no-break ones too."""
    return F.regexp_replace(c, EDGE_BLANKS, "")


def present(c: Column) -> Column:
    """The trimmed text, or null where it is only a stand-in for a missing one."""
    t = tidy(c)
    return F.when(~F.lower(t).isin(*MISSING), t)


BLANK = r"[\s\u00a0\u200b\ufeff'\"`]*"
#: Digits of an id, behind blanks, quotes or an alphabetic prefix, perhaps with hyphens inside and .0 at the end.
ID_DIGITS = rf"(?U)^{BLANK}(?:[A-Za-z]+[-_:#/]?)?([0-9][0-9-]*)(?:\.0*)?{BLANK}$"
ID_EXPONENT = rf"(?U)^{BLANK}([0-9](?:\.[0-9]+)?[eE]\+?[0-9]{{1,2}}){BLANK}$"


def _where(v: Column, test) -> Column:
    """v where the test holds, else null, with v computed only once."""
    return F.get(F.filter(F.array(v), test), F.lit(0))


def call_id(c: Column) -> Column:
    """The 11-digit call id behind any of its spellings, else null.

    Blanks, quotes, an alphabetic prefix, inner hyphens, a trailing .0 and exponent notation are undone; of a raw 10-character id the
    '0' after the century is restored. Stand-ins, ids of other lengths and all zeros mean that there is none.
    """
    exponent = F.regexp_extract(c, ID_EXPONENT, 1).try_cast("double").try_cast("decimal(20,0)").cast("string")
    digits = F.regexp_replace(F.regexp_extract(c, ID_DIGITS, 1), "-", "")
    spelled = F.when(c.rlike("[0-9][eE][+0-9]"), exponent).otherwise(digits)
    repaired = F.regexp_replace(spelled, "^([0-9]{2})([0-9]{8})$", "$10$2")
    return F.when(c.rlike("^[1-9][0-9]{10}$"), c).otherwise(_where(repaired, lambda x: x.rlike("^[0-9]{11}$") & ~x.rlike("^0+$")))


_NUMBER = r"([0-9]+[.,]?[0-9]*(?:[eE][+-]?[0-9]+)?|[.,][0-9]+)"


def _quantity(c: Column, unit: str) -> Column:
    n = F.regexp_extract(c, rf"(?iU)^{BLANK}\+?{BLANK}{_NUMBER}{BLANK}{unit}{BLANK}$", 1)
    return F.translate(n, ",", ".").try_cast("double")


def seconds(c: Column) -> Column:
    """Seconds above zero stated by a text, else null.

    Reads decimals with point or comma, a plus sign, exponents, a unit (ms, s, sec, min, h) and clock notation ([h:]mm:ss). Zero, negative,
    infinite and missing values, error codes and doubtful values in marks (<100?>) state none.
    """
    clock = rf"(?U)^{BLANK}(?:([0-9]+):)?([0-9]+):([0-9]{{1,2}}(?:[.,][0-9]+)?){BLANK}$"
    part = lambda i: F.translate(F.regexp_extract(c, clock, i), ",", ".").try_cast("double")
    v = F.coalesce(
        _quantity(c, "(?:s|secs?|seconds?)?"),
        part(3) + part(2) * 60 + F.coalesce(part(1), F.lit(0.0)) * 3600,
        _quantity(c, "(?:ms|msecs?|milliseconds?)") * 0.001,
        _quantity(c, "(?:m|mins?|minutes?)") * 60,
        _quantity(c, "(?:h|hours?)") * 3600,
    )
    plain = F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.try_cast("double")).otherwise(v)
    return _where(plain, lambda x: (x > 0) & (x < F.lit(float("inf"))))


def usable(c: Column) -> Column:
    """A double that is a number: NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def millis(c: Column) -> Column:
    """Seconds to whole milliseconds, the nearest."""
    return F.round(usable(c) * 1000).cast("bigint")
