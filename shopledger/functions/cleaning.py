"""Cell cleaning and type coercion. Bad values become null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value".
NULL_TOKENS = ("-", "N/A", "nan", "None", "NaT")

# The date layouts tried in order when a caller names none.
ISO_FORMATS = (
    "yyyy-MM-dd[ HH:mm[:ss[.SSSSSS]]]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
)

# Characters that count as whitespace around a cell.
WHITESPACE = " \t\n\r\f\v\u00a0\u2007\u202f\u3000"


def strip_ws(c: Column) -> Column:
    """Trim every kind of whitespace; Spark's own ``trim`` removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_header(c: Column) -> Column:
    """Collapse whitespace runs (line breaks included) and trim a header cell."""
    return strip_ws(F.regexp_replace(c, r"\s+", " "))


def clean_cell(c: Column) -> Column:
    """Trim a text cell and turn the null tokens into null."""
    text = strip_ws(c)
    return F.when(~text.isin(*NULL_TOKENS), text)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain finite number becomes null.

    Also null are texts the JVM parser accepts but a spreadsheet number is not: type
    suffixes (``1d``), hexadecimal floats, NaN and infinity.
    """
    text = c.cast("string")
    number = text.try_cast("double")
    finite = F.abs(number) < F.lit(float("inf"))
    return F.when(finite & ~text.rlike("[dDfFxX]"), number)


def to_time(c: Column, formats: Sequence[str] = ISO_FORMATS) -> Column:
    """Text to a zone-less timestamp by the first layout that fits, else null.

    The text is read as UTC and counted from the epoch, so the clock time survives
    in a session whose zone skips that hour.
    """
    text = F.concat(strip_ws(c.cast("string")), F.lit(" Z"))
    parsed = [F.try_to_timestamp(text, F.lit(f"{f} X")) for f in formats]
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.coalesce(*parsed)), epoch)
