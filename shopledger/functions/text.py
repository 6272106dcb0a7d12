"""Text rules for codes, vendors and purchase-order numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopledger.functions.cleaning import strip_ws

# Labels used when a line carries no vendor or order number.
NO_VENDOR = "Sin Vendor"
NO_PO = "Sin P/O"


def code_part(c: Column) -> Column:
    """The code in front of the first ``' - '``."""
    return F.split_part(c, F.lit(" - "), F.lit(1))


def vendor_name(c: Column) -> Column:
    """Vendor between the words ``Vendor`` and ``P/O``, without commas and spaces around it."""
    name = strip_ws(F.btrim(F.substring_index(_after(c, "Vendor"), "P/O", 1), F.lit(", ")))
    return F.when(F.contains(c, F.lit("Vendor")), name).otherwise(F.lit(NO_VENDOR))


def po_number(c: Column) -> Column:
    """Order number between ``P/O #`` and the next comma."""
    number = strip_ws(F.substring_index(_after(c, "P/O #"), ",", 1))
    return F.when(F.contains(c, F.lit("P/O #")), number).otherwise(F.lit(NO_PO))


def _after(c: Column, mark: str) -> Column:
    """What follows the first mark, up to a second one; bytes are compared, no pieces are made."""
    return F.substring_index(F.substring_index(c, mark, 2), mark, -1)
