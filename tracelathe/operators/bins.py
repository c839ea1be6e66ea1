"""Widths of bins for sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one bin, if they are spread evenly.
ROWS_PER_BIN = 20_000


def bin_width(rows: DataFrame, at: str, each: int = ROWS_PER_BIN) -> int | float:
    """A width for bins of about `each` rows, from the extremes and the count of a column, in its own unit; whole numbers for integers.

    Sweeps that keep a row per bin then have rows / each of these, whatever the time range.
    """
    low, high, n = rows.agg(F.min(at), F.max(at), F.count(at)).first()
    if not n or low == high:
        return 1
    bins = max(1, n // each)
    return -(-(high - low + 1) // bins) if isinstance(low, int) else float(high - low) / bins
