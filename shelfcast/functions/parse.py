"""Text to number and text to date, the way the ingest step needs them.

Spark's own casts accept strings such as ``1.0d``, ``nan`` or ``inf`` that the
sales contract treats as unparseable, and ANSI mode raises on bad input. Both
helpers are therefore a pattern test followed by a ``try_`` conversion, so a
bad cell becomes NULL and never fails the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number with optional sign, decimal point and
# exponent; blanks around it are allowed (trimmed first).
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# A time of day after the date, with or without zone; the day grain drops it.
_TIME = r"[T ]+([01]?[0-9]|2[0-3]):[0-5]?[0-9](:[0-5]?[0-9](\.[0-9]+)?)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?$"

# Default date layouts, tried in this order on text whose time of day is cut
# off and whose separators (. / - or blanks) are written as dots. Day-first,
# two-digit years fall in 1969-2068.
DATE_LAYOUTS = ("d.M.yyyy", "yyyy.M.d", "d.M.yy", "yyyyMMdd", "d.MMM.yyyy", "d.MMMM.yyyy")


def parse_number(col: Column | str) -> Column:
    """NULL unless the trimmed text is a plain decimal number."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def parse_day_first_date(col: Column | str, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """First of ``layouts`` that parses the normalised text, as DATE; else NULL."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    c = F.regexp_replace(F.regexp_replace(c, _TIME, ""), r"\s*[./-]\s*|\s+", ".")
    found = []
    for layout in layouts:
        date = F.try_to_timestamp(c, F.lit(layout)).cast("date")
        if "yy" in layout and "yyyy" not in layout:  # parsed into 2000-2099
            date = F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)
        found.append(date)
    return F.coalesce(*found)


def nan_to_null(col: Column) -> Column:
    """Spark orders NaN above every number (``NaN > 0`` is true); make it NULL."""
    return F.when(~F.isnan(col), col)
