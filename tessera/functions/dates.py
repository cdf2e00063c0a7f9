"""Date parsing and calendar expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed list of accepted text layouts, tried in order (first match wins).
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
    "yyyy-MM-dd'T'HH:mm:ssX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSX",
    "yyyy-MM-dd'T'HH:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "d/M/yyyy",
    "d-M-yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)


#: What a value must hold for a layout to be worth a try.
_MARKS = "/.:,T-"


def _tried(s: Column, layout: str) -> Column:
    """``s`` read in one layout, null where it does not fit (never raises,
    also under ANSI mode).  Values without the layout's separators are not
    parsed at all: a failing parse costs many times a passing one."""
    marks = [m for m in _MARKS if m in layout.replace("'T'", "T")]
    fits = F.lit(True)
    for m in marks:
        fits = fits & F.contains(s, F.lit(m))
    return F.when(fits, F.try_to_timestamp(s, F.lit(layout)))


def parse_timestamp(x: Column, formats: list[str] | tuple[str, ...] | None = None) -> Column:
    """Text as timestamp in the first of ``formats`` that fits (default: all
    known layouts, in their fixed order); null where none does."""
    s = F.trim(x.cast("string"))
    order = list(DATE_FORMATS if formats is None else formats)
    return F.coalesce(*[_tried(s, f) for f in order]) if order else F.lit(None).cast("timestamp")


def layout_readings(x: Column) -> list[Column]:
    """The value read in every known layout, in their fixed order."""
    s = F.trim(x.cast("string"))
    return [_tried(s, f) for f in DATE_FORMATS]


def calendar_columns(x: Column) -> dict[str, Column]:
    """year, month, quarter, ISO week, day, day of week (Monday = 0), weekend."""
    dow = (F.dayofweek(x) + 5) % 7
    return {
        "year": F.year(x),
        "month": F.month(x),
        "quarter": F.quarter(x),
        "week": F.weekofyear(x),
        "day": F.dayofmonth(x),
        "dayofweek": dow,
        "weekend": F.when(x.isNotNull(), (dow >= 5).cast("int")),
    }
