"""Timestamps as text, each by its own shape: one column may mix forms.

A text is matched against the shapes of a date, with an optional time and zone behind it; the parts are put together as numbers, so
a day or hour out of range is no timestamp. Numeric dates are year first, or month first as long as the month can be one, else
day first. A text of another shape, with a two-digit year for one, is refused rather than guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_short = lambda names: "|".join(f"{n[:3]}(?:{n[3:]})?" if n[3:] else n for n in names)
_MONTH = f"({_short(MONTHS)}|sept)\\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = f"(?:(?:{_short(DAYS)})\\.?,?\\s+)?"
_TIME = r"(?:(?:t|\s+|,\s*)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(am|pm)?\s*(z|utc|gmt|[+-](?:0\d|1[0-8]):?[0-5]\d|[+-](?:0\d|1[0-8]))?)?"
#: Shapes of a date, and which of year, month and day its groups are (n: a month by name).
SHAPES = (
    (r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", "y-md"),
    (r"(\d{4})(\d{2})(\d{2})", "ymd"),
    (r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})", "m-dy"),
    (_WEEKDAY + _MONTH + r"[\s-]+" + _DAY + r"(?:,\s*|[\s-]+)(\d{4})", "ndy"),
    (_WEEKDAY + _DAY + r"[\s-]*" + _MONTH + r"[,\s-]+(\d{4})", "dny"),
    (r"(\d{4})[\s-]+" + _MONTH + r"[\s-]+" + _DAY, "ynd"),
    (r"(\d{4})-(\d{2})", "ym"),
    (r"(\d{4})", "y"),
)


def parse_time(text: str | Column) -> Column:
    """A timestamp, null if the text has none of the shapes; a time without a zone is UTC, digits behind the microsecond are cut."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(*(F.when(c.rlike(_whole(shape)), _made(c, _whole(shape), parts)) for shape, parts in SHAPES))


def _whole(shape: str) -> str:
    return f"(?i)^{shape}{_TIME}$"


def _made(c: Column, pattern: str, parts: str) -> Column:
    group = lambda k: F.regexp_extract(c, pattern, k)
    number = lambda k: F.coalesce(F.nullif(group(k), F.lit("")).cast("int"), F.lit(0))
    at = {part: k for k, part in enumerate(parts, 1)}
    year = number(at["y"])
    month = number(at["m"]) if "m" in at else F.lit(1)
    if "n" in at:
        names = [F.lit(n[:3]) for n in MONTHS]
        month = F.array_position(F.array(*names), F.lower(F.substring(group(at["n"]), 1, 3))).cast("int")
    day = number(at["d"]) if "d" in at else F.lit(1)
    if parts[0] == "m":  # a first number that is no month is the day
        month, day = F.when(month > 12, day).otherwise(month), F.when(month > 12, month).otherwise(day)
    hour, minute, second, fraction, half, zone = (len(parts) + k for k in range(1, 7))
    h, am_pm = number(hour), F.lower(group(half))
    h = F.when(am_pm == "", h).when(h.between(1, 12), h % 12 + F.when(am_pm == "pm", 12).otherwise(0))
    seconds = F.concat(F.lpad(number(second).cast("string"), 2, "0"), F.lit("."), F.rpad(F.substring(group(fraction), 1, 6), 6, "0")).cast("decimal(16,6)")
    z = group(zone)
    offset = F.regexp_replace(z, r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    offset = F.when(z.rlike(r"^[+-]\d{2}$"), F.concat(z, F.lit(":00"))).when(z.rlike(r"^[+-]"), offset).otherwise("UTC")
    return F.try_make_timestamp(year, month, day, h, number(minute), seconds, offset)
