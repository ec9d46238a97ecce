"""Scores: rounding to even, clamping, ranks as percentiles, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_score(value: Column) -> Column:
    """0 to 100, rounded half to even, as a long. The value must not be null; it stands here once, so that nested scores stay small."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(value.cast("double")))).cast("long")


def score_or_null(value: Column) -> Column:
    """The same of a value that may be null, which stays null."""
    return F.when(value.isNotNull(), clamp_score(value))


def clamp_or(value: Column, default: int) -> Column:
    """A text as a score; what isn't a number gives the default."""
    return F.coalesce(score_or_null(value.try_cast("double")), F.lit(default).cast("long"))


def rank_to_percentile(rank: Column, size: Column) -> Column:
    """A rank in a group (1 is best) as 0 to 100; groups of one give 100."""
    return F.when(size < 2, F.lit(100).cast("long")).otherwise(clamp_score(100.0 * (size - rank) / F.when(size < 2, 1).otherwise(size - 1)))


def parse_ratio(text: Column) -> Column:
    """'30000/1001' or '25' as a double rounded to 4 places; 0 for junk and zero denominators."""
    top = F.split(text, "/")[0].try_cast("double")
    bottom = F.when(F.instr(text, "/") > 0, F.try_element_at(F.split(text, "/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    return F.coalesce(F.bround(F.try_divide(top, bottom), 4), F.lit(0.0))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees rounded to 6 places, negative in the south and west."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.bround(F.when(hemisphere.isin("S", "W"), -value).otherwise(value), 6) + 0.0


def shutter_text(seconds: Column) -> Column:
    """'1/250' below a second, '2.0s' from one on; null for none or zero."""
    return F.when(seconds >= 1, F.format_string("%.1fs", seconds)).when(seconds > 0, F.concat(F.lit("1/"), F.bround(1 / seconds).cast("long").cast("string")))


def seconds_between(a: Column, b: Column) -> Column:
    """Absolute distance of two zoneless timestamps in seconds; null if one is missing."""
    return F.abs(F.timestamp_diff("MICROSECOND", a, b)) / 1e6
