"""Column expressions: calendar, geometry, cleaning, clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: calendar and sphere
SECONDS_IN_YEAR = 31_536_000
SECONDS_IN_MONTH = 2_628_000
EARTH_RADIUS_M = 6_371_000.0
DAYS_IN_MONTH = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
STANDARD_GRAVITY = 9.80665
# fixed values: trailing characters that do not belong to a glacier name
TRAILING_JUNK = "ÀÈè\x9c3Ð°¾\r\x93¤0`/C@Å\x06\x10^å;"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col) -> Column:
    """NULL is the only missing value inside the engine."""
    c = _c(col)
    return F.when(F.isnan(c), None).otherwise(c)


def clip(col, lo=None, hi=None) -> Column:
    c = _c(col)
    if lo is not None:
        c = F.when(c < lo, F.lit(lo)).otherwise(c)
    if hi is not None:
        c = F.when(c > hi, F.lit(hi)).otherwise(c)
    return c


def steady_sum(col) -> Column:
    """Sum in three limbs (whole, 2^-21 steps, rest), an aggregate.

    Each limb adds up without rounding for numbers that are multiples of 2^-41 with sums below
    2^53, so that the order of the rows doesn't show in the last digit.
    """
    c = _c(col)
    part = c % 1.0
    fine = part * float(1 << 21)
    rest = fine % 1.0
    return F.sum(c - part) + (F.sum(fine - rest) + F.sum(rest)) / float(1 << 21)


def nice_number(col, binsize: float, lower: bool = False) -> Column:
    """Next multiple of ``binsize`` strictly above, or the one at or below."""
    step = F.floor(_c(col) / F.lit(binsize))
    return (step if lower else step + 1) * F.lit(binsize)


def days_since(ts, ref: str) -> Column:
    """Whole days from the reference date."""
    return F.date_diff(F.to_date(_c(ts)), F.lit(ref).cast("date"))


def date_of(day, ref: str) -> Column:
    return F.date_add(F.lit(ref).cast("date"), _c(day).cast("int"))


def mid_day(start, end) -> Column:
    """Truncated middle of two relative days."""
    return ((_c(start) + _c(end)) / 2).cast("int")


def month_index(date) -> Column:
    """Months since year 0, an integer key for calendar months."""
    d = _c(date)
    return F.year(d) * 12 + F.month(d) - 1


def year_fraction(date) -> Column:
    d = _c(date)
    length = F.date_diff(F.make_date(F.year(d) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(d), F.lit(1), F.lit(1)))
    return F.year(d) + (F.dayofyear(d) - 1) / length


def date_to_floatyear(year, month) -> Column:
    return _c(year) + (_c(month) - 1) * F.lit(SECONDS_IN_MONTH / SECONDS_IN_YEAR)


def floatyear_to_date(value) -> tuple[Column, Column]:
    """(year, month) in the 365-day calendar with twelve equal months."""
    v = _c(value)
    whole = F.floor(v)
    # seconds are rounded first so that float years written by
    # date_to_floatyear come back to the same month
    sec = F.round((v - whole) * SECONDS_IN_YEAR).cast("long")
    over = sec == SECONDS_IN_YEAR
    year = F.when(over, whole + 1).otherwise(whole).cast("int")
    month = F.when(over, 1).otherwise(F.floor(sec / SECONDS_IN_MONTH) + 1).cast("int")
    return year, month


def hydro_to_calendar(year, month, start_month: int) -> tuple[Column, Column]:
    y, m = _c(year), _c(month)
    e = 13 - start_month
    first = m <= e
    back = 0 if start_month == 1 else 1
    return (
        F.when(first, y - back).otherwise(y).cast("int"),
        F.when(first, m + (start_month - 1)).otherwise(m - e).cast("int"),
    )


def calendar_to_hydro(year, month, start_month: int) -> tuple[Column, Column]:
    y, m = _c(year), _c(month)
    late = m >= start_month
    ahead = 0 if start_month == 1 else 1
    return (
        F.when(late, y + ahead).otherwise(y).cast("int"),
        F.when(late, m - (start_month - 1)).otherwise(m + (13 - start_month)).cast("int"),
    )


def wrap_lon_180(lon) -> Column:
    c = _c(lon)
    return F.when(c > 180, c - 360).otherwise(c)


def wrap_lon_360(lon) -> Column:
    c = _c(lon)
    return F.when(c < 0, c + 360).otherwise(c)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres."""
    lo1, la1, lo2, la2 = (F.radians(_c(x)) for x in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def speed(vx, vy) -> Column:
    return F.sqrt(_c(vx) * _c(vx) + _c(vy) * _c(vy))


def title_case(col) -> Column:
    """Upper case for each letter that does not follow a letter."""
    chars = F.split(F.lower(_c(col)), "")
    after_letter = lambda i: F.coalesce(F.get(chars, i - 1), F.lit("")).rlike("\\p{L}")
    return F.array_join(F.transform(chars, lambda ch, i: F.when(after_letter(i), ch).otherwise(F.upper(ch))), "")


def clean_name(col) -> Column:
    """Drop junk at the end of a name, trim, title case; NULL becomes ''."""
    junk = "".join("\\" + ch if ch in "^]\\/`-" else ch for ch in TRAILING_JUNK)
    stripped = F.regexp_replace(_c(col), f"[{junk}]+$", "")
    return F.coalesce(title_case(F.trim(stripped)), F.lit(""))


def kelvin_to_celsius(col) -> Column:
    return _c(col) - 273.15


def days_in_real_month(date) -> Column:
    return F.day(F.last_day(_c(date)))


def days_in_fixed_month(month) -> Column:
    """Days of a month in the calendar without leap years."""
    return F.element_at(F.array(*[F.lit(d) for d in DAYS_IN_MONTH]), _c(month).cast("int"))
