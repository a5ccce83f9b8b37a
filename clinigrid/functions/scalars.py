"""Column expressions: keys, weeks, waves, rates and labels. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinigrid.dims import WAVE_ANCHOR, Wave


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- keys ---------------------------------------------------------------------------

def pad_left(c: Column | str, width: int, pad: str = "0") -> Column:
    """Left pad that never shortens; ``lpad`` alone would cut longer values."""
    text = _col(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, pad)).otherwise(text)


def geo_key(state_or_code: Column | str, municipality: Column | str | None = None) -> Column:
    """Five-character area key from (state, municipality) or from one joined code."""
    if municipality is None:
        return pad_left(state_or_code, 5)
    return F.concat(pad_left(state_or_code, 2), pad_left(municipality, 3))


# --- numbers and dates --------------------------------------------------------------

def to_number(c: Column | str) -> Column:
    """Text to double; text that is no number is missing."""
    return _col(c).try_cast("double")


def to_day(c: Column | str) -> Column:
    """Text or date to date; text that is no date (``9999-99-99``) is missing."""
    return _col(c).try_cast("date")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, missing when b is 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def percent(a: Column | str, b: Column | str) -> Column:
    return per(100, a, b)


def per(units: float, a: Column | str, b: Column | str) -> Column:
    """``units * a / b``, e.g. ``per(100_000, beds, people)``."""
    return F.try_divide(F.lit(float(units)) * _col(a).cast("double"), _col(b).cast("double"))


def missing_to_zero(c: Column | str) -> Column:
    column = _col(c)
    return F.when(column.isNull() | F.isnan(column.cast("double")), F.lit(0)).otherwise(column)


# --- epidemiological time -----------------------------------------------------------

def _wednesday(day: Column | str) -> Column:
    """Wednesday of the Sunday-to-Saturday week of ``day``; it decides the week's year."""
    d = _col(day)
    return F.date_add(d, F.lit(4) - F.dayofweek(d))


def epi_week(day: Column | str) -> Column:
    return (F.floor((F.dayofyear(_wednesday(day)) - 1) / 7) + 1).cast("int")


def epi_year_week(day: Column | str) -> Column:
    """``2021-07``; missing for a missing day."""
    return F.concat(F.year(_wednesday(day)).cast("string"), F.lit("-"), pad_left(epi_week(day), 2))


def week_ordinal(day: Column | str, anchor: date = WAVE_ANCHOR) -> Column:
    """Running week number; 1 is the week that opens on the anchor Sunday."""
    return (F.floor(F.datediff(_col(day), F.lit(anchor)) / 7) + 1).cast("int")


def _wave_chain(ordinal: Column, waves: Sequence[Wave], value) -> Column:
    ordered = sorted(waves, key=lambda w: w.stop)
    first, *rest = ordered
    chain = F.when(ordinal < first.stop, F.lit(value(first)))
    return reduce(lambda acc, w: acc.when(ordinal < w.stop, F.lit(value(w))), rest, chain)


def wave_label(ordinal: Column | str, waves: Sequence[Wave]) -> Column:
    """Wave of a week ordinal; missing past the last wave. Weeks before 1 are wave 1."""
    return _wave_chain(_col(ordinal), waves, lambda w: w.ola)


def wave_days(ola: Column | str, waves: Sequence[Wave]) -> Column:
    column = _col(ola)
    chain = F.when(F.lit(False), F.lit(0))
    return reduce(lambda acc, w: acc.when(column == w.ola, F.lit(w.dias_ola)), waves, chain)


# --- predicates and labels ----------------------------------------------------------

def matches(c: Column | str, pattern: str) -> Column:
    """Regex test that ignores case for accented letters too."""
    return _col(c).rlike(f"(?iu){pattern}")


def not_in(c: Column | str, values: Iterable) -> Column:
    """Negated membership that keeps missing values."""
    return ~F.coalesce(_col(c).isin(*values), F.lit(False))


def bucket_label(c: Column | str, bounds: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first bound that ``c`` exceeds, else ``default``."""
    column = _col(c)
    chain = reduce(
        lambda acc, b: acc.when(column > b[0], F.lit(b[1])),
        sorted(bounds, reverse=True), F.when(F.lit(False), F.lit(default)),
    )
    return chain.otherwise(F.lit(default))


def first_match_label(c: Column | str, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that occurs in ``c``, ignoring case."""
    chain = reduce(
        lambda acc, p: acc.when(matches(c, p[0]), F.lit(p[1])),
        patterns, F.when(F.lit(False), F.lit(default)),
    )
    return chain.otherwise(F.lit(default))


def label_lookup(c: Column | str, labels: Mapping[str, str]) -> Column:
    """Display name of a code, from a small literal mapping; unknown codes are missing."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def capitalise(c: Column | str) -> Column:
    """First letter upper case, the rest as it is."""
    column = _col(c)
    return F.concat(F.upper(F.substring(column, 1, 1)), F.substring(column, 2, 2**31 - 1))
