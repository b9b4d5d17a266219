"""Derived quantities as column expressions; a division by zero is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def unbalance_pct(a: Column, b: Column, c: Column) -> Column:
    """The largest distance of three phases from their mean, in per cent of it."""
    mean = (a + b + c) / 3
    return F.try_divide(F.greatest(F.abs(a - mean), F.abs(b - mean), F.abs(c - mean)), mean) * 100


def three_phase_kw(volts: Column, amps: Column, power_factor: Column) -> Column:
    """Active power from line-to-line voltage, current and power factor."""
    return F.sqrt(F.lit(3.0)) * volts * amps * power_factor / 1000


def delta_t(return_c: Column, supply_c: Column, plant_load: Column, least: float) -> Column:
    """Chilled-water difference, only where the plant carries more than `least`."""
    return F.when(plant_load > least, return_c - supply_c)


def kw_per_kw(power_kw: Column, cooling_kw: Column) -> Column:
    return F.try_divide(power_kw, cooling_kw)


def cop(power_kw: Column, cooling_kw: Column) -> Column:
    return F.try_divide(F.lit(1.0), kw_per_kw(power_kw, cooling_kw))


def cooling_from_flow(litres_per_min: Column, delta: Column) -> Column:
    """Cooling power of a water flow, in kW."""
    return 4.186 * (litres_per_min / 60) * delta


def pump_head(supply_bar: Column, return_bar: Column, speed_pct: Column) -> Column:
    """Pressure rise at full speed: head goes with the square of the speed."""
    return F.try_divide(supply_bar - return_bar, (speed_pct / 100) * (speed_pct / 100))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def tod_slot(ts: Column, step: int) -> Column:
    """The cell of the day, from 0, in local time."""
    return F.floor(minute_of_day(ts) / step).cast("int")


def day_type(date: Column, holiday: Column) -> Column:
    """holiday before saturday before off (Sunday) before workday."""
    return F.when(holiday, "holiday").when(F.weekday(date) == 5, "saturday").when(F.weekday(date) == 6, "off").otherwise("workday")


def deviation_pct(observed: Column, reference: Column) -> Column:
    return F.round(F.try_divide(observed - reference, reference) * 100, 1)


def waste_per_month(observed: Column, expected: Column, hours: Column, days: Column) -> Column:
    """An aggregate: what was used above expectation, scaled to 30 days."""
    return F.try_divide(F.sum(F.greatest(observed - expected, F.lit(0.0)) * hours), F.max(days)) * 30


def document_id(prefix: str, issued: Column, number: Column, width: int) -> Column:
    """The number is padded to `width`; a longer one keeps all its digits, as lpad alone would cut it."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix + "-"), F.date_format(issued, "yyyyMMdd"), F.lit("-"), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0"))


def iso_at(ts: Column, offset: str) -> Column:
    """A site's wall time as ISO 8601 with the site's offset, whatever the session's zone."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def iso(ts: Column) -> Column:
    """ISO 8601 with the offset of the session's zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def step_of(value: Column, by: tuple[str, ...], order: str = "ts", capacity: Column | None = None) -> Column:
    """The rise of a counter since the row before; null at the first row and where it falls.

    capacity: where a counter begins again after that value, a fall is a rise over it.
    """
    d = value - F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return F.when(d >= 0, d) if capacity is None else F.when(d >= 0, d).otherwise(d + capacity)


def whole_sum(c: Column) -> Column:
    """An aggregate: the sum of all parts, null if one of them is missing (the power of a plant)."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def kwh_per_m3(kwh: Column, m3: Column) -> Column:
    return F.try_divide(kwh, m3)


def reactive_penalty(kvarh: Column, kwh: Column, free: float, price: float) -> Column:
    """What reactive energy beyond a free share of the active energy costs."""
    return F.greatest(kvarh - free * kwh, F.lit(0.0)) * price


def sentence(template: str, *parts: Column) -> Column:
    """A text for the operator from a template."""
    return F.format_string(template, *parts)
