"""Scalar functions of the domain as column expressions: they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Emission curve (g/km at v km/h), slope effect, capacity of a lane per day, log-normal trip times.
CO2_A, CO2_B, CO2_C, SLOPE, SLOWEST, FALLBACK_SPEED = 2400.0, 120.0, 0.004, 5.0, 2520.0, 40.0
LANE_CAPACITY, LOG_MU, LOG_SIGMA = 50_000.0, 6.85, 0.83
WASTE_TYPES = {"DI": "Incinerable", "DV": "Garden", "PC": "Paper and cardboard", "VE": "Glass"}


def lookup(code: Column, names: dict, default: Column) -> Column:
    """The name of a code, by CASE; default where it is unknown."""
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(default)


def speed_or_default(speed: Column, default: float = 30.0) -> Column:
    """The speed; one that is missing or not positive is the default."""
    return F.when(speed > 0, speed).otherwise(F.lit(default))


def free_flow_time(length_m: Column, speed_kph: Column) -> Column:
    """Seconds; null at a standstill."""
    return F.try_divide(length_m, speed_kph / 3.6)


def speed_from_time(length_m: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, length_m / seconds * 3.6)


def elevation_gain(z_u: Column, z_v: Column) -> Column:
    """Metres climbed; null unless both ends are known."""
    return F.when(z_u.isNotNull() & z_v.isNotNull(), F.greatest(F.lit(0.0), z_v - z_u))


def co2_per_km(speed_kph: Column) -> Column:
    """Grams a kilometre."""
    return F.when(speed_kph <= 0, F.lit(SLOWEST)).otherwise(F.lit(CO2_A) / speed_kph + CO2_B + F.lit(CO2_C) * speed_kph * speed_kph)


def edge_co2(length_m: Column, speed_kph: Column, gain_m: Column, seconds: Column) -> Column:
    """Grams on an edge: at its speed, else the one its time implies, else the fallback; climbing adds. A speed
    that is not positive is missing."""
    implied = F.when((seconds > 0) & (length_m > 0), length_m / seconds * 3.6)
    speed = F.coalesce(F.when(speed_kph > 0, speed_kph), implied, F.lit(FALLBACK_SPEED))
    climb = F.when((gain_m > 0) & (length_m > 0), 1 + F.lit(SLOPE) * gain_m / length_m).otherwise(1.0)
    return F.when(length_m <= 0, 0.0).otherwise(length_m / 1000 * co2_per_km(speed) * climb)


def congested_speed(speed_kph: Column, volume: Column, lanes: Column) -> Column:
    """Hyperbolic slowdown by vehicles a day per lane."""
    return speed_kph / (1 + volume / (lanes * F.lit(LANE_CAPACITY)))


def congested_time(length_m: Column, speed_kph: Column, volume: Column, lanes: Column, missing_length: float | None = None, standstill: Column | None = None) -> Column:
    """Seconds. A missing speed is 30 km/h; a missing length counts as missing_length (1 m by betweenness, nothing by
    volume), and where the speed leaves no time, standstill does."""
    length = length_m if missing_length is None else F.coalesce(length_m.cast("double"), F.lit(missing_length))
    seconds = free_flow_time(length, congested_speed(speed_or_default(speed_kph), volume, lanes))
    return seconds if standstill is None else F.coalesce(seconds, standstill)


def lanes_of(lanes: Column) -> Column:
    """First listed number of lanes as a whole number, else 2."""
    return F.coalesce(F.get(lanes, F.lit(0)).try_cast("int"), F.lit(2))


def lognormal_density(t: Column, mu: float = LOG_MU, sigma: float = LOG_SIGMA) -> Column:
    z = (F.log(t) - mu) / sigma
    return F.when(t > 0, F.exp(-z * z / 2) / (t * sigma * F.sqrt(2 * F.pi()))).otherwise(0.0)


def lognormal_mode(mu: float = LOG_MU, sigma: float = LOG_SIGMA) -> Column:
    return F.exp(F.lit(mu) - F.lit(sigma) * F.lit(sigma))


def delta(old: Column, new: Column) -> Column:
    """new - old; null where either is null or zero."""
    return F.when((old != 0) & (new != 0), new - old)


def delta_percent(old: Column, new: Column) -> Column:
    return F.when((old != 0) & (new != 0), (new - old) / old * 100)


def relative_delta(value: Column, change: Column) -> Column:
    """Percent of what there was before the change, with a guard against nothing."""
    before = value - change
    return F.when(F.abs(before) > 0.0001, change / before * 100).otherwise(0.0)


def symlog(x: Column, constant: float = 10.0) -> Column:
    return F.signum(x) * F.log(1 + F.abs(x) / constant)


def symlog_inverse(y: Column, constant: float = 10.0) -> Column:
    return F.signum(y) * F.lit(constant) * (F.exp(F.abs(y)) - 1)


def ramp(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between the stops, constant beyond them."""
    out = F.when(x <= stops[0][0], F.lit(stops[0][1]))
    for (a, p), (b, q) in zip(stops[:-1], stops[1:], strict=True):
        out = out.when(x <= b, F.lit(p) + (x - a) / (b - a) * (q - p))
    return out.otherwise(F.lit(stops[-1][1]))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def demand_kg(count: Column, kg: float) -> Column:
    """Whole kilograms, at least one."""
    return F.greatest(F.floor(count * F.lit(kg)).cast("long"), F.lit(1).cast("long"))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees times 111 km, longitudes shortened to 0.7."""
    dy, dx = (lat1 - lat2) * 111.0, (lon1 - lon2) * 111.0 * 0.7
    return F.sqrt(dx * dx + dy * dy)


def number(x: Column) -> Column:
    """Text as a number, null where it is none; a plain cast would also take suffixes such as 1F."""
    return F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double"))


def to_number(x: Column) -> Column:
    return F.coalesce(number(x), F.lit(0.0))


def extrusion(x: Column, factor: float) -> Column:
    return F.greatest(F.lit(2.0), x * F.lit(factor))


def vehicle_hue(vehicle: Column) -> Column:
    """A hue from the length and the first digits of an id; 16 stands for what is no number."""
    pair = lambda a: F.coalesce(number(F.substring(vehicle, a, 2)), F.lit(16.0))
    return F.pmod(F.length(vehicle) + pair(1) + pair(3), F.lit(360.0))


def day_of(date: Column) -> Column:
    return F.substring(date, 9, 2).cast("int")


def format_length(m: Column) -> Column:
    return F.when(m >= 1000, F.concat(F.format_string("%.2f", m / 1000), F.lit(" km"))).otherwise(F.concat(F.format_string("%.0f", m), F.lit(" m")))


def format_time(s: Column) -> Column:
    return F.when(s >= 60, F.concat(F.format_string("%.1f", s / 60), F.lit(" min"))).otherwise(F.concat(F.format_string("%.0f", s), F.lit(" s")))


def format_mass(g: Column) -> Column:
    return F.when(g >= 1000, F.concat(F.format_string("%.2f", g / 1000), F.lit(" kg"))).otherwise(F.concat(F.format_string("%.0f", g), F.lit(" g")))


def prettified(key: Column) -> Column:
    return F.initcap(F.regexp_replace(key, "_", " "))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A draw in [0, 1) fixed by seed and keys; the same in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 4294967296.0
