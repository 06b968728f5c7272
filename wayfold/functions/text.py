"""Parsing and formatting rules as column expressions. Absent values stay apart from zero: they read as a placeholder, or null."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of a time.
CLOCK = r"^(\d+):(\d{1,2})(?::(\d{1,2}))?(\.\d+)?$"
UNITS = r"(?i)^(?:(\d+(?:\.\d+)?)h)?(?:(\d+(?:\.\d+)?)m)?(?:(\d+(?:\.\d+)?)s)?$"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
OFFSET = r"^(?:UTC|utc)?([+-])(\d{1,2})(?::?(\d{2}))?$"

#: unit -> (units in a metre or metre a second, fixed values)
DISTANCE = {"m": 1.0, "km": 1 / 1000, "mi": 1 / 1609.344, "nm": 1 / 1852.0, "ft": 1 / 0.3048}
SPEED = {"m/s": 1.0, "km/h": 3.6, "mph": 3600 / 1609.344, "kn": 3600 / 1852.0}
PACE = {"min/km": 1000.0, "min/mi": 1609.344}


@dataclass(frozen=True)
class Units:
    """The unit of each quantity: ``Units.of("imperial", ["distance=nm"])`` is a system with one quantity's unit put over it."""

    distance: str = "km"
    elevation: str = "m"
    speed: str = "km/h"
    pace: str = "min/km"

    @classmethod
    def of(cls, system: str = "metric", each: Iterable[str] = ()) -> Units:
        systems = {"": cls(), "metric": cls(), "imperial": cls("mi", "ft", "mph", "min/mi")}
        known = {"distance": ("km", "mi", "nm"), "elevation": ("m", "ft"), "speed": tuple(SPEED), "pace": tuple(PACE)}
        if system not in systems:
            raise ValueError(f"unknown units {system!r}: metric or imperial")
        out = systems[system]
        for spec in each:
            quantity, _, unit = spec.partition("=")
            if unit not in known.get(quantity, ()):
                raise ValueError(f"{spec!r} is no quantity=unit: " + "; ".join(f"{q}={'|'.join(u)}" for q, u in known.items()))
            out = replace(out, **{quantity: unit})
        return out


METRIC = Units()


def _number(c: Column) -> Column:
    return F.when(c != "", c.cast("double"))


def fixed(v: Column, decimals: int) -> Column:
    """Fixed decimals, rounded as the exact binary value says (2.675 is a little less, so 2.67; a true half to even), and never a negative zero.

    v x 10^decimals is known exactly as a product and its rounding error, so a product that looks like a half is told from one that is.
    """
    c = float(10**decimals)
    x = v.cast("double")
    product = x * c
    split = 134217729.0 * x
    high = split - (split - x)
    error = (high * c - product) + (x - high) * c
    low = F.floor(product).cast("double")
    part = product - low
    odd = F.pmod(low, F.lit(2.0)) != 0
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd)))
    whole = (low + F.when(up, 1.0).otherwise(0.0)).cast("decimal(28,0)")
    return (whole * F.lit(Decimal(1).scaleb(-decimals))).cast(f"decimal(38,{decimals})").cast("string")


def clock_seconds(s: Column) -> Column:
    """Seconds of m:ss or h:mm:ss with a fraction; null where a part that isn't the leading one is 60 or more."""
    part = lambda i: F.regexp_extract(s, CLOCK, i)
    short = part(3) == ""
    last = F.concat(F.when(short, part(2)).otherwise(part(3)), part(4)).cast("double")
    middle = F.when(short, 0.0).otherwise(_number(part(2)))
    total = F.when(short, _number(part(1)) * 60).otherwise(_number(part(1)) * 3600 + middle * 60) + last
    return F.when(s.rlike(CLOCK) & (last < 60) & (middle < 60), total)


def unit_seconds(s: Column) -> Column:
    """Seconds of 1h2m3.5s; null where nothing is given."""
    part = lambda i, k: F.coalesce(_number(F.regexp_extract(s, UNITS, i)), F.lit(0.0)) * k
    return F.when(s.rlike(UNITS) & (s != ""), part(1, 3600) + part(2, 60) + part(3, 1))


def time_seconds(text: Column) -> Column:
    """Seconds of a relative time; null for all else (see ``time_instant``). No sign, NaN, infinity, hexadecimal or underscore."""
    s = F.trim(text)
    plain = F.when(s.rlike(NUMBER), s.try_cast("double"))
    return F.when(plain.isNotNull(), F.when(plain >= 0, plain)).otherwise(F.coalesce(clock_seconds(s), unit_seconds(s)))


def time_instant(text: Column) -> Column:
    """The instant of a timestamp that names its zone; null for all else."""
    s = F.trim(text)
    return F.when(s.rlike(STAMP), F.replace(s, F.lit(" "), F.lit("T")).try_cast("timestamp"))


def time_kind(text: Column) -> Column:
    """unset, relative, absolute or invalid."""
    return F.when(F.trim(text) == "", "unset").when(time_seconds(text).isNotNull(), "relative").when(time_instant(text).isNotNull(), "absolute").otherwise("invalid")


def segment_seconds(text: Column) -> Column:
    """A length: the grammar of times without timestamps."""
    return time_seconds(text)


def offset_seconds(text: Column) -> Column:
    """Seconds of an offset literal; null for ``auto`` and what isn't a finite number."""
    s = F.trim(text)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def utc_offset(text: Column) -> Column:
    """Seconds east of UTC of +h, +hh:mm or UTC+hhmm."""
    part = lambda i: F.regexp_extract(text, OFFSET, i)
    size = _number(part(2)) * 3600 + F.coalesce(_number(part(3)), F.lit(0.0)) * 60
    return F.when(text.rlike(OFFSET), F.when(part(1) == "-", -size).otherwise(size).cast("int"))


def in_zone(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def position(lat: Column, lon: Column, altitude: Column | None = None) -> Column:
    """ISO 6709: +DD.DDDD+DDD.DDDD[+A.AAA]/"""
    text = F.format_string("%+08.4f%+09.4f", lat, lon)
    if altitude is not None:
        text = F.concat(text, F.coalesce(F.format_string("%+08.3f", altitude), F.lit("")))
    return F.concat(text, F.lit("/"))


def creation_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def elapsed(seconds: Column) -> Column:
    """H:MM:SS, hours unpadded and not wrapped; a negative span reads 0."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))))


def minutes(seconds: Column) -> Column:
    """M:SS, cut to the second."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60))))


def _short(span: Column, units: Units) -> Column:
    """Whether an axis is labelled in the short unit (metres, feet): where it spans less than one of the long."""
    return span * DISTANCE[units.distance] < 1.0


def axis_label(d: Column, span: Column, decimals: int, units: Units = METRIC) -> Column:
    """Whole short units where the axis spans less than one of the long, else long units with ``decimals``. ``d`` and ``span`` are metres."""
    short = F.concat(fixed(d * DISTANCE[units.elevation], 0), F.lit(f" {units.elevation}"))
    return F.when(_short(span, units), short).otherwise(F.concat(fixed(d * DISTANCE[units.distance], decimals), F.lit(f" {units.distance}")))


def readout(d: Column, span: Column, units: Units = METRIC) -> Column:
    """A live value in the unit its axis is labelled in, without the unit: whole short ones, long ones with a decimal."""
    return F.when(_short(span, units), fixed(d * DISTANCE[units.elevation], 0)).otherwise(fixed(d * DISTANCE[units.distance], 1))


def reads_as_zero(d: Column, span: Column, decimals: int, units: Units = METRIC) -> Column:
    return axis_label(d, span, decimals, units) == axis_label(F.lit(0.0), span, decimals, units)


def elevation_axis_labels(start: Column, end: Column, units: Units = METRIC) -> Column:
    """[start, end]: a decimal under ten long units of span, or where the start would read as zero without one and not with it."""
    span = end - start
    one = (span * DISTANCE[units.distance] < 10.0) | (reads_as_zero(start, span, 0, units) & ~reads_as_zero(start, span, 1, units))
    pick = lambda d: F.when(one, axis_label(d, span, 1, units)).otherwise(axis_label(d, span, 0, units))
    return F.array(pick(start), pick(end))


def elevation_label(e: Column, span: Column, units: Units = METRIC) -> Column:
    """A decimal where the range is under ten of the elevation unit; ``e`` and ``span`` are metres."""
    k = DISTANCE[units.elevation]
    return F.concat(F.when(span * k < 10.0, fixed(e * k, 1)).otherwise(fixed(e * k, 0)), F.lit(f" {units.elevation}"))


def elevation_range_labels(low: Column, high: Column, units: Units = METRIC) -> Column:
    """[high, low], or the middle alone where they are less than a metre apart."""
    span = high - low
    return F.when(span < 1.0, F.array(elevation_label((low + high) / 2, span, units))).otherwise(F.array(elevation_label(high, span, units), elevation_label(low, span, units)))


def or_placeholder(v: Column, unit: str, pattern: str = "%d") -> Column:
    return F.coalesce(F.when(v.isNotNull(), F.format_string(f"{pattern} {unit}", v)), F.lit(f"-- {unit}"))


def heart_rate(v: Column) -> Column:
    return or_placeholder(v, "bpm")


def power(developer: Column, native: Column, source: str = "auto") -> Column:
    """Watts: the developer field before the native one, or only the one asked for."""
    v = {"auto": F.coalesce(developer, native), "developer": developer, "native": native}[source]
    return or_placeholder(F.round(v).cast("long"), "W")


def cadence(v: Column, sport: Column) -> Column:
    """Steps a minute on foot (twice the recorded strides), else revolutions."""
    on_foot = sport.isin("running", "walking", "hiking")
    return F.when(v.isNull(), F.when(on_foot, "-- spm").otherwise("-- rpm")).when(on_foot, F.format_string("%d spm", v * 2)).otherwise(F.format_string("%d rpm", v))


def speed(v: Column, unit: str = "km/h") -> Column:
    """One decimal under 10, none from there on."""
    x = v * SPEED[unit]
    return F.when(v.isNull(), f"-- {unit}").when(x < 10, F.concat(fixed(x, 1), F.lit(f" {unit}"))).otherwise(F.concat(fixed(x, 0), F.lit(f" {unit}")))


def pace(v: Column, unit: str = "min/km") -> Column:
    """M:SS for a kilometre or mile, rounded to the second; a placeholder when standing."""
    s = F.round(PACE[unit] / F.when(v > 0, v)).cast("long")
    return F.coalesce(F.concat(minutes(s), F.lit(unit.removeprefix("min"))), F.lit(f"--:--{unit.removeprefix('min')}"))


def incline(grade: Column) -> Column:
    return F.coalesce(F.concat(fixed(grade * 100, 1), F.lit("%")), F.lit("--%"))


def metric_rows(*rows: Column, optional: tuple[Column, ...] = ()) -> Column:
    """The rows in order, then the optional ones that aren't null."""
    return F.filter(F.array(*rows, *optional), lambda x: x.isNotNull())


def gain_loss(gain: Column, loss: Column, units: Units = METRIC) -> Column:
    k, unit = DISTANCE[units.elevation], F.lit(f" {units.elevation}")
    return F.array(F.concat(F.lit("+"), F.coalesce(fixed(gain * k, 0), F.lit("--")), unit), F.concat(F.lit("-"), F.coalesce(fixed(loss * k, 0), F.lit("--")), unit))


def splits_header(current: Column, last: Column, unit: str = "km") -> Column:
    return F.format_string(f"1 {unit} lap %d/%d", current, last)


def signed_offset(seconds: Column) -> Column:
    """An offset with its sign and all of its digits, no exponent."""
    digits = F.regexp_replace(seconds.cast("string").cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.concat(F.when(seconds >= 0, "+").otherwise(""), digits, F.lit("s"))


def time_text(set_: Column, seconds: Column, instant: Column) -> Column:
    """A time for messages: ``unset``, an instant as it is, or the seconds of a relative time, however it was written."""
    digits = F.regexp_replace(seconds.cast("string").cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    stamp = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(~set_, "unset").when(instant.isNotNull(), stamp).otherwise(F.concat(digits, F.lit("s")))


def swap_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))


def output_name(stem: Column, slugs: Column, extension: Column, number: Column | None = None) -> Column:
    """stem - slug - slug[ - n].ext"""
    name = F.concat_ws(" - ", stem, slugs)
    if number is not None:
        name = F.when(number > 0, F.concat_ws(" - ", name, number.cast("string"))).otherwise(name)
    return F.concat(name, extension)


def positional(path: Column) -> Column:
    """A path that can't be read as a flag."""
    return F.when(path.startswith("-"), F.concat(F.lit("./"), path)).otherwise(path)


def escape_filter_path(path: Column) -> Column:
    for c in ("\\", ":", "'"):
        path = F.replace(path, F.lit(c), F.lit("\\" + c))
    return path


def quoted(value: Column) -> Column:
    """A log field, quoted where it is empty or has a blank, quote, equals sign or control character."""
    return F.when((value == "") | value.rlike(r"[\s\"=\x00-\x1f]"), F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(value)


def eta(seconds: Column) -> Column:
    """Whole seconds as 1h02m03s, 2m03s or 3s; null where they aren't known."""
    s = F.greatest(F.floor(seconds + 0.5), F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(seconds.isNull(), None).when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def frames_per_second(rate: Column) -> Column:
    return F.when(rate <= 0, "0").when(rate < 10, fixed(rate, 1)).otherwise(F.floor(rate + 0.5).cast("string"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done / F.when(total > 0, total) * 100)).otherwise(0).cast("int")


def progress_line(label: Column, done: Column, total: Column, rate: Column) -> Column:
    left = F.greatest(total - done, F.lit(0)) / F.when(rate > 0, rate)
    return F.concat(label, F.lit(" "), percent(done, total).cast("string"), F.lit("% "), frames_per_second(rate), F.lit(" fps"), F.coalesce(F.concat(F.lit(" ETA "), eta(left)), F.lit("")))


def describe_key(stream: Column, key: Column) -> Column:
    """Names a tag without its value."""
    return F.when(stream < 0, F.format_string("container tag %s", key)).otherwise(F.format_string("stream %d tag %s", stream, key))


def rational_rate(text: Column) -> Column:
    """n/d as a number; 0 where d is 0, and for what isn't one."""
    n, d = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(~text.contains("/"), F.coalesce(text.try_cast("double"), F.lit(0.0))).otherwise(F.coalesce(F.when(d != 0, n / F.when(d != 0, d)), F.lit(0.0)))


def score_in(log: Column, label: str = "VMAF score") -> Column:
    """A score from a tool's log; null without one."""
    found = F.regexp_extract(log, rf"{label}:?\s*=?\s*([0-9.]+)", 1)
    return F.when(found != "", found.try_cast("double"))


def iso_family(name: Column) -> Column:
    """Whether a container name is of the ISO base media family: an entry of a list, never a substring."""
    return name.isin("mov", "mp4", "m4a", "3gp", "3g2", "mj2") | name.startswith("mov,") | name.startswith("mp4,")
