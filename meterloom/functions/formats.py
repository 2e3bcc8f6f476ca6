"""Column functions that show numbers, times and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divisor and suffix of each unit, largest first.
UNITS = ((1_000_000_000_000, "T"), (1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K"))


def directory_of(session_id: Column) -> Column:
    """What stands before the last slash, empty without one."""
    return F.regexp_extract(session_id, r"^(.*)/[^/]*$", 1)


def leaf_of(session_id: Column) -> Column:
    return F.substring_index(session_id, "/", -1)


def minus(a: Column, b: Column) -> Column:
    """a - b, not below zero."""
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_midnight(day: Column, tz: str) -> Column:
    """The instant at which a local day starts: the first valid minute in a gap, the earlier one in an overlap."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def rfc3339(ts: Column, tz: str) -> Column:
    """Milliseconds and offset in tz, Z for none."""
    local = F.from_utc_timestamp(ts, tz)
    offset = (F.unix_micros(local) - F.unix_micros(ts)) / 60_000_000
    minutes = F.abs(offset).cast("int")
    sign = F.when(offset < 0, "-").otherwise("+")
    shown = F.concat(sign, F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(minutes == 0, "Z").otherwise(shown))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def per_hour(value: Column, micros: Column) -> Column:
    """A count scaled to an hour, rounded half up; 0 for an empty window."""
    wide = lambda c: c.cast("decimal(38,0)")
    scaled = F.floor((wide(value) * F.lit(3_600_000_000).cast("decimal(10,0)") + wide(F.floor(micros / 2))) / wide(micros))
    return F.when((value == 0) | (micros <= 0), F.lit(0)).otherwise(scaled).cast("bigint")


def cost_per_hour(value: Column, micros: Column) -> Column:
    return F.when((value == 0) | (micros <= 0), F.lit(0.0)).otherwise(value * 3600.0 / (micros / 1e6))


def window_minutes(micros: Column) -> Column:
    """Whole seconds in minutes, rounded up."""
    return F.ceil(F.floor(micros / 1_000_000) / 60).cast("bigint")


def short_number(value: Column) -> Column:
    """Three significant digits with K, M, B or T; a number that rounds up to 1000 moves to the next unit."""

    def shown(divisor: int, suffix: str, v: Column) -> Column:
        out = None
        for decimals, most in ((0, None), (1, 100), (2, 10)):
            scale = 10**decimals
            units = F.floor((v.cast("decimal(38,0)") * scale + divisor // 2) / divisor).cast("bigint")
            text = F.concat(F.floor(units / scale).cast("bigint").cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), decimals, "0")) if decimals else units.cast("string")
            text = F.regexp_replace(text, r"\.?0+$", "") if decimals else text
            whole = F.floor(v / divisor)
            out = text if out is None else F.when(whole < most, text).otherwise(out)
        return F.concat(out, F.lit(suffix))

    out = value.cast("string")
    for k in reversed(range(len(UNITS))):
        divisor, suffix = UNITS[k]
        # the least value that this unit would show as 1000 of the unit below
        least = divisor if k == len(UNITS) - 1 else divisor - UNITS[k + 1][0] // 2
        out = F.when(value >= least, shown(divisor, suffix, F.greatest(value, F.lit(divisor)))).otherwise(out)
    return out


def full_number(value: Column) -> Column:
    return F.format_number(value, 0)


def currency(value: Column) -> Column:
    return F.format_string("$%.2f", value)


def countdown(seconds: Column) -> Column:
    """At most two of the non-zero units from the largest down."""
    left = F.greatest(seconds, F.lit(0))
    parts, rest = [], left
    for size, label in ((86_400, "d"), (3_600, "h"), (60, "m"), (1, "s")):
        n = F.floor(rest / size).cast("bigint")
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(label))))
        rest = rest % size
    found = F.slice(F.filter(F.array(*parts), lambda x: x.isNotNull()), 1, 2)
    return F.when(left == 0, "0s").otherwise(F.array_join(found, " "))


def percent_left(used: Column) -> Column:
    return F.format_string("%.0f", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - used))))


def normal_path(path: Column) -> Column:
    """A path without . and .. parts and doubled slashes, by text alone."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when((F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != ".."), F.slice(a, 1, F.size(a) - 1)).when(path.startswith("/"), a).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def inside(path: Column, root: Column) -> Column:
    """Whether a normalised path is root or below it, by whole components."""
    base = F.regexp_replace(root, "/$", "")
    return (path == root) | path.startswith(F.concat(base, F.lit("/")))
