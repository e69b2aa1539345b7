"""Timeframe labels such as ``5m`` or ``1M`` and the time arithmetic they stand for."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit letters and their lengths in seconds (a month counts as 30 days).
UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000}


def _count_and_unit(label: str, units: str) -> tuple[int, str]:
    """``5m`` as (5, "m"); the unit has to be one of ``units`` and the count at least 1."""
    count, unit = label[:-1], label[-1:]
    if unit not in units or not (count.isascii() and count.isdigit()) or int(count) == 0:
        raise ValueError(f"not a length of time: {label!r}")
    return int(count), unit


class Timeframe:
    """A bar length, parsed once; frames compare and sort by ``seconds``.

    Weeks start on Sunday and months on their first day. Bins that do not divide a day, or that span several
    weeks or months, count from the start of their series (``needs_origin``).
    """

    def __init__(self, label: str):
        self.label = label
        self.count, self.unit = _count_and_unit(label, "".join(UNIT_SECONDS))
        self.seconds = self.count * UNIT_SECONDS[self.unit]
        self.is_calendar = self.unit in "wM"
        self.needs_origin = self.count > 1 if self.is_calendar else 86400 % self.seconds != 0

    def __lt__(self, other: "Timeframe") -> bool:
        return self.seconds < other.seconds

    def interval(self) -> Column:
        return F.expr(f"INTERVAL '{self.seconds}' SECOND")

    def anchor(self, ts: Column) -> Column:
        """Latest calendar anchor at or before ``ts``: midnight, Sunday or month start."""
        day = F.to_date(ts)
        if self.unit == "w":
            day = F.date_sub(day, F.dayofweek(day) - 1)
        elif self.unit == "M":
            day = F.trunc(day, "MM")
        return day.cast("timestamp_ntz")

    def bin_start(self, ts: Column, origin: Column | None = None) -> Column:
        """Start of the bin that holds ``ts``; ``origin`` is the series' first anchor if needed."""
        if self.needs_origin:
            if origin is None:
                raise ValueError(f"{self.label} bins need a series origin")
            if self.unit == "M":
                whole = F.floor(F.months_between(self.anchor(ts), origin) / self.count) * self.count
                return F.add_months(F.to_date(origin), whole.cast("int")).cast("timestamp_ntz")
            late = epoch_seconds(ts) - epoch_seconds(origin)
            return origin + F.make_dt_interval(secs=late - F.pmod(late, F.lit(self.seconds)))
        if self.is_calendar:
            return self.anchor(ts)
        return F.window(ts, f"{self.seconds} seconds")["start"]

    def bin_end(self, start: Column) -> Column:
        """End of a bin that starts at ``start``, i.e. the moment its bar is known."""
        return self.close_label(start)

    def close_label(self, ts: Column) -> Column:
        """Start label to close label. Calendar units roll forward to the next anchor."""
        if self.unit == "w":
            day_number = F.dayofweek(ts)
            days = F.when(day_number == 1, 7 * self.count).otherwise(8 - day_number + 7 * (self.count - 1))
            return ts + F.make_dt_interval(days=days)
        if self.unit == "M":
            midnight = F.to_date(ts).cast("timestamp_ntz")
            start = F.add_months(F.trunc(F.to_date(ts), "MM"), self.count).cast("timestamp_ntz")
            return start + (ts - midnight)
        return ts + self.interval()


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock timestamp read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def sort_labels(labels: list[str]) -> list[str]:
    """Labels by length, the shortest first."""
    return [frame.label for frame in sorted(map(Timeframe, labels))]


def duration(spec: str) -> timedelta:
    """A window such as ``30d`` or ``1W``. The units are those of timeframes in either case, except that a
    month has no fixed length: ``M`` is refused."""
    count, unit = _count_and_unit(spec, "mhdwHDW")
    return timedelta(seconds=count * UNIT_SECONDS[unit.lower()])


def duration_seconds(label: Column) -> Column:
    """The same for a text column; an invalid text raises when the row is read."""
    number = F.try_to_number(F.regexp_extract(label, r"^(\d+)[mhdwHDW]$", 1), F.lit("999999999"))
    unit = F.regexp_extract(label, r"^\d+([mhdwHDW])$", 1)
    factor = F.lit(None).cast("long")
    for letter, seconds in UNIT_SECONDS.items():
        if letter != "M":
            factor = F.when(unit.isin(letter, letter.upper() if letter != "m" else letter), seconds).otherwise(factor)
    bad = F.raise_error(F.concat(F.lit("invalid duration: "), label)).cast("long")
    return F.when(number.isNull() & label.isNotNull(), bad).otherwise(number.cast("long") * factor)


def timeframe_seconds(label: Column) -> Column:
    """Bar length in seconds for a column of timeframe labels."""
    number = F.regexp_extract(label, r"^(\d+)[mhdwM]$", 1)
    unit = F.regexp_extract(label, r"^\d+([mhdwM])$", 1)
    factor = F.lit(None).cast("long")
    for letter, seconds in UNIT_SECONDS.items():
        factor = F.when(unit == letter, seconds).otherwise(factor)
    return F.nullif(number, F.lit("")).cast("long") * factor
