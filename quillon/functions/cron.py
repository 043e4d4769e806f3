"""Cron schedules: five fields, or @hourly and its like, or @every with a duration."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of minute, hour, day of month, month, day of week (0 is Sunday), and the named schedules.
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
NAMED = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
FAR = timedelta(days=4 * 365)


def _values(field: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in field.split(","):
        m = re.fullmatch(r"(\*|\d+(?:-\d+)?)(?:/(\d+))?", part)
        if not m or m[2] == "0":
            raise ValueError(f"cannot read {part!r}")
        a, b = (low, high) if m[1] == "*" else (int(m[1].split("-")[0]), int(m[1].split("-")[-1]))
        if "-" not in m[1] and m[1] != "*" and m[2]:
            b = high
        if not low <= a <= b <= high:
            raise ValueError(f"{part!r} is not within {low} to {high}")
        out.update(range(a, b + 1, int(m[2] or 1)))
    return frozenset(out)


@dataclass(frozen=True)
class Schedule:
    fields: tuple[frozenset[int], ...] = ()
    every: int = 0

    def after(self, t: datetime) -> datetime:
        """The next run after t, at least a minute on; four years on where there is none. Both day fields must fit."""
        if self.every:
            epoch = datetime(1970, 1, 1)
            return epoch + timedelta(seconds=((t - epoch) // timedelta(seconds=self.every) + 1) * self.every)
        minutes, hours, days, months, weekdays = self.fields
        last, at = t + FAR, t.replace(second=0, microsecond=0) + timedelta(minutes=1)
        day = at.date()
        while datetime(day.year, day.month, day.day) < last:
            if day.month in months and day.day in days and day.isoweekday() % 7 in weekdays:
                first = at if day == at.date() else datetime(day.year, day.month, day.day)
                for h in sorted(hours):
                    for m in sorted(minutes):
                        if (h, m) >= (first.hour, first.minute):
                            found = datetime(day.year, day.month, day.day, h, m)
                            return found if found < last else last
            day += timedelta(days=1)
        return last


def parse(text: str) -> Schedule:
    text = text.strip()
    if text.startswith("@every "):
        parts = re.findall(r"(\d+)([smhd])", text[7:])
        seconds = sum(int(n) * UNITS[u] for n, u in parts)
        if not seconds or "".join(n + u for n, u in parts) != text[7:].strip():
            raise ValueError(f"cannot read {text!r}")
        return Schedule(every=seconds)
    fields = NAMED.get(text, text).split()
    if len(fields) != 5:
        raise ValueError(f"cannot read {text!r}")
    return Schedule(tuple(_values(f, *b) for f, b in zip(fields, BOUNDS)))


def next_run(ts: Column, expression: str) -> Column:
    """The schedule's next run after each instant (in UTC). Runs in Arrow batches; equal minutes are worked out once in each."""
    schedule = parse(expression)

    @F.pandas_udf("timestamp_ntz")
    def run(times: pd.Series) -> pd.Series:
        if schedule.every:
            return times.map(lambda t: schedule.after(t.to_pydatetime()), na_action="ignore").astype("datetime64[us]")
        minutes = times.dt.floor("min")
        known = {m: schedule.after(m.to_pydatetime()) for m in minutes.dropna().unique()}
        return minutes.map(known).astype("datetime64[us]")

    return run(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")))
