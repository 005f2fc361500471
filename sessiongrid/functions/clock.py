"""Clock texts, seconds, milliseconds and frame numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO_FPS = 29.97
VIDEO_FPS = 30.0


def clock_seconds(text: Column) -> Column:
    """``"0 days 00:01:02.5"``, ``"01:02.5"`` or ``"62.5"`` to seconds; null if not a clock."""
    clock = F.element_at(F.split(F.trim(text), " +"), -1)
    parts = F.transform(F.split(clock, ":"), lambda part: part.try_cast("double"))
    seconds = F.aggregate(parts, F.lit(0.0), lambda total, part: total * 60 + part)
    return F.when(text.isNotNull(), seconds)


def seconds_to_frame(seconds: Column, fps: float = AUDIO_FPS) -> Column:
    return F.floor(seconds * F.lit(fps)).cast("int")


def clock_to_frame(text: Column, fps: float = AUDIO_FPS) -> Column:
    """Frame number in which a clock text falls, null for a null text."""
    return seconds_to_frame(clock_seconds(text), fps)


def frame_to_seconds(frame: Column, fps: float = VIDEO_FPS) -> Column:
    return frame / F.lit(fps)


def seconds_to_ms(seconds: Column) -> Column:
    return (seconds * 1000).cast("long")


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session zone is."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    whole = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return whole * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def seconds_of(ts: Column) -> Column:
    return micros_of(ts) / F.lit(1_000_000.0)
