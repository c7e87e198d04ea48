"""Times as text and back, and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtitle_seconds(value: Column) -> Column:
    """`H:MM:SS.mmm` or `MM:SS,mmm` in seconds: a fold in base 60; null for anything else."""
    parts = F.split(F.replace(F.trim(value), F.lit(","), F.lit(".")), ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p.try_cast("double"))
    return F.when(F.size(parts).isin(2, 3), total)


def editor_seconds(value: Column) -> Column:
    """`m:ss.mmm` as an editor types it, or plain seconds; null if it is neither."""
    text = F.trim(value)
    minutes, rest = F.regexp_extract(text, r"^(\d+):([0-5]?\d(?:\.\d+)?)$", 1), F.regexp_extract(text, r"^(\d+):([0-5]?\d(?:\.\d+)?)$", 2)
    return F.when(minutes != "", minutes.try_cast("double") * 60 + rest.try_cast("double")).when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))


def editor_time(ms: Column) -> Column:
    """`mm:ss.mmm` of milliseconds."""
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def lrc_stamp(seconds: Column) -> Column:
    """`[mm:ss.cc]`; seconds just under a minute may show as 60.00."""
    minutes = F.floor(seconds / 60)
    return F.format_string("[%02d:%05.2f]", minutes, seconds - minutes * 60)


def milliseconds(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def quality_score(cutoff: Column, high: Column, clipping: Column) -> Column:
    """4 * cutoff + high band - 5 * clipping; minus infinity where any of them is unknown."""
    return F.coalesce(4 * cutoff + high - 5 * clipping, F.lit(float("-inf")))


def scaled(low: Column, high: Column, percent: Column) -> Column:
    """A percentage carried into a range of whole numbers."""
    held = F.greatest(F.lit(0), F.least(F.lit(100), percent))
    return F.floor(low + (high - low) * held / 100)


def room_expiry(created: Column, updated: Column, idle: int = 12 * 3600, age: int = 48 * 3600) -> Column:
    return F.least(updated + idle, created + age)


def trial_expiry(session_end: Column, now: Column, duration: Column) -> Column:
    """The session's end, or the song's length and five minutes, at most twenty, from now."""
    return F.least(session_end, now + F.least(duration + 300, F.lit(1200)))


def pseudonym(*parts: Column) -> Column:
    """Sixteen hex digits that stand for the parts."""
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16))
