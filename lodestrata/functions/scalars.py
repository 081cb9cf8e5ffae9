"""Scalar expressions. All are built from JVM functions and stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_or_null(x: Column | str) -> Column:
    """The ISO text unchanged; null if empty."""
    return F.nullif(col(x), F.lit(""))


def lower_or_empty(x: Column | str) -> Column:
    return F.lower(F.coalesce(col(x), F.lit("")))


def utc_date(x: Column | str) -> Column:
    """Day in UTC of an ISO time in any notation; null if it is none."""
    return F.date_from_unix_date(F.floor(F.unix_timestamp(F.try_to_timestamp(col(x))) / 86400).cast("int"))


def utc_seconds(x: Column | str) -> Column:
    """Seconds since the epoch of an ISO time; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(col(x)))


def owner_and_name(nwo: Column | str) -> Column:
    """``struct(owner, name)`` of ``owner/name``; any other number of parts is an error, null stays null."""
    parts = F.split(col(nwo), "/", -1)
    wrong = F.raise_error(F.concat(F.lit("expected owner/name, got: "), col(nwo)))
    return F.when(col(nwo).isNotNull(), F.when(F.size(parts) == 2, F.struct(parts[0].alias("owner"), parts[1].alias("name"))).otherwise(wrong))


def middle_day(start: Column | str, end: Column | str) -> Column:
    """The day halfway from ``start`` to ``end``, rounded down."""
    return F.date_add(col(start), F.floor(F.datediff(col(end), col(start)) / 2).cast("int"))


def wait_seconds(reset_at: Column | str, now: Column | str, margin: float = 5.0) -> Column:
    """Seconds to wait for a quota: until ``reset_at`` (ISO) plus a margin, never below 0.

    ``now`` is a timestamp, passed in so that a plan gives the same result twice.
    """
    left = F.try_to_timestamp(col(reset_at)).cast("double") - col(now).cast("double") + margin
    return F.greatest(F.lit(0.0), left)


def quota_text(remaining: Column | str, limit: Column | str, reset_at: Column | str) -> Column:
    """``Rate limit: R/L (resets at HH:MM:SS)``; a missing part is ``?``, an unreadable time stays as it is."""
    known = lambda c: F.coalesce(col(c).cast("string"), F.lit("?"))
    day = F.pmod(utc_seconds(reset_at), F.lit(86400))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(day / 3600)), two(F.floor(F.pmod(day, F.lit(3600)) / 60)), two(F.pmod(day, F.lit(60))))
    at = F.when(F.coalesce(col(reset_at), F.lit("")) == "", "?").otherwise(F.when(day.isNotNull(), clock).otherwise(col(reset_at)))
    return F.concat(F.lit("Rate limit: "), known(remaining), F.lit("/"), known(limit), F.lit(" (resets at "), at, F.lit(")"))


def join_words(*parts: Column | str) -> Column:
    """Parts joined by one blank, nulls left out."""
    return F.concat_ws(" ", *(col(p) for p in parts))


def error_text(errors: Column | str) -> Column:
    """The messages of an ``array<struct<message>>`` joined by ``; ``."""
    return F.array_join(F.transform(col(errors), lambda e: e["message"]), "; ")


def truncate(x: Column | str, n: int = 100) -> Column:
    return F.substring(col(x), 1, n)


def backoff_delay(attempt: Column | str, base: float = 2.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Delay before retry ``attempt`` (from 0): ``base * factor ** attempt``, at most ``most``."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), col(attempt)))
