"""Retrying and quota bookkeeping for connectors. Transformations never sleep."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone


def delays(retries: int = 5, base: float = 1.0, most: float = 60.0, factor: float = 2.0) -> Iterator[float]:
    """The waits between ``retries + 1`` attempts."""
    wait = base
    for _ in range(retries):
        yield min(wait, most)
        wait *= factor


def retrying(retries: int = 5, base: float = 1.0, most: float = 60.0, factor: float = 2.0, errors: tuple = (Exception,),
             sleep: Callable[[float], None] = time.sleep, note: Callable[[str], None] | None = None) -> Callable:
    """Decorator: call again after growing waits when one of ``errors`` is raised; the last error is passed on."""

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def call(*args, **kwargs):
            plan = delays(retries, base, most, factor)
            tries = 0
            while True:
                try:
                    return fn(*args, **kwargs)
                except errors as e:
                    wait = next(plan, None)
                    if wait is None:
                        raise
                    tries += 1
                    if note:
                        note(f"retry {tries} of {retries} in {wait:.1f} s: {str(e)[:100]}")
                    sleep(wait)

        return call

    return wrap


@dataclass
class Quota:
    """What a service last said of its quota. A reader asks ``pause`` before each request."""

    remaining: int | None = None
    limit: int | None = None
    reset_at: str | None = None
    least: int = 100
    margin: float = 5.0
    waited: list[float] = field(default_factory=list)

    def note(self, record: dict | None) -> None:
        """Keep a record ``{remaining, limit, resetAt}``; parts may be missing."""
        for mine, theirs in (("remaining", "remaining"), ("limit", "limit"), ("reset_at", "resetAt")):
            if record and record.get(theirs) is not None:
                setattr(self, mine, record[theirs])

    def pause(self, now: datetime) -> float:
        """Seconds to wait before the next request, 0 while enough is left."""
        if self.remaining is None or self.remaining >= self.least or not self.reset_at:
            return 0.0
        reset = datetime.fromisoformat(self.reset_at.replace("Z", "+00:00"))
        reset = reset if reset.tzinfo else reset.replace(tzinfo=timezone.utc)
        return max(0.0, (reset - now).total_seconds() + self.margin)

    def text(self) -> str:
        shown = self.reset_at or "?"
        try:
            shown = datetime.fromisoformat(shown.replace("Z", "+00:00")).strftime("%H:%M:%S")
        except ValueError:
            pass
        show = lambda x: "?" if x is None else x
        return f"Rate limit: {show(self.remaining)}/{show(self.limit)} (resets at {shown})"
