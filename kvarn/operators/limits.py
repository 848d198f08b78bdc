"""Token buckets for each user: a fold over requests in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .folds import ordered_fold


def refill(tokens: int, last: int, now: int, rate: float, most: int) -> int:
    return min(most, tokens + int((now - last) * rate))


def take(tokens: int, last: int, now: int, rate: float, most: int) -> tuple[bool, int, int]:
    """(allowed, tokens, time of the last grant); a denial changes nothing."""
    have = refill(tokens, last, now, rate, most)
    return (True, have - 1, now) if have >= 1 else (False, tokens, last)


def token_bucket(requests: DataFrame, rate: float = 100.0, most: int = 10000) -> DataFrame:
    """user, seq, ts_seconds, allowed for requests (user, seq, ts_seconds). A bucket is full at the user's first request; time is whole seconds."""

    def step(state, user, seq, now):
        tokens, last = state
        ok, tokens, last = take(tokens, now if last is None else last, now, rate, most)
        return (tokens, last), ok

    return ordered_fold(requests.select("user", "seq", "ts_seconds"), "user", ["ts_seconds", "seq"], lambda: (most, None), step, "allowed boolean")
