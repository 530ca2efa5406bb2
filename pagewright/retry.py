"""Retries of calls to services that a user's functions make."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import SETTINGS

# fixed values: longest wait, share of jitter, answers that are worth another call
MOST_SECONDS = 60.0
JITTER = 0.2
STATUS = (429, *range(500, 600))


def base_seconds(attempt: Column | int) -> Column | float:
    """The wait after an attempt, from 1, before jitter: 1, 2, 4, ... up to a minute."""
    if isinstance(attempt, Column):
        return F.least(F.pow(F.lit(2.0), F.least(attempt, F.lit(64)) - 1), F.lit(MOST_SECONDS))
    return min(MOST_SECONDS, 2.0 ** min(attempt - 1, 64))


def worth_another(error: BaseException) -> bool:
    """Rate limits, server errors, results out of their schema, stalled streams."""
    status = getattr(error, "status_code", getattr(error, "status", None))
    return status in STATUS or isinstance(error, (TimeoutError, ValueError))


def retried(call: Callable, attempts: int = SETTINGS.retry_attempts, again: Callable[[BaseException], bool] = worth_another, wait: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` with up to ``attempts`` tries; other errors, and the last one, are raised."""

    def run(*args, **named):
        for attempt in range(1, attempts + 1):
            try:
                return call(*args, **named)
            except Exception as error:
                if attempt == attempts or not again(error):
                    raise
                wait(base_seconds(attempt) * (1 + JITTER * random.random()))
        raise ValueError("attempts must be 1 or more")

    return run
