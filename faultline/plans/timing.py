"""How long calls take, as log lines."""

from __future__ import annotations

import functools
import inspect
import logging
import resource
import time
from collections.abc import Callable

logger = logging.getLogger("faultline")


def timed(call: Callable) -> Callable:
    """RP09: logs a call's name, seconds and the driver's peak memory; of coroutines, too. A frame that a call returns is
    a plan: its work shows in Spark's own metrics."""

    def note(began: float) -> None:
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
        logger.info("%s took %.3f s, %d MB at most", call.__qualname__, time.perf_counter() - began, peak)

    if inspect.iscoroutinefunction(call):

        @functools.wraps(call)
        async def run_async(*args, **options):
            began = time.perf_counter()
            try:
                return await call(*args, **options)
            finally:
                note(began)

        return run_async

    @functools.wraps(call)
    def run(*args, **options):
        began = time.perf_counter()
        try:
            return call(*args, **options)
        finally:
            note(began)

    return run
