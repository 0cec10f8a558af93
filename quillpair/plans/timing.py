"""Wall-clock timing of steps."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

log = logging.getLogger("quillpair")


def timed(description: str) -> Callable[[Callable], Callable]:
    """Decorator that logs how long a call took and returns its result."""

    def add(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **kwargs):
            begin = time.perf_counter()
            try:
                return f(*args, **kwargs)
            finally:
                log.info("%s: %.3f s", description, time.perf_counter() - begin)

        return run

    return add
