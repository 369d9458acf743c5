"""Named phases of a run, timed on the driver.

Spark is lazy: a phase measures work only if an action runs inside it.
"""

from __future__ import annotations

import functools
import logging
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

log = logging.getLogger("tarn.timing")


@dataclass
class Timer:
    """Collects records of timestamp, exp_id, trial, process, k and duration_ms; off unless ``enabled``."""

    enabled: bool = True
    threshold_ms: float = 0.0
    records: list[dict] = field(default_factory=list)
    _local: threading.local = field(default_factory=threading.local, repr=False)

    @contextmanager
    def context(self, **tags: object) -> Iterator[None]:
        """Tags (exp_id, trial, k) of all records made inside."""
        before = getattr(self._local, "tags", {})
        self._local.tags = {**before, **tags}
        try:
            yield
        finally:
            self._local.tags = before

    @contextmanager
    def phase(self, name: str, record: bool = True, **tags: object) -> Iterator[None]:
        if not self.enabled:
            yield
            return
        depth = getattr(self._local, "depth", 0)
        self._local.depth = depth + 1
        began = time.perf_counter()
        try:
            yield
        finally:
            ms = (time.perf_counter() - began) * 1000
            self._local.depth = depth
            if ms >= self.threshold_ms:
                every = {**getattr(self._local, "tags", {}), **tags}
                log.info("%s%s %.3f ms %s", "  " * depth, name, ms, every)
                if record:
                    self.records.append({"timestamp": datetime.now(timezone.utc).isoformat(), "process": name, "duration_ms": round(ms, 3), **every})

    def block(self, label: str):
        """Logged, not recorded."""
        return self.phase(label, record=False)

    def timed(self, name: str | None = None) -> Callable:
        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def run(*args, **kwargs):
                with self.phase(name or f.__qualname__):
                    return f(*args, **kwargs)

            return run

        return wrap

    def all_methods(self, cls: type) -> type:
        """Times every public method of a class."""
        for name, f in list(vars(cls).items()):
            if callable(f) and not name.startswith("_"):
                setattr(cls, name, self.timed(f"{cls.__name__}.{name}")(f))
        return cls
