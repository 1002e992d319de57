"""Timing and memory of the driver, for logs. Executors report theirs to Spark."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("helixspark")


@contextmanager
def timed(label: str) -> Iterator[dict[str, float]]:
    """Log the wall time of a block; the yielded dict has it as ``seconds`` afterwards."""
    out: dict[str, float] = {}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        log.info("%s: %.3f s", label, out["seconds"])


def memory() -> dict[str, int]:
    """Resident bytes now and at most, and the free bytes of the machine, where /proc has them."""
    found = {}
    for path, names in (("/proc/self/status", ("VmRSS", "VmHWM")), ("/proc/meminfo", ("MemFree",))):
        try:
            with open(path) as file:
                text = file.read()
        except OSError:
            continue
        for name in names:
            if match := re.search(rf"^{name}:\s+(\d+) kB", text, re.M):
                found[name] = int(match[1]) * 1024
    return found
