"""Counts and times of a run, for standard error."""

from __future__ import annotations

import resource
import sys
import time


class Metrics:
    """Values by name; ``report`` adds the wall time, the rate of records and the peak
    memory of the driver's process."""

    def __init__(self) -> None:
        self.begun, self.values = time.monotonic(), {}

    def add(self, **values: float) -> None:
        self.values |= values

    def lines(self) -> list[str]:
        took = time.monotonic() - self.begun
        out = dict(self.values) | {"wall_seconds": round(took, 3), "peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}
        if "records" in out and took > 0:
            out["records_per_second"] = round(out["records"] / took)
        return [f"{k}\t{v}" for k, v in sorted(out.items())]

    def report(self) -> None:
        print("\n".join(self.lines()), file=sys.stderr)
