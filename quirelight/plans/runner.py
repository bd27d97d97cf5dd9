"""Runs components in order and reports on them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``, key by key in nested maps; neither changes."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass
class Result:
    name: str
    status: str = "PENDING"
    seconds: float = 0.0
    error: str | None = None
    metrics: dict = field(default_factory=dict)


@dataclass
class Runner:
    """A component returns its metrics; one that raises is FAILED, and if critical ends the run."""

    components: list[tuple[str, Callable[[], dict]]]
    critical: frozenset[str] = frozenset()
    dry: bool = False

    def run(self) -> list[Result]:
        results = []
        for name, component in self.components:
            result, began = Result(name), time.monotonic()
            results.append(result)
            if self.dry:
                result.status = "SKIPPED"
                continue
            try:
                result.metrics = component() or {}
                result.status = result.metrics.get("status", "COMPLETED")
            except Exception as e:  # a component's failure is its result
                result.status, result.error = "FAILED", str(e)
            result.seconds = time.monotonic() - began
            if result.status == "FAILED" and name in self.critical:
                break
        return results


def report(results: list[Result]) -> dict:
    return {
        "components": [r.__dict__ for r in results],
        "seconds": sum(r.seconds for r in results),
        "completed": sum(r.status == "COMPLETED" for r in results),
        "failed": [r.name for r in results if r.status == "FAILED"],
        "exit_code": int(any(r.status == "FAILED" for r in results)),
    }
