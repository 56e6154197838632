"""Progress of a run by stage, safe to write from several threads."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Stage:
    status: str = "pending"
    lines: list[str] = field(default_factory=list)
    current: int = 0
    total: int = 0


class StageLog:
    """pending, running, done or error for each stage, with its lines and progress."""

    def __init__(self, names: tuple[str, ...]) -> None:
        self._lock, self._stages = threading.Lock(), {n: Stage() for n in names}

    def info(self, name: str, line: str) -> None:
        with self._lock:
            self._stages[name].lines.append(line)

    def progress(self, name: str, current: int, total: int) -> None:
        with self._lock:
            self._stages[name].current, self._stages[name].total = current, total

    @contextmanager
    def running(self, name: str):
        """Marks the stage as done when the block ends, as an error with its reason when it raises."""
        self._set(name, "running")
        try:
            yield self
        except Exception as e:
            self.info(name, str(e))
            self._set(name, "error")
            raise
        self._set(name, "done")

    def _set(self, name: str, status: str) -> None:
        with self._lock:
            self._stages[name].status = status

    def snapshot(self) -> dict[str, dict]:
        with self._lock:
            return {n: {"status": s.status, "lines": list(s.lines), "progress": (s.current, s.total)} for n, s in self._stages.items()}

    def flat_text(self) -> str:
        return "\n".join(f"[{n}] {s['status']}" + "".join(f"\n  {x}" for x in s["lines"]) for n, s in self.snapshot().items())
