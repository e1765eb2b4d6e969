"""Assignment of LSNs and the watermarks behind it, for writers that number batches themselves."""

from __future__ import annotations

import threading

from tidelog.operators.buffer import lag


class LsnManager:
    """LSNs from 1 on. Watermarks only rise."""

    def __init__(self, start: int = 1) -> None:
        self._next, self._flushed, self._committed = start, 0, 0
        self._lock = threading.Lock()

    def assign(self, count: int = 1) -> tuple[int, int]:
        """The first and last of `count` fresh LSNs."""
        with self._lock:
            first = self._next
            self._next += count
            return first, self._next - 1

    @property
    def current(self) -> int:
        """The LSN that comes next."""
        return self._next

    @property
    def flushed(self) -> int:
        return self._flushed

    @property
    def committed(self) -> int:
        return self._committed

    def mark_flushed(self, lsn: int) -> None:
        with self._lock:
            self._flushed = max(self._flushed, lsn)

    def mark_committed(self, lsn: int) -> None:
        with self._lock:
            self._committed = max(self._committed, lsn)

    @property
    def pending_flush(self) -> int:
        return lag(self._next, self._flushed, self._committed)[0]

    @property
    def pending_commit(self) -> int:
        return lag(self._next, self._flushed, self._committed)[1]
