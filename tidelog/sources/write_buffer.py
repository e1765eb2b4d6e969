"""A write buffer in front of a table: batches gather, are frozen together, and become one segment."""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from tidelog.operators.buffer import BufferConfig
from tidelog.sources.table import Table


class WriteBuffer:
    """Holds plans, not rows: a batch is a DataFrame until its buffer is flushed.

    `append` waits while `config.total` bytes are neither flushed nor given up, so something else has to flush meanwhile: `running`
    does so from a thread of its own, each `config.interval_ms`.
    """

    def __init__(self, config: BufferConfig | None = None) -> None:
        self.config = config or BufferConfig()
        self._open: list[tuple[DataFrame, int]] = []
        self._frozen: deque[tuple[str, list[tuple[DataFrame, int]]]] = deque()
        self._flushing = threading.Lock()
        self.failure: Exception | None = None
        self._held = 0
        self._room = threading.Condition()

    def append(self, batch: DataFrame, size: int | None = None, timeout: float | None = None) -> bool:
        """Takes a batch; whether the buffer is now full. The size is Spark's estimate unless given. Empty batches are refused."""
        if batch.isEmpty():
            raise ValueError("an empty batch can't be appended")
        size = int(batch._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) if size is None else size
        with self._room:
            if not self._room.wait_for(lambda: self._held + size <= self.config.total or not self._held, timeout):
                raise TimeoutError("the write buffer is full")
            self._open.append((batch, size))
            self._held += size
            return self.config.full(sum(s for _, s in self._open), len(self._open))

    def freeze(self) -> bool:
        """Moves the open batches to the queue; False if there are none."""
        with self._room:
            if not self._open:
                return False
            self._frozen.append((f"buffer-{uuid.uuid4().hex}", self._open))
            self._open = []
            return True

    def flush(self, table: Table) -> list[int]:
        """Writes the oldest frozen buffer as one segment; the batches' LSNs. A buffer whose write fails stays first in the queue; one whose
        write came through unnoticed is recognised by its name and not appended again."""
        with self._flushing:
            with self._room:
                if not self._frozen:
                    return []
                name, buffer = self._frozen[0]
            lsns = table.append_many([b for b, _ in buffer], name)
            with self._room:
                self._frozen.popleft()
                self._held -= sum(s for _, s in buffer)
                self._room.notify_all()
            return lsns

    @contextmanager
    def running(self, table: Table) -> Iterator[WriteBuffer]:
        """Freezes and flushes what has gathered each `config.interval_ms` until the block ends, and then all that is left. A failed
        flush is tried again at the next turn; the last failure is kept in `failure` until a flush succeeds."""
        stop = threading.Event()

        def turn() -> None:
            while not stop.wait(self.config.interval_ms / 1000):
                self.freeze()
                try:
                    while self.frozen and not stop.is_set():
                        self.flush(table)
                        self.failure = None
                except Exception as error:  # noqa: BLE001  the thread goes on; what failed stays in the queue
                    self.failure = error

        thread = threading.Thread(target=turn, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            stop.set()
            thread.join()
            self.close(table)

    def close(self, table: Table) -> None:
        """Freezes and flushes all that is left."""
        self.freeze()
        while self._frozen:
            self.flush(table)

    @property
    def frozen(self) -> int:
        return len(self._frozen)

    @property
    def batches(self) -> int:
        return len(self._open)

    @property
    def unflushed(self) -> int:
        return self._held

    @property
    def empty(self) -> bool:
        return not self._open and not self._frozen
