"""Writing from Python: info, warn and error helpers, and a logging handler, over buffered appends."""

from __future__ import annotations

import logging
import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from tidelog.config import EngineConfig
from tidelog.streaming.pipelines import appender

_SCHEMA = "n long, route_key string, level string, payload string"


class Writer:
    """Buffers messages and appends them as one batch at ``batch`` messages, ``most_bytes``, at a message ``most_seconds`` after the last flush (0: never), or on ``flush``."""

    def __init__(self, spark: SparkSession, config: EngineConfig, batch: int = 10_000, most_bytes: int = 4 << 20, most_seconds: float = 0) -> None:
        self._spark, self._batch, self._append = spark, batch, appender(config)
        self._most_bytes, self._most_seconds, self._bytes, self._since = most_bytes, most_seconds, 0, time.monotonic()
        #: Counters: what was submitted and stored, and appends that failed.
        self.metrics = dict.fromkeys(("submitted_messages", "submitted_bytes", "flushed_batches", "flushed_messages", "flush_errors", "pending_entries", "pending_bytes"), 0)
        self._rows: list[tuple[int, str, str, str]] = []
        self._held: list[tuple[int, str, str, str]] | None = None
        self._n, self._batches, self._lock = 0, 0, threading.Lock()

    def append(self, level: str, payload: str, route_key: str = "") -> None:
        with self._lock:
            self._rows.append((self._n, route_key, level, payload))
            self._n += 1
            size = len(payload.encode())
            self._bytes += size
            self.metrics["submitted_messages"] += 1
            self.metrics["submitted_bytes"] += size
            late = self._most_seconds and time.monotonic() - self._since >= self._most_seconds
            full = len(self._rows) >= self._batch or self._bytes >= self._most_bytes or bool(late)
            self._shown()
        if full:
            self.flush()

    def info(self, payload: str, route_key: str = "") -> None:
        self.append("INFO", payload, route_key)

    def warn(self, payload: str, route_key: str = "") -> None:
        self.append("WARN", payload, route_key)

    def error(self, payload: str, route_key: str = "") -> None:
        self.append("ERROR", payload, route_key)

    def flush(self) -> None:
        """Append what is held. It stays held if that fails, and the next flush appends it under the same numbers."""
        with self._lock:
            if self._held is None and self._rows:
                self._held, self._rows, self._bytes = self._rows, [], 0
            if self._held is not None:
                try:
                    self._append(self._spark.createDataFrame(self._held, _SCHEMA), self._batches)
                except Exception:
                    self.metrics["flush_errors"] += 1
                    self._shown()
                    raise
                self.metrics["flushed_batches"] += 1
                self.metrics["flushed_messages"] += len(self._held)
                self._held = None
                self._batches += 1
            self._since = time.monotonic()
            self._shown()

    def _shown(self) -> None:
        self.metrics["pending_entries"] = len(self._rows) + len(self._held or ())
        self.metrics["pending_bytes"] = self._bytes


class Handler(logging.Handler):
    """Sends records of Python's logging to a Writer as ``[file:line] message``; without one they go to stderr."""

    def __init__(self, writer: Writer | None = None, out: Callable[[str], None] = sys.stderr.write) -> None:
        super().__init__()
        self.writer, self.out = writer, out

    def emit(self, record: logging.LogRecord) -> None:
        text = f"[{record.filename}:{record.lineno}] {record.getMessage()}"
        if self.writer is None:
            self.out(text + "\n")
        else:
            level = "ERROR" if record.levelno >= logging.ERROR else "WARN" if record.levelno >= logging.WARNING else "INFO"
            self.writer.append(level, text)

    def flush(self) -> None:
        if self.writer is not None:
            self.writer.flush()
