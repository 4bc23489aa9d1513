"""Streaming sources that Spark lacks: growing files followed by offset, and listening sockets.

Both read on the driver, as their inputs are local to one machine; rows go to executors from there.
"""

from __future__ import annotations

import glob
import os
import socket
import sys
import threading
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def expanded(patterns: list[str]) -> list[str]:
    """Regular files of paths and globs, sorted, each once; a pattern that matches none stands for itself."""
    found = set()
    for pattern in patterns:
        hits = [p for p in glob.glob(pattern) if os.path.isfile(p)]
        found.update(hits or [pattern])
    return sorted(found)


def tail_once(path: str, inode: int, offset: int, most_lines: int) -> tuple[list[tuple[str, int]], int, int, bool]:
    """Complete lines after ``offset`` with their places, the file's inode, the next offset, and whether it was replaced.

    A file of another inode, or shorter than the offset, is read from its beginning.
    """
    try:
        at = os.stat(path)
    except FileNotFoundError:
        return [], inode, offset, False
    replaced = bool(inode and at.st_ino != inode) or at.st_size < offset
    start = 0 if replaced else offset
    out: list[tuple[str, int]] = []
    with open(path, "rb") as f:
        f.seek(start)
        while len(out) < most_lines and (line := f.readline()).endswith(b"\n"):
            out.append((line[:-1].decode("utf-8", "replace"), start))
            start += len(line)
    return out, at.st_ino, start, replaced


def _until(path: str, inode: int, offset: int, end: int) -> Iterator[tuple[str, int]]:
    """Lines with their places from ``offset`` up to ``end``, a thousand at a time."""
    while offset < end:
        lines, _, after, replaced = tail_once(path, inode, offset, 1000)
        if not lines or replaced:
            return
        yield from ((line, at) for line, at in lines if at < end)
        offset = after


class _TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.patterns = options["path"].split(",")
        self.most = int(options.get("maxlines", "10000"))

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for path in expanded(self.patterns):
            inode, offset = end.get(path, [0, 0])
            lines, inode, after, _ = tail_once(path, inode, offset, self.most)
            rows += [(path, at, line) for line, at in lines]
            end[path] = [inode, after]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for path, (inode, upto) in end.items():
            was, offset = start.get(path, [inode, 0])
            yield from ((path, at, line) for line, at in _until(path, was, offset if was == inode else 0, upto))


class TailSource(DataSource):
    """format("tail"): source_id, source_offset, line of files given by ``path`` (comma-separated paths and globs)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "source_id string, source_offset long, line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TailReader(self.options)


class Listener:
    """Receives lines or datagrams and keeps them, numbered, until they are committed."""

    def __init__(self, kind: str, address: str, most: int = 100_000) -> None:
        self.kind, self.rows, self.base, self.lock = kind, [], 0, threading.Lock()
        #: Rows held at most: a connection then waits, a datagram is dropped and counted.
        self.most, self.dropped, self.room = most, 0, threading.Condition(self.lock)
        if kind == "stdin":
            self.name = "stdin"
            threading.Thread(target=self._stdin, daemon=True).start()
            return
        if kind == "unix":
            self.socket = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
            self.socket.bind(address)
            self.name = f"unix:{address}"
        else:
            host, port = address.rsplit(":", 1)
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM if kind == "udp" else socket.SOCK_STREAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind((host, int(port)))
            self.name = f"{kind}:{self.socket.getsockname()[1]}"
        threading.Thread(target=self._datagrams if kind == "udp" else self._connections, daemon=True).start()

    def _put(self, source: str, line: bytes) -> None:
        with self.room:
            if self.kind == "udp" and len(self.rows) >= self.most:
                self.dropped += 1
                return
            while len(self.rows) >= self.most:
                self.room.wait()
            self.rows.append((source, line.decode("utf-8", "replace")))

    def _stdin(self) -> None:
        for line in sys.stdin.buffer:
            self._put(self.name, line.rstrip(b"\n"))

    def _datagrams(self) -> None:
        while True:
            self._put(self.name, self.socket.recv(65536))

    def _connections(self) -> None:
        self.socket.listen()
        n = 0
        while True:
            peer, _ = self.socket.accept()
            threading.Thread(target=self._lines, args=(peer, f"{self.name}:{n}"), daemon=True).start()
            n += 1

    def _lines(self, peer: socket.socket, source: str) -> None:
        with peer, peer.makefile("rb") as f:
            for line in f:
                self._put(source, line.rstrip(b"\n").removesuffix(b"\r"))

    def between(self, start: int, end: int) -> list[tuple[str, int, str]]:
        with self.lock:
            part = self.rows[start - self.base : end - self.base]
        return [(source, start + k, line) for k, (source, line) in enumerate(part)]

    def commit(self, end: int) -> None:
        with self.room:
            del self.rows[: max(0, end - self.base)]
            self.base = max(self.base, end)
            self.room.notify_all()

    @property
    def end(self) -> int:
        with self.lock:
            return self.base + len(self.rows)


class _ListenReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.listener = Listener(options.get("kind", "tcp"), options.get("address", ""))
        self.most = int(options.get("maxlines", "10000"))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.listener.end, start["n"] + self.most)
        return iter(self.listener.between(start["n"], end)), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.listener.between(start["n"], end["n"]))

    def commit(self, end: dict) -> None:
        self.listener.commit(end["n"])


class ListenSource(DataSource):
    """format("listen"): lines received at ``address`` by ``kind`` tcp, udp or unix, or read from stdin."""

    @classmethod
    def name(cls) -> str:
        return "listen"

    def schema(self) -> str:
        return "source_id string, source_offset long, line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _ListenReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(TailSource)
    spark.dataSource.register(ListenSource)
