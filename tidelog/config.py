"""Engine options with defaults, read from key=value files and overridden by arguments."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path

from tidelog.functions.codec import RecordFormat


@dataclass(frozen=True)
class EngineConfig:
    log_dir: str = "logs"
    archive_dir: str = "logs/archive"
    file_prefix: str = "shard"
    shards: int = 4
    routing: str = "hash_modulo"
    virtual_nodes: int = 128
    empty_route_key: str = "local"
    record_timestamp: bool = True
    record_shard_id: bool = True
    record_sequence: bool = True
    record_level: bool = True
    crc_class: str = "full"
    rotate_size_bytes: int = 256 << 20
    rotate_interval_seconds: int = 0
    compress_archives: bool = False
    retention_seconds: int = 0
    max_archived_files_per_shard: int = 0
    sink_batch_size: int = 128

    def __post_init__(self) -> None:
        if self.routing not in ("hash_modulo", "consistent_hashing"):
            raise ValueError("routing must be hash_modulo or consistent_hashing")
        if self.empty_route_key not in ("local", "round_robin"):
            raise ValueError("empty_route_key must be local or round_robin")
        for name in ("virtual_nodes", "sink_batch_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("shards", "rotate_size_bytes", "rotate_interval_seconds", "retention_seconds", "max_archived_files_per_shard"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        self.format  # noqa: B018  checks the checksum class

    @property
    def format(self) -> RecordFormat:
        return RecordFormat(self.record_timestamp, self.record_shard_id, self.record_sequence, self.record_level, self.crc_class)


def load(path: str | None = None, **given) -> EngineConfig:
    """Options of a file (``key=value``, # starts a comment, dashes count as underscores), then the given ones."""
    known = {f.name: type(f.default) for f in fields(EngineConfig)}
    found = {}
    for line in Path(path).read_text().splitlines() if path else ():
        text = line.split("#", 1)[0].strip()
        if not text:
            continue
        name, eq, value = text.partition("=")
        name = name.strip().replace("-", "_")
        if not eq:
            raise ValueError(f"no = in {line!r}")
        if name in known:
            found[name] = _typed(value.strip(), known[name])
    return replace(EngineConfig(), **found | given)


def _typed(value: str, kind: type):
    if kind is bool:
        return value.lower() in ("1", "true", "yes", "on")
    return kind(value)
