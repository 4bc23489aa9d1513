"""State files beside the segments: checkpoints, source and delivery offsets, pending batches."""

from __future__ import annotations

import re
from base64 import b64decode, b64encode
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Versions of the file formats.
CHECKPOINT_VERSION = 2
OFFSETS_VERSION = 2
PENDING_VERSION = 1


class Store:
    """Small text files in a folder of any store that Spark reaches; a write replaces the whole file or nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._fs_api = self._jvm.org.apache.hadoop.fs
        self.folder = folder.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._fs_api.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        self._fs.mkdirs(self._path(name).getParent())
        draft = self._path(f"{name}.tmp")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # The draft takes the file's place in one step, which the plain rename does not do everywhere.
        over = self._gateway.new_array(getattr(self._fs_api, "Options$Rename"), 1)
        over[0] = getattr(self._fs_api, "Options$Rename").OVERWRITE
        where = self._fs.makeQualified(draft)
        self._fs_api.FileContext.getFileContext(where.toUri(), self._conf).rename(where, self._fs.makeQualified(self._path(name)), over)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), False)

    def drop(self, name: str) -> None:
        """Delete a folder with all it holds."""
        self._fs.delete(self._path(name), True)

    def move(self, name: str, goal: str) -> None:
        """Move a file of the folder to the path ``goal``, whose folder is made if missing."""
        target = self._fs_api.Path(goal)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(name), target):
            raise OSError(f"{name} could not be moved to {goal}")

    def names(self) -> list[str]:
        found = self._fs.listStatus(self._path("")) if self._fs.exists(self._path("")) else []
        return sorted(f.getPath().getName() for f in found if f.isFile() and not f.getPath().getName().endswith(".tmp"))

    def tail(self, name: str, start: int) -> bytes:
        """The bytes of a file from ``start`` on."""
        stream = self._fs.open(self._path(name))
        try:
            stream.seek(start)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()


def _values(text: str) -> dict[str, str]:
    return dict(line.split("=", 1) for line in text.split("\n") if "=" in line)


@dataclass(frozen=True)
class Checkpoint:
    logical_size: int
    sequence: int
    rotation_index: int

    def text(self) -> str:
        body = f"format_version={CHECKPOINT_VERSION}\nlogical_size={self.logical_size}\nsequence={self.sequence}\nrotation_index={self.rotation_index}\n"
        return f"{body}checkpoint_crc={crc32(body.encode())}\n"

    @classmethod
    def parsed(cls, text: str) -> Checkpoint | None:
        """The checkpoint, or None if it is of another version, incomplete or damaged."""
        body, mark, digest = text.rpartition("checkpoint_crc=")
        found = _values(body)
        if not mark or found.get("format_version") != str(CHECKPOINT_VERSION) or digest.strip() != str(crc32(body.encode())):
            return None
        try:
            return cls(int(found["logical_size"]), int(found["sequence"]), int(found["rotation_index"]))
        except (KeyError, ValueError):
            return None


def recovery_mode(checkpoint: Checkpoint | None, file_size: int) -> tuple[str, int, int]:
    """(mode, byte to scan from, sequence there): tail after a good checkpoint, otherwise a full scan with its reason."""
    if checkpoint is None:
        return "full_scan_incomplete_checkpoint", 0, 0
    if checkpoint.logical_size > file_size:
        return "full_scan_stale_checkpoint", 0, 0
    return "from_checkpoint", checkpoint.logical_size, checkpoint.sequence


@dataclass(frozen=True)
class SourceOffset:
    path: str
    inode: int
    offset: int

    def text(self) -> str:
        return f"path={self.path}\ninode={self.inode}\noffset={self.offset}\n"

    @classmethod
    def parsed(cls, text: str) -> SourceOffset:
        found = _values(text)
        return cls(found.get("path", ""), int(found.get("inode", 0)), int(found.get("offset", 0)))


def offsets_text(offsets: dict[int, int]) -> str:
    return f"format_version={OFFSETS_VERSION}\n" + "".join(f"shard={s},next_sequence={n}\n" for s, n in sorted(offsets.items()))


def parsed_offsets(text: str, shard: int | None = None) -> dict[int, int]:
    """Offsets of a file of either version; ``shard``, from the file's name, must be the only one in it."""
    found = {int(s): int(n) for s, n in re.findall(r"shard=([0-9]+)[,\n]next_sequence=([0-9]+)", text)}
    if shard is not None and set(found) - {shard}:
        raise ValueError(f"the offset file of shard {shard} names another shard")
    return found


def offset_table(spark: SparkSession, path: str) -> DataFrame:
    """(shard, next_sequence) of offset files of either version, read by Spark from any store."""
    text = spark.read.text(path, wholetext=True)
    pairs = F.arrays_zip(
        F.regexp_extract_all("value", F.lit(r"shard=([0-9]+)[,\n]next_sequence=([0-9]+)"), 1).alias("s"),
        F.regexp_extract_all("value", F.lit(r"shard=([0-9]+)[,\n]next_sequence=([0-9]+)"), 2).alias("n"),
    )
    rows = text.select(F.explode(pairs).alias("p"))
    return rows.select(F.col("p.s").cast("int").alias("shard"), F.col("p.n").cast("long").alias("next_sequence"))


@dataclass(frozen=True)
class PendingBatch:
    shard: int
    first_sequence: int
    next_sequence: int
    records: tuple[str, ...]

    def text(self) -> str:
        head = f"format_version={PENDING_VERSION}\nshard={self.shard}\nfirst_sequence={self.first_sequence}\nnext_sequence={self.next_sequence}\n"
        return head + "".join(f"record_b64={b64encode(r.encode()).decode()}\n" for r in self.records)

    @classmethod
    def parsed(cls, text: str) -> PendingBatch | None:
        found = _values(text)
        try:
            if int(found["format_version"]) != PENDING_VERSION:
                return None
            records = tuple(b64decode(x, validate=True).decode() for x in re.findall(r"^record_b64=(.*)$", text, re.M))
            return cls(int(found["shard"]), int(found["first_sequence"]), int(found["next_sequence"]), records)
        except (KeyError, ValueError):
            return None


def read_offsets(store: Store, name: str = "offsets") -> dict[int, int]:
    """Delivery offsets by shard: the shared file's, and over them those of the shards' own files ``<name>.<shard>``."""
    found = parsed_offsets(store.read(name) or "")
    for own in store.names():
        base, _, shard = own.rpartition(".")
        if base == name and shard.isdigit():
            found |= parsed_offsets(store.read(own) or "", int(shard))
    return found


def write_offsets(store: Store, offsets: dict[int, int], name: str = "offsets") -> None:
    """Store every shard's offset in its own file."""
    for shard, after in offsets.items():
        store.write(f"{name}.{shard}", offsets_text({shard: after}))


def read_pending(store: Store, shard: int) -> PendingBatch | None:
    """The batch of a shard that was about to be sent; a file of all shards, from before they had their own, is taken over."""
    old = PendingBatch.parsed(store.read("pending") or "")
    if old is not None:
        if store.read(f"pending.{old.shard}") is None:
            store.write(f"pending.{old.shard}", old.text())
        store.delete("pending")
    return PendingBatch.parsed(store.read(f"pending.{shard}") or "")
