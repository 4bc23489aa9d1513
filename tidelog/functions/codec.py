"""Record lines: encoding, verification and decoding as column expressions.

A line is TAB-joined ``key=value`` fields, optionally behind a checksum field. Which fields and which
checksum class are written is a RecordFormat; a reader needs no format, as lines describe themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import crc_hex, xxh64_hex

# Field keys in order, checksum prefix and classes, levels.
CRC_CLASSES = ("none", "header", "full", "payload_hash")
LEVELS = ("INFO", "WARN", "ERROR")
_PAYLOAD_MARK = "\tpayload="
#: A key may be spelled with escapes, so a backslash also asks for a parse.
_ENVELOPE_KEYS = r'"(?:message|agent_id|source_id|source_offset|ingest_timestamp|attributes)"|\\u'

FIELDS = ["crc", "timestamp", "shard", "has_sequence", "sequence", "level", "payload", "agent_id", "source_id", "source_offset", "ingest_timestamp", "attributes"]


@dataclass(frozen=True)
class RecordFormat:
    """What a writer puts into each line."""

    timestamp: bool = True
    shard: bool = True
    sequence: bool = True
    level: bool = True
    crc: str = "full"

    def __post_init__(self) -> None:
        if self.crc not in CRC_CLASSES:
            raise ValueError(f"crc class must be one of {', '.join(CRC_CLASSES)}")
        if self.crc in ("header", "payload_hash") and not (self.timestamp or self.shard or self.sequence or self.level):
            raise ValueError("a checksum of the fields needs at least one field")


def sanitised(text: Column) -> Column:
    """Line breaks and tabs as single spaces."""
    return F.translate(text, "\n\r\t", "   ")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def encoded(fmt: RecordFormat, timestamp: Column, shard: Column, sequence: Column, level: Column, payload: Column) -> Column:
    """The line of a record, without its line break."""
    clean = sanitised(payload)
    head = [
        *([F.concat(F.lit("ts="), timestamp)] if fmt.timestamp else []),
        *([F.concat(F.lit("shard="), shard.cast("string"))] if fmt.shard else []),
        *([F.concat(F.lit("seq="), sequence.cast("string"))] if fmt.sequence else []),
        *([F.concat(F.lit("level="), level)] if fmt.level else []),
    ]
    if not head and fmt.crc == "none":
        return clean
    meta = F.concat_ws("\t", *head)
    body = F.concat_ws("\t", *head, F.concat(F.lit("payload="), clean))
    if fmt.crc == "full":
        return F.concat(F.lit("crc="), crc_hex(body), F.lit("\t"), body)
    if fmt.crc == "header":
        return F.concat(F.lit("crc=h:"), crc_hex(meta), F.lit("\t"), body)
    if fmt.crc == "payload_hash":
        digest = xxh64_hex(clean)
        return F.concat(F.lit("crc=x:"), crc_hex(F.concat(meta, digest)), F.lit(":"), digest, F.lit("\t"), body)
    return body


def field(body: Column, key: str) -> Column:
    """Value of the first TAB-separated token that begins with ``key=``, null if none."""
    mark = f"{key}="
    found = F.regexp_extract(body, rf"(?:^|\t)({mark}[^\t]*)", 1)
    return F.when(found != "", F.substring(found, len(mark) + 1, 2**31 - 1))


def _whole_number(text: Column, most: int) -> Column:
    """Digits only and no more than ``most``; null otherwise."""
    wide = F.when(text.rlike("^[0-9]{1,20}$"), text.cast("decimal(20,0)"))
    return F.when(wide <= F.lit(most).cast("decimal(20,0)"), wide.cast("long"))


def decoded(lines: DataFrame, column: str = "line", hashes: bool = True) -> DataFrame:
    """The columns of ``lines`` with ``valid`` and the record's fields; of an invalid line the fields mean nothing.

    hashes False skips the payload-hash class's XXH64, the only part that leaves the JVM; such lines
    then pass on their checksum alone.
    """
    line = F.col(column)
    mark = F.regexp_extract(line, "^crc=((?:h:)?[0-9a-fA-F]{8}|x:[0-9a-fA-F]{8}:[0-9a-fA-F]{16})\t", 1)
    has_crc = line.startswith("crc=")
    rows = lines.withColumns({
        "_crc": F.when(has_crc, mark),
        "_body": F.when(has_crc, F.when(mark != "", F.substring(line, F.length(mark) + 6, 2**31 - 1))).otherwise(line),
    })
    rows = rows.withColumn("_payload", field(F.col("_body"), "payload"))
    body, crc, payload = F.col("_body"), F.lower("_crc"), F.col("_payload")
    head = F.substring_index(body, _PAYLOAD_MARK, 1)
    digest = F.substring(crc, 12, 16)
    # Lines of other classes leave the JVM as nulls.
    kept = xxh64_hex(F.when(crc.startswith("x:"), F.coalesce(payload, F.lit("")))) == digest if hashes else F.lit(True)
    intact = (
        F.when(F.col("_crc").isNull(), True)
        .when(crc == "", False)
        .when(crc.startswith("h:"), F.substring(crc, 3, 8) == crc_hex(head))
        .when(crc.startswith("x:"), (F.substring(crc, 3, 8) == crc_hex(F.concat(head, digest))) & kept)
        .otherwise(crc == crc_hex(body))
    )
    rows = rows.withColumns({
        "_intact": intact,
        "_ts": field(body, "ts"),
        "_shard": field(body, "shard"),
        "_seq": field(body, "seq"),
        "_level": field(body, "level"),
        # A filter on ``valid`` also names this column, so it stays above; pushed below, it would work everything out again.
        "_row": F.monotonically_increasing_id(),
    })
    shard, seq = _whole_number(F.col("_shard"), 2**32 - 1), _whole_number(F.col("_seq"), 2**63 - 1)
    readable = (
        (F.col("_shard").isNull() | shard.isNotNull())
        & (F.col("_seq").isNull() | seq.isNotNull())
        & (F.col("_level").isNull() | F.col("_level").isin(*LEVELS))
    )
    digits = F.when(crc.startswith("h:") | crc.startswith("x:"), F.substring(crc, 3, 8)).otherwise(crc)
    rows = rows.withColumns({
        "valid": F.coalesce(F.col("_intact") & readable & (F.col("_row") >= 0), F.lit(False)),
        "crc": F.coalesce(F.conv(F.when(digits != "", digits), 16, 10).cast("long"), F.lit(0)),
        "timestamp": F.coalesce("_ts", F.lit("")),
        "shard": F.coalesce(shard, F.lit(0)),
        "has_sequence": F.col("_seq").isNotNull(),
        "sequence": F.coalesce(seq, F.lit(0)),
        "level": F.coalesce("_level", F.lit("INFO")),
        "payload": F.coalesce("_payload", "_body", F.lit("")),
    })
    rows = rows.drop("_crc", "_body", "_intact", "_ts", "_shard", "_seq", "_level", "_payload", "_row")
    return unwrapped(rows)


def sequence_of(line: Column) -> Column:
    """The sequence number of a line, null without a readable one; nothing else is decoded or verified."""
    return _whole_number(field(F.substring_index(line, _PAYLOAD_MARK, 1), "seq"), 2**63 - 1)


def level_name(code: Column) -> Column:
    """INFO, WARN or ERROR for 0, 1 and 2, otherwise UNKNOWN."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in LEVELS]), code.cast("int")), F.lit("UNKNOWN"))


def unwrapped(rows: DataFrame) -> DataFrame:
    """Take the agent's envelope off payloads that are JSON objects holding one of its keys.

    Only values of the right JSON kind count: a message that is a number is no message.
    """
    # A payload without any of the keys is no envelope and is not parsed.
    named = F.col("payload").startswith("{") & F.col("payload").rlike(_ENVELOPE_KEYS)
    rows = rows.withColumn("_v", F.when(named, F.try_parse_json("payload")))

    def text(key: str) -> Column:
        inner = F.try_variant_get("_v", f"$.{key}", "variant")
        return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get("_v", f"$.{key}", "string"))

    offset = F.when(F.schema_of_variant(F.try_variant_get("_v", "$.source_offset", "variant")) == "BIGINT", F.try_variant_get("_v", "$.source_offset", "long"))
    rows = rows.withColumns({
        "_m": text("message"),
        "agent_id": F.coalesce(text("agent_id"), F.lit("")),
        "source_id": F.coalesce(text("source_id"), F.lit("")),
        "source_offset": offset,
        "ingest_timestamp": F.coalesce(text("ingest_timestamp"), F.lit("")),
        "attributes": F.coalesce(F.try_variant_get("_v", "$.attributes", "map<string,string>"), F.create_map().cast("map<string,string>")),
    })
    return rows.withColumn("payload", F.coalesce("_m", "payload")).drop("_v", "_m")
