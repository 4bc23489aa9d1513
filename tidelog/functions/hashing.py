"""Hashes as column expressions: FNV-1a 64 in BIGINT bit arithmetic, and XXH64 where Spark's seed differs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# FNV-1a 64-bit offset basis and the low part of its prime (2^40 + 435).
FNV_BASIS = 14695981039346656037
FNV_LOW = 435

_LOW32 = 0xFFFFFFFF


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a string as an array of ints, through the one-byte-per-character encoding."""
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.transform(F.filter(chars, lambda c: c != ""), F.ascii)


def fnv1a64(text: Column) -> Column:
    """FNV-1a 64 as the BIGINT with the same bits.

    The product with the prime is put together from 32-bit halves, so nothing overflows in ANSI mode
    and no DECIMAL is needed.
    """

    def step(h: Column, b: Column) -> Column:
        low = h.bitwiseAND(F.lit(_LOW32)).bitwiseXOR(b.cast("long"))
        high = F.shiftrightunsigned(h, 32)
        product = low * FNV_LOW
        top = (high * FNV_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(_LOW32))
        return F.shiftleft(top, 32).bitwiseOR(product.bitwiseAND(F.lit(_LOW32)))

    return F.aggregate(byte_values(text), F.lit(FNV_BASIS - 2**64).cast("long"), step)


def unsigned(bits: Column) -> Column:
    """The unsigned value of a BIGINT's bits as DECIMAL(20,0)."""
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, (wide + F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def unsigned_mod(bits: Column, n: int) -> Column:
    """Unsigned value modulo n, from 32-bit halves."""
    high, low = F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(_LOW32))
    return ((high % n) * (2**32 % n) + low % n) % n


def crc_hex(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(text))), 8, "0")


@F.pandas_udf(StringType())
def xxh64_hex(texts: pd.Series) -> pd.Series:
    """XXH64 with seed 0 as 16 hex digits; Spark's own xxhash64 has another seed."""
    import xxhash

    return texts.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t.encode()))
