"""Authenticated encryption of values: AES-GCM with the framing nonce(12) + text + tag(16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OVERHEAD = 28


def encrypt(value: Column, key: bytes | None) -> Column:
    """Pass-through without a key; random nonces, so equal values differ."""
    if not key:
        return value.cast("binary")
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return F.aes_encrypt(value.cast("binary"), F.lit(bytearray(key)), F.lit("GCM"))


def decrypt(value: Column, key: bytes | None) -> Column:
    """Null where the tag does not fit or the value is too short: readers treat that as a miss."""
    return value if not key else F.try_aes_decrypt(value, F.lit(bytearray(key)), F.lit("GCM"))


def stored_length(value: Column, key: bytes | None) -> Column:
    return F.octet_length(value) + (OVERHEAD if key else 0)
