"""Keyed message digest composed from ``sha2``."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a UTF-8 string column; the two pads are computed once."""
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)
