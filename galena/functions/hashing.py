"""Stable identities and sampling."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(text: Column) -> Column:
    """The name-based UUID (version 3) of a text."""
    h = F.md5(text)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def content_id(prefix: str, *fields: Column) -> Column:
    """A prefix and the SHA-256 of the fields, each behind its length in bytes."""
    parts = [F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in fields]
    return F.concat(F.lit(prefix), F.sha2(F.concat(*parts), 256))


def sampling_bucket(key: Column, buckets: int = 10_000) -> Column:
    """A stable bucket of a key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets


def keyed_fingerprint(secret: str):
    """A column function: HMAC-SHA256 under a secret of at least 32 characters, in base 16; null of a null. It is made
    of digests, so that texts stay in the JVM."""
    if len(secret) < 32:
        raise ValueError("the secret must have at least 32 characters")
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))

    def fingerprint(text: Column) -> Column:
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256))), 256)

    return fingerprint


def sketch_bucket(fingerprint: Column) -> Column:
    """The bucket (0 to 255) of a fingerprint: its first two bytes modulo 256."""
    return F.conv(F.substring(fingerprint, 1, 4), 16, 10).cast("int") % 256
