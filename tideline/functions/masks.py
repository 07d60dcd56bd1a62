"""Column masks: null, redaction, and a keyed hash (HMAC-SHA256) in built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[redacted]"
MIN_KEY_BYTES = 32


def hmac_pads(key: bytes) -> tuple[str, str]:
    """Inner and outer 64-byte pads in hex."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Lower-case hex; null stays null."""
    inner, outer = (F.unhex(F.lit(p)) for p in hmac_pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def mask_value(value: Column, how: str, key: bytes) -> Column:
    if how == "hash":
        if len(key) < MIN_KEY_BYTES:
            raise ValueError(f"a mask key has {MIN_KEY_BYTES} bytes or more")
        return hmac_sha256(value, key)
    if how == "redact":
        return F.when(value.isNotNull(), F.lit(REDACTED))
    if how == "null":
        return F.lit(None).cast("string")
    raise ValueError(f"unknown mask {how}")


def mask_image(img: Column, masks: dict[str, str], key: bytes) -> Column:
    """img with its masked columns changed; null values and absent columns stay as they are."""

    def one(e: Column) -> Column:
        value = e["value"]
        for name, how in sorted(masks.items()):
            value = F.when((e["name"] == name) & e["value"].isNotNull(), mask_value(e["value"], how, key)).otherwise(value)
        return F.struct(e["name"].alias("name"), value.alias("value"))

    return F.transform(img, one)


def check_key_masks(masks: dict[str, str], key_columns: list[str]) -> None:
    """Key columns take no mask but the hash, as other masks would merge rows."""
    for name in key_columns:
        if masks.get(name, "hash") != "hash":
            raise ValueError(f"key column {name} can only be hashed")
