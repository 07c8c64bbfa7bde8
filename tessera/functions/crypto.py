"""Envelope encryption of columns: AES-256-GCM with the row's id as associated data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PREFIX = "enc:v1:"


def encrypt(text: Column, key: Column, iv: Column, row_id: Column) -> Column:
    """``enc:v1:`` and the base64 of iv, ciphertext and tag; null for null. The iv is 12 bytes and never used twice with a key."""
    return F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), iv, row_id)))


def decrypt(sealed: Column, key: Column, row_id: Column) -> Column:
    """The text; null if the key is gone (shredded), wrong, or the text belongs to another row."""
    raw = F.unbase64(F.substring(sealed, len(PREFIX) + 1, F.length(sealed)))
    plain = F.try_aes_decrypt(raw, key, F.lit("GCM"), F.lit("DEFAULT"), row_id).cast("string")
    return F.when(F.startswith(sealed, F.lit(PREFIX)), plain).otherwise(sealed)
