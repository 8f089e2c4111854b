"""Column expressions of payload protection: masking, signatures, encrypted envelopes. Keys are parameters, never columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(config: Column) -> Column:
    """JSON text in which each string value that refers to a secret is replaced."""
    return F.regexp_replace(config, r'"(?:[^"\\]|\\.)*\$\{(?:env|file):(?:[^"\\]|\\.)*"(?!\s*:)', '"[REDACTED]"')


def hmac_sha256(body: Column, secret: bytes) -> Column:
    """Hex digest of a keyed hash of the body's UTF-8 bytes, in built-in functions."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signature(body: Column, secret: bytes) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(body, secret))


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:16]


def encrypted(payload: Column, key: bytes, nonce: Column) -> Column:
    """The payload as a JSON envelope of AES-256-GCM; nonce: 12 bytes that never come twice under one key."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    sealed = F.aes_encrypt(payload.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("NONE"), nonce)
    body = F.substring(sealed, 13, 1 << 30)  # Spark puts the nonce first
    return F.concat(
        F.lit(f'{{"_enc":true,"v":1,"kms":"local","kid":"{key_id(key)}","alg":"AES256GCM","iv":"'), F.base64(nonce),
        F.lit('","ct":"'), F.base64(body), F.lit('"}'),
    )


def decrypted(envelope: Column, keys: list[bytes]) -> Column:
    """The payload of an envelope under the key that it names; null if that isn't among keys or the text was changed.

    A payload that is no envelope passes.
    """
    field = lambda name: F.get_json_object(envelope, f"$.{name}")
    sealed = F.concat(F.unbase64(field("iv")), F.unbase64(field("ct")))
    out = F.lit(None).cast("string")
    for key in keys:
        out = F.when(field("kid") == key_id(key), F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM")).cast("string")).otherwise(out)
    return F.when(F.coalesce(field("_enc") == "true", F.lit(False)), out).otherwise(envelope)
