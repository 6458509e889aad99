"""Replacement values as SQL fragments: masks, hashes, keyed hashes and encryption tokens."""

from __future__ import annotations

import hashlib

from telemill.functions.checksums import digits_only
from telemill.functions.sqltext import let, lit

HMAC_BLOCK = 64


def sha256_token(text: str) -> str:
    """``sha256:`` and the hex digest of the UTF-8 text."""
    return f"concat('sha256:', sha2({text}, 256))"


def hmac_sha256_hex(text: str, key: bytes) -> str:
    """RFC 2104 HMAC-SHA-256 as hex: two SHA-256 calls over key literals padded on the driver."""
    block = hashlib.sha256(key).digest() if len(key) > HMAC_BLOCK else key
    block = block.ljust(HMAC_BLOCK, b"\0")
    inner_pad = lit(bytes(b ^ 0x36 for b in block))
    outer_pad = lit(bytes(b ^ 0x5C for b in block))
    inner = f"unhex(sha2(concat({inner_pad}, encode({text}, 'UTF-8')), 256))"
    return f"sha2(concat({outer_pad}, {inner}), 256)"


def hmac_token(text: str, key: bytes | None) -> str:
    """Keyed token; without a key of at least 32 bytes the plain SHA-256 token."""
    if key is None or len(key) < 32:
        return sha256_token(text)
    return f"concat('hmac-sha256:', {hmac_sha256_hex(text, key)})"


def encrypt_token(text: str, key: bytes | None) -> str:
    """AES-256-GCM token ``enc:aesgcm:nonce:tag:ciphertext``; empty text without a 32-byte key."""
    if key is None or len(key) != 32:
        return "''"
    sealed = f"aes_encrypt(encode({text}, 'UTF-8'), {lit(key)}, 'GCM')"
    layout = (
        "concat('enc:aesgcm:', base64(substring(box, 1, 12)), ':', "
        "base64(substring(box, octet_length(box) - 15, 16)), ':', "
        "base64(substring(box, 13, octet_length(box) - 28)))"
    )
    return let("box", sealed, layout)


def decrypt_token(token: str, key: bytes) -> str:
    """Inverse of :func:`encrypt_token`."""
    parts = [f"unbase64(split({token}, ':')[{i}])" for i in (2, 4, 3)]
    return f"decode(aes_decrypt(concat({', '.join(parts)}), {lit(key)}, 'GCM'), 'UTF-8')"


def mask_middle(text: str) -> str:
    """First two and last two characters stay; four or fewer become ``****``."""
    return (
        f"IF(length({text}) <= 4, '****', "
        f"concat(left({text}, 2), repeat('*', length({text}) - 4), right({text}, 2)))"
    )


def mask_email(text: str) -> str:
    """``a***@domain``."""
    at = f"instr({text}, '@')"
    return f"IF({at} > 1, concat(left({text}, 1), '***', substring({text}, {at})), {mask_middle(text)})"


def mask_card(text: str) -> str:
    """``****-****-****-`` and the last four digits."""
    masked = f"IF(length(ds) >= 4, concat('****-****-****-', right(ds, 4)), {mask_middle(text)})"
    return let("ds", digits_only(text), masked)


def mask_digits(text: str) -> str:
    """Stars for all digits but the last four."""
    masked = f"IF(length(ds) >= 4, concat(repeat('*', length(ds) - 4), right(ds, 4)), {mask_middle(text)})"
    return let("ds", digits_only(text), masked)
