"""Keyed fingerprints, encryption envelopes, tokens and ids.

Keys are given as hex and never appear in results.  Fingerprints are HMAC-SHA-256 from
built-in functions; envelopes are AES-256-GCM with the row's context as associated data.
"""

from __future__ import annotations

import hmac as _hmac
import json
import os
import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header bytes of an envelope, the label of matter keys, token letters.
HEADER = "0101"
MATTER_LABEL = "matter-search:"
ENTITY_LETTERS = {"PERSON": "P", "ORGANIZATION": "O"}
VALUE_LETTERS = {"PERSON_NAME": "N", "ORG_NAME": "G", "PHONE": "T", "EMAIL": "E", "ID_CARD": "I", "BANK_ACCOUNT": "B", "ADDRESS": "A"}
_HEX = "0123456789abcdef"


def _flipped(hex_key: Column, byte: int) -> Column:
    """Each byte of a hex string xor ``byte``, by a change of digits, high and low in turn."""
    high, low = byte >> 4, byte & 15
    table = ["".join(_HEX[int(c, 16) ^ x] for c in _HEX) for x in (high, low)]
    at = F.sequence(F.lit(1), F.lit(128))
    digit = lambda i: F.substring(hex_key, i, F.lit(1))
    return F.array_join(F.transform(at, lambda i: F.when(i % 2 == 1, F.translate(digit(i), _HEX, table[0])).otherwise(F.translate(digit(i), _HEX, table[1]))), "")


def hmac_hex(key_hex: Column, message: Column) -> Column:
    """HMAC-SHA-256 of a text as lower-case hex; the key is 32 bytes as lower-case hex."""
    key = F.rpad(key_hex, 128, "0")
    inner = F.sha2(F.concat(F.unhex(_flipped(key, 0x36)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(_flipped(key, 0x5C)), F.unhex(inner)), 256)


def matter_key(search_key_hex: Column, matter_id: Column) -> Column:
    return hmac_hex(search_key_hex, F.concat(F.lit(MATTER_LABEL), matter_id))


def fingerprint(matter_key_hex: Column, value: Column) -> Column:
    return hmac_hex(matter_key_hex, value)


def context(row_id: Column, field: str) -> Column:
    """Associated data that binds an envelope to its row and field, such as ``mention.text``."""
    return F.concat(row_id, F.lit(f":{field}"))


def sealed(value: Column, key: Column, aad: Column) -> Column:
    """Envelope of a value.  ``key`` must be a column, or equal inputs would get equal envelopes."""
    return F.concat(F.unhex(F.lit(HEADER)), F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad))


def opened(envelope: Column, key: Column, aad: Column) -> Column:
    """Value of an envelope; null where header, length, key or context do not fit."""
    body = F.substring(envelope, F.lit(3), F.length(envelope))
    fits = (F.hex(F.substring(envelope, F.lit(1), F.lit(2))) == HEADER) & (F.length(envelope) >= 30)
    return F.when(fits, F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), aad))


def token(letter: Column, random_hex: Column) -> Column:
    return F.concat(F.lit("@"), letter, F.lit("-"), F.upper(random_hex))


def random_hex(digits: int = 16) -> Column:
    """Random hex digits for each row; write them before using them twice."""
    return F.substring(F.replace(F.concat(F.uuid(), F.uuid()), F.lit("-"), F.lit("")), 1, digits)


def row_id(ms: Column) -> Column:
    """Time-ordered id of version 7 for each row; write it before using it twice."""
    r = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    part = lambda at, n: F.substring(r, at, n)  # noqa: E731  digits 13 and 17 of a random id are not random
    time_ = F.lpad(F.lower(F.hex(ms.cast("long"))), 12, "0")
    variant = F.substring(F.lit("89ab"), (F.conv(part(1, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(time_, 1, 8), F.lit("-"), F.substring(time_, 9, 4), F.lit("-7"), part(2, 3), F.lit("-"), variant, part(5, 3), F.lit("-"), part(20, 12))


def synthetic_alias(entity_type: Column, random: Column) -> Column:
    """Alias of an entity that nobody has named."""
    return F.concat(F.initcap(entity_type), F.lit(" "), F.upper(random))


# -- on the driver


def generate_key() -> str:
    return secrets.token_hex(32)


def check_keys(persistence: str, search: str) -> None:
    """Two distinct keys of 32 bytes, or an error."""
    for k in (persistence, search):
        if len(bytes.fromhex(k)) != 32:
            raise ValueError("a key must have 32 bytes")
    if _hmac.compare_digest(persistence, search):
        raise ValueError("the two keys must differ")


def keys_from_environment(persistence: str = "CLOAKFRAME_PERSISTENCE_KEY", search: str = "CLOAKFRAME_SEARCH_KEY") -> tuple[str, str]:
    """Keys from the environment; an error where one is missing or unfit."""
    found = os.environ.get(persistence), os.environ.get(search)
    if None in found:
        raise RuntimeError("no key store is available")
    check_keys(*found)
    return found


def keys_from_file(path: str) -> tuple[str, str]:
    """Keys of a key file, made with two new ones if there is none.

    Only its owner may read it, or it is refused; so is one of another form.
    """
    if not os.path.exists(path):
        made = json.dumps({"version": 1, "persistence": generate_key(), "search": generate_key()})
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(made + "\n")
    if os.stat(path).st_mode & 0o077:
        raise RuntimeError("the key file is open to others")
    with open(path) as f:
        text = f.read()
    try:
        found = json.loads(text)
        if found["version"] != 1:
            raise ValueError
        check_keys(found["persistence"], found["search"])
    except (ValueError, KeyError, TypeError) as e:
        raise RuntimeError("the key file could not be read") from e
    return found["persistence"], found["search"]


def uuid7(ms: int | None = None) -> str:
    """Time-ordered id of version 7."""
    ms = time.time_ns() // 1_000_000 if ms is None else ms
    n = ms << 80 | 7 << 76 | secrets.randbits(12) << 64 | 2 << 62 | secrets.randbits(62)
    h = f"{n:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
