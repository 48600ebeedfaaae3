"""The audit log's key, tokens and session digests."""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class KeyStore(Protocol):
    """Where the log's key is kept; a secret manager or a key chain can stand behind it."""

    def key(self) -> bytes: ...


class FileKeyStore:
    """A 32-byte key in a file that only its owner reads, made at first use. Keep it apart from the log."""

    def __init__(self, path: str):
        self.path = path

    def key(self) -> bytes:
        try:
            with open(os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(secrets.token_bytes(32))
        except FileExistsError:
            pass
        with open(self.path, "rb") as f:
            found = f.read()
        if len(found) != 32:
            raise ValueError("the key must have 32 bytes")
        return found


def authorized(supplied: str | None, expected: str) -> bool:
    """Whether a bearer token is the expected one, compared in constant time."""
    return hmac.compare_digest((supplied or "").encode(), expected.encode())


def same_token(supplied: Column, expected: str) -> Column:
    """The same for a column: digests are compared, so equal prefixes tell nothing."""
    return F.coalesce(F.sha2(supplied, 256) == F.lit(hashlib.sha256(expected.encode()).hexdigest()), F.lit(False))


def session_digest(token: Column, domain: str = "maskwright-session") -> Column:
    """A session's digest: SHA-256 of the domain, a zero byte and the token, so that it serves no other end."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), F.lit(b"\x00"), token.cast("binary")), 256)
