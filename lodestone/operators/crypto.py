"""Per-record encryption of binary columns: PBKDF2 keys, HMAC counter mode, a 16-byte tag. Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import os
import struct
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType


# Fixed values of the format: rounds of the key derivations, the mark of a record's key, and the labels of its two uses.
APPLICATION_ROUNDS, PASSWORD_ROUNDS, RECORD_MARK, CONTENT_USE, TAG_USE = 100_000, 200_000, b"\x01", b"enc", b"mac"


@lru_cache(maxsize=1024)
def application_key(user_id: int, secret: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", secret, str(user_id).encode(), APPLICATION_ROUNDS, 32)


@lru_cache(maxsize=1024)
def password_key(salt: bytes, password: str) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, PASSWORD_ROUNDS, 32)


def record_keys(user_key: bytes, record_id: int) -> tuple[bytes, bytes]:
    """The keys of one record: for its content and for its tag."""
    own = hmac.digest(user_key, struct.pack(">Q", record_id) + RECORD_MARK, "sha256")
    return hmac.digest(own, CONTENT_USE, "sha256"), hmac.digest(own, TAG_USE, "sha256")


def _stream(key: bytes, nonce: bytes, size: int) -> bytes:
    return b"".join(hmac.digest(key, nonce + struct.pack(">Q", i), "sha256") for i in range(-(-size // 32)))[:size]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def seal(content_key: bytes, tag_key: bytes, plain: bytes, nonce: bytes | None = None, tag_nonce: bool = True) -> bytes:
    """nonce, ciphertext, tag. The tag covers the nonce too unless told otherwise."""
    nonce = os.urandom(16) if nonce is None else nonce
    body = _xor(plain, _stream(content_key, nonce, len(plain)))
    return nonce + body + hmac.digest(tag_key, nonce + body if tag_nonce else body, "sha256")[:16]


def open_sealed(content_key: bytes, tag_key: bytes, sealed: bytes, tag_nonce: bool = True) -> bytes:
    nonce, body, tag = sealed[:16], sealed[16:-16], sealed[-16:]
    if len(sealed) < 32 or not hmac.compare_digest(tag, hmac.digest(tag_key, nonce + body if tag_nonce else body, "sha256")[:16]):
        raise PermissionError("wrong key or damaged content")
    return _xor(body, _stream(content_key, nonce, len(body)))


def _udf(one, random: bool = False):
    """random: sealing draws a nonce, so that two evaluations differ and Spark may not make two of one."""

    @F.pandas_udf(BinaryType())
    def run(content: pd.Series, record_id: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else one(bytes(c), int(r)) for c, r in zip(content, record_id, strict=True)])

    return run.asNondeterministic() if random else run


def encrypt_for_user(content: Column, record_id: Column, user_id: int, secret: bytes) -> Column:
    """With one key for each user of an application."""
    return _udf(lambda c, r: seal(application_key(user_id, secret), application_key(user_id, secret), c), random=True)(content, record_id)


def decrypt_for_user(content: Column, record_id: Column, user_id: int, secret: bytes) -> Column:
    return _udf(lambda c, r: open_sealed(application_key(user_id, secret), application_key(user_id, secret), c))(content, record_id)


def encrypt_with_password(content: Column, record_id: Column, salt: bytes, password: str) -> Column:
    """With keys of each record, from the user's password."""
    return _udf(lambda c, r: seal(*record_keys(password_key(salt, password), r), c, tag_nonce=False), random=True)(content, record_id)


def decrypt_with_password(content: Column, record_id: Column, salt: bytes, password: str) -> Column:
    return _udf(lambda c, r: open_sealed(*record_keys(password_key(salt, password), r), c, tag_nonce=False))(content, record_id)


def escrow_key(user_key: bytes, server_key: bytes) -> bytes:
    """A user's key, sealed for the server."""
    return seal(server_key, server_key, user_key)


def recover_key(escrowed: bytes, server_key: bytes) -> bytes:
    return open_sealed(server_key, server_key, escrowed)


def read_as_server(records, grants, escrow, server_key: bytes):
    """(record_id, content) of (record_id, user_id, content) records that were granted to the server, opened with the users' escrowed keys.

    A record without grant, or of a user without escrowed key, is left out; a wrong server key raises.
    """
    granted = records.join(grants.select("record_id").distinct(), "record_id", "left_semi").join(escrow.select("user_id", "escrowed"), "user_id")

    @F.pandas_udf(BinaryType())
    def opened(content: pd.Series, record_id: pd.Series, escrowed: pd.Series) -> pd.Series:
        return pd.Series([open_sealed(*record_keys(recover_key(bytes(e), server_key), int(r)), bytes(c), tag_nonce=False) for c, r, e in zip(content, record_id, escrowed, strict=True)])

    return granted.select("record_id", opened("content", "record_id", "escrowed").alias("content"))


def open_by_mode(mode: Column, content: Column, record_id: Column, user_id: int, salt: bytes, password: str, secret: bytes) -> Column:
    """The content of one user's records: of mode ``zero`` by the password's keys, of mode ``managed`` by the application's."""
    zero = F.when(mode == "zero", content)
    managed = F.when(mode == "managed", content)
    return F.coalesce(decrypt_with_password(zero, record_id, salt, password), decrypt_for_user(managed, record_id, user_id, secret))
