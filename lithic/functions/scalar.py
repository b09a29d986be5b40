"""Scalar functions: fingerprints, distances, encryption."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(data: Column, nul_safe: bool = False) -> Column:
    """SHA-256 in hex; ``nul_safe`` turns bytes 00 into 80."""
    h = F.sha2(data, 256)
    return F.regexp_replace(h, r"\G((?:(?!00)[0-9a-f]{2})*)00", "$180") if nul_safe else h


def md5_fingerprint(data: Column) -> Column:
    """MD5 in hex, for what needs a short name only."""
    return F.md5(data)


def hex_name(data: Column) -> Column:
    return F.upper(F.hex(data))


def byte_dump(data: Column) -> Column:
    """Bytes in hex, set apart by spaces."""
    return F.rtrim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)


def hamming_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def edit(a: Column, b: Column, threshold: int | None = None) -> Column:
    return F.levenshtein(a, b) if threshold is None else F.levenshtein(a, b, threshold)


def overlap(a: Column, b: Column) -> Column:
    """Share of equal super-features."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def distance(method: str, a: Column, b: Column) -> Column:
    """One of ``euclidean hamming bits edit overlap`` by name."""
    return {"euclidean": euclidean, "hamming": hamming, "bits": hamming_bits, "edit": edit, "overlap": overlap}[method](a, b)


def encrypt(data: Column, key: Column) -> Column:
    """AES-256 in GCM mode: a random nonce each, authenticated."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def decrypt(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"))


def envelope(data: Column, chunk_key: Column, master: Column) -> Column:
    """Data under the chunk's key, and that key under the master key."""
    return F.struct(encrypt(data, chunk_key).alias("data"), encrypt(chunk_key, master).alias("key"))


def open_envelope(sealed: Column, master: Column) -> Column:
    return decrypt(sealed["data"], decrypt(sealed["key"], master))


def _xor(a: Column, b: Column) -> Column:
    """Exclusive or of two hex strings of one length, a multiple of 8."""
    word = lambda s, i: F.conv(F.substring(s, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    parts = F.transform(F.sequence(F.lit(0), (F.length(a) / 8).cast("int") - 1), lambda i: F.lpad(F.hex(word(a, i).bitwiseXOR(word(b, i))), 8, "0"))
    return F.array_join(parts, "")


def _keystream(block: Column, key: Column) -> Column:
    """One block (hex) under the block cipher: the first block of padded ECB."""
    return F.substring(F.hex(F.aes_encrypt(F.unhex(block), key, F.lit("ECB"))), 1, 32)


def encrypt_cfb(data: Column, key: Column, iv: bytes = bytes(16)) -> Column:
    """AES in CFB mode (128-bit feedback); the same length as ``data``.

    Block by block, as each needs the one before it. The zero vector is the
    default for compatibility only: it shows equal beginnings.
    """
    blocks = F.ceil(F.octet_length(data) / 16).cast("int")
    part = lambda i: F.rpad(F.hex(F.substring(data, i * 16 + 1, F.lit(16))), 32, "0")

    def step(state: Column, i: Column) -> Column:
        return F.array_append(state, _xor(part(i), _keystream(F.element_at(state, -1), key)))

    all_ = F.aggregate(F.sequence(F.lit(0), blocks - 1), F.array(F.lit(iv.hex().upper())), step)
    whole = F.unhex(F.array_join(F.slice(all_, F.lit(2), blocks), ""))
    return F.when(blocks > 0, F.substring(whole, F.lit(1), F.octet_length(data))).otherwise(data)


def decrypt_cfb(data: Column, key: Column, iv: bytes = bytes(16)) -> Column:
    blocks = F.ceil(F.octet_length(data) / 16).cast("int")
    part = lambda i: F.rpad(F.hex(F.substring(data, i * 16 + 1, F.lit(16))), 32, "0")
    before = lambda i: F.when(i > 0, part(i - 1)).otherwise(F.lit(iv.hex().upper()))
    parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: _xor(part(i), _keystream(before(i), key)))
    return F.when(blocks > 0, F.substring(F.unhex(F.array_join(parts, "")), F.lit(1), F.octet_length(data))).otherwise(data)


def _crc_table(polynomial: int = 0x82F63B78) -> list[int]:
    """The byte table of a reflected 32-bit CRC, from its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (polynomial if c & 1 else 0)
        table.append(c)
    return table


_CRC32C = _crc_table()


def crc32c_all(batch: list[bytes]) -> np.ndarray:
    """The CRC of every row, all rows byte by byte in step."""
    table = np.array(_CRC32C, np.uint32)
    size = np.array([len(x) for x in batch], np.int64)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    data, left = np.frombuffer(b"".join(batch), np.uint8), np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))))
    crc = np.full(len(batch), 0xFFFFFFFF, np.uint32)
    for i, n in enumerate(left):  # the n longest rows have a byte i
        crc[:n] = table[(crc[:n] ^ data[start[:n] + i]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(batch), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C (Castagnoli) as a long; ``crc32`` is the built-in for the other polynomial."""

    @F.pandas_udf("long")
    def udf(batch: pd.Series) -> pd.Series:
        crc = pd.Series(crc32c_all([x or b"" for x in batch]), dtype="Int64")
        return crc.mask(batch.isna().to_numpy())

    return udf(data)


def hash32_of(data: bytes, seed: int) -> int:
    """The 32-bit hash of the key-value format (fixed constants), little-endian words."""
    m, mask = 0xC6A4A793, 0xFFFFFFFF
    whole = len(data) // 4
    h = (seed ^ len(data) * m) & mask
    for w in struct.unpack_from(f"<{whole}I", data):
        h = (h + w) * m & mask
        h ^= h >> 16
    if rest := data[4 * whole :]:
        h = (h + int.from_bytes(rest, "little")) * m & mask
        h ^= h >> 24
    return h


def hash32(data: Column, seed: int = 0xBC9F1D34) -> Column:
    """``hash32_of`` as a long; null for null."""

    @F.pandas_udf("long")
    def udf(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else hash32_of(x, seed) for x in batch], dtype="Int64")

    return udf(data)


def varint(n: Column) -> Column:
    """A number from 0 on as bytes of seven bits, low ones first; all but the last have the top bit."""
    bits = F.length(F.bin(n))
    part = lambda i: F.call_function("shiftright", n, i * 7).bitwiseAND(F.lit(127)) + F.when((i + 1) * 7 < bits, 128).otherwise(0)
    each = F.transform(F.sequence(F.lit(0), F.floor((bits - 1) / 7).cast("int")), lambda i: F.lpad(F.hex(part(i)), 2, "0"))
    return F.unhex(F.array_join(each, ""))


def from_varint(data: Column) -> Column:
    """The number that the bytes of one ``varint`` stand for."""
    h = F.hex(data)
    byte = lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    # Horner's rule from the last byte: times 128 each.
    return F.aggregate(F.sequence(F.octet_length(data) - 1, F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda a, i: a * 128 + byte(i) % 128)


def masked_crc(crc: Column) -> Column:
    """A CRC rotated by 15 bits, plus a constant of the log format (fixed value)."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17))
    return (turned + 0xA282EAD8).bitwiseAND(F.lit(0xFFFFFFFF))
