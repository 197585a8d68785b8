"""Scalar functions: hashes, lineage, block sizes, variable-length integers, compression and proofs.

Everything that Spark has stays in the JVM. Compression, the element codec and keyed proofs have no built-in
counterpart and are Arrow-batched functions.
"""

from __future__ import annotations

import hashlib
import hmac
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIFF = 256 * 1024
BLOCK, TARGET_BLOCKS, LARGEST_BLOCK = 4096, 32_000, 4 << 20
MODULUS = 65_521
#: The most that a compressed literal may grow to when it is read.
MOST_INFLATED = 64 << 20


def strong8(content: Column) -> Column:
    """The first eight bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(content, 256), 1, 16))


def lineage(path: Column, text: Column) -> Column:
    """A 60-bit id of a path's first content, odd: two replicas that start alike share it."""
    return F.conv(F.substring(F.sha2(F.concat(path, F.lit("|"), text), 256), 1, 15), 16, 10).cast("long").bitwiseOR(F.lit(1))


def block_size(length: Column) -> Column:
    """4096 for up to 32,000 blocks; beyond, the next power of two of length / 32,000, at most 4 MiB."""
    raw = F.floor(length.cast("decimal(20,0)") / F.lit(TARGET_BLOCKS)).cast("long")
    bits = F.length(F.regexp_replace(F.bin(F.greatest(raw - 1, F.lit(0))), "^0+", ""))
    power = F.when(raw <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2), bits).cast("long"))
    return F.when(length <= TARGET_BLOCKS * BLOCK, F.lit(BLOCK).cast("long")).otherwise(F.least(F.greatest(power, F.lit(BLOCK).cast("long")), F.lit(LARGEST_BLOCK).cast("long")))


def sniffed(content: Column) -> Column:
    """The prefix that decides between text and binary, cut back to a whole character."""
    head = F.substring(content, 1, SNIFF)
    return F.when(F.length(content) <= SNIFF, content).otherwise(F.unhex(F.regexp_replace(F.hex(head), "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])$", "")))


def is_binary(content: Column) -> Column:
    """A NUL byte, or bytes that aren't UTF-8."""
    return F.contains(content, F.unhex(F.lit("00"))) | ~F.is_valid_utf8(content.cast("string"))


def lossy_text(content: Column) -> Column:
    """Bytes as text: what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def varint_length(value: Column) -> Column:
    """Bytes of an unsigned value in groups of seven bits."""
    out = F.lit(1)
    for k in range(1, 9):
        out = out + F.when(value >= (1 << 7 * k), 1).otherwise(0)
    return out


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def deflate(data: bytes | None) -> bytes | None:
    """A fast raw DEFLATE pass, or None where it saves less than a tenth or the data are short."""
    if data is None or len(data) < 256:
        return None
    press = zlib.compressobj(1, zlib.DEFLATED, -15)
    out = press.compress(data) + press.flush()
    return out if len(out) * 10 < len(data) * 9 else None


def inflate(data: bytes, most: int = MOST_INFLATED) -> bytes:
    unpack = zlib.decompressobj(-15)
    out = unpack.decompress(data, most)
    if unpack.unconsumed_tail or not unpack.eof:
        raise ValueError("the data are cut off, or grow beyond the bound")
    return out


@F.arrow_udf(T.BinaryType())
def maybe_compress(data: pa.Array) -> pa.Array:
    return pa.array((deflate(x.as_buffer()) if x.is_valid else None for x in data), pa.binary())


@F.arrow_udf(T.BinaryType())
def decompress(data: pa.Array) -> pa.Array:
    return pa.array((inflate(x.as_buffer()) if x.is_valid else None for x in data), pa.binary())


#: Tags of the two ends of a link. Fixed values of this engine.
ROLES = {"initiator": b"driftmerge initiator", "responder": b"driftmerge responder"}


def proof(secret: bytes, role: str, nonce_i: bytes, nonce_r: bytes, binding: bytes | None) -> bytes:
    """HMAC-SHA256 over the role, both nonces and the channel; no binding differs from a binding of zeros.

    The two words for the channel are fixed values of the model.
    """
    channel = b"unbound" if binding is None else b"bound" + binding
    return hmac.new(secret, ROLES[role] + nonce_i + nonce_r + channel, hashlib.sha256).digest()


@F.pandas_udf(T.BinaryType())
def mac(secret: pd.Series, role: pd.Series, nonce_i: pd.Series, nonce_r: pd.Series, binding: pd.Series) -> pd.Series:
    rows = zip(secret, role, nonce_i, nonce_r, binding, strict=True)
    return pd.Series([proof(s, r, a, b, c if isinstance(c, bytes | bytearray) else None) for s, r, a, b, c in rows])


@F.pandas_udf(T.BooleanType())
def verify(expected: pd.Series, presented: pd.Series) -> pd.Series:
    return pd.Series([p is not None and hmac.compare_digest(bytes(e), bytes(p)) for e, p in zip(expected, presented, strict=True)])
