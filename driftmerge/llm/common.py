"""What the corpus operators share: table access, the shared work folder and byte-level tokenising."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from driftmerge.sources.shared import materialize, release, shared_dir
from driftmerge.sources.tables import table

__all__ = ["materialize", "release", "shared_dir", "table"]

# Words [^\x20\x09-\x0D]+ are what bytes.split() gives: it cuts at the same six bytes. bytes.lower() changes A-Z alone.
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: PRIME's inverse modulo 2**64.
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
SLICE_BYTES = 1 << 20


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large_string array without nulls: null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len + 1 offsets of a large_string array."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offs


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; one longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int, base: np.uint64 = PRIME) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads a polynomial hash over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Digests(dict):
    """What stands for each word, remembered for the first ``most`` words that a task meets; others are made again."""

    def __init__(self, make: Callable[[bytes], bytes], most: int = 400_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes) -> bytes:
        made = self.make(word)
        if len(self) < self.most:
            self[word] = made
        return made


def cells(column: pa.Array, lo: int = 0, hi: int | None = None) -> list[bytes]:
    """UTF-8 bytes of the rows lo to hi of a large_string array without nulls."""
    return [x.as_buffer().to_pybytes() for x in column[lo:hi]]


def crc_remainder(column: str, of: int) -> str:
    """SQL for crc32(an id as text) modulo `of`."""
    return f"crc32(cast(cast({column} as string) as binary)) % {of}"
