"""Arrays of integers as compressed bytes, in the narrowest type that holds them, the bytes of one weight together."""

from __future__ import annotations

import numpy as np
import zstandard

_TYPES = "BHIQ"


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers; unpack() gives them back as uint64."""
    top = int(x.max()) if len(x) else 0
    kind = next(t for t, b in zip(_TYPES, (8, 16, 32, 64), strict=True) if top < 1 << b)
    narrow = np.ascontiguousarray(x.astype(kind))
    planes = np.ascontiguousarray(narrow.view(np.uint8).reshape(len(x), narrow.itemsize).T) if narrow.itemsize > 1 else narrow
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(x: bytes) -> np.ndarray:
    return narrow(x).astype(np.uint64)


def narrow(x: bytes) -> np.ndarray:
    """The same in the type that they are kept in."""
    kind = np.dtype(x[:1].decode())
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), np.uint8)
    return data if kind.itemsize == 1 else np.ascontiguousarray(data.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Unsigned integers that never fall, by their differences."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x), dtype=np.uint64)
