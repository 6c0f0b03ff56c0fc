"""Arrays as compact bytes for shuffled blocks."""

from __future__ import annotations

import numpy as np
import zstandard

_to = zstandard.ZstdCompressor(level=1)
_from = zstandard.ZstdDecompressor()


def pack(values: np.ndarray, kind: type) -> bytes:
    return _to.compress(np.ascontiguousarray(values, kind).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_from.decompress(data), kind)


def pack_steps(values: np.ndarray, kind: type = np.uint32) -> bytes:
    """Integers as differences of neighbours, which wrap around in the given kind."""
    return pack(np.diff(values.astype(kind), prepend=kind(0)), kind)


def unpack_steps(data: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)
