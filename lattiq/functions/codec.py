"""Residual codec: bucket codes, bit packing and their inverse, on NumPy arrays and as SQL expressions.

Fixed layout: the b bits of a code are written least significant first, and the stream of bits is packed into
bytes most significant first.
"""

from __future__ import annotations

import numpy as np

NBITS = (2, 4)


def check_layout(dim: int, nbits: int) -> None:
    if nbits not in NBITS:
        raise ValueError(f"nbits must be one of {NBITS}, not {nbits}")
    if dim <= 0 or dim % 8:
        raise ValueError(f"the dimension must be a multiple of 8, not {dim}")


def bucketize(values: np.ndarray, cutoffs: np.ndarray) -> np.ndarray:
    """Number of cutoffs strictly below each value."""
    return np.searchsorted(cutoffs, values, side="left").astype(np.uint8)


def pack(codes: np.ndarray, nbits: int) -> np.ndarray:
    """``[n, dim]`` codes to ``[n, dim * nbits / 8]`` bytes."""
    bits = (codes[..., None] >> np.arange(nbits, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(codes), -1), axis=1)


def unpack(packed: np.ndarray, nbits: int) -> np.ndarray:
    """Inverse of ``pack``, by one table lookup per byte."""
    return _byte_codes(nbits)[packed].reshape(len(packed), -1)


def _byte_codes(nbits: int) -> np.ndarray:
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8 // nbits, nbits)
    return (bits << np.arange(nbits, dtype=np.uint8)).sum(2).astype(np.uint8)


def byte_lookup(weights: np.ndarray, nbits: int) -> np.ndarray:
    """``[256, 8 / nbits]``: the bucket weights that a packed byte stands for."""
    return weights[_byte_codes(nbits)]


def sql_bucketize(vec: str, cutoffs: str) -> str:
    return f"transform({vec}, x -> size(filter({cutoffs}, c -> c < x)))"


def sql_reversed(code: str, nbits: int) -> str:
    """SQL: the bits of a code in reverse order."""
    return " + ".join(f"((({code}) div {1 << k}) % 2) * {1 << (nbits - 1 - k)}" for k in range(nbits))


def sql_pack(codes: str, nbits: int) -> str:
    """SQL: array of bytes (as integers) packed from an array of codes."""
    per = 8 // nbits
    parts = " + ".join(f"({sql_reversed(f'get({codes}, i * {per} + {k})', nbits)}) * {1 << (nbits * (per - 1 - k))}" for k in range(per))
    return f"transform(sequence(0, size({codes}) div {per} - 1), i -> cast({parts} as int))"


def sql_unpack(packed: str, nbits: int) -> str:
    """SQL: array of codes from an array of bytes (as integers)."""
    per = 8 // nbits
    one = f"(get({packed}, i div {per}) div cast(pow({1 << nbits}, {per - 1} - i % {per}) as int)) % {1 << nbits}"
    return f"transform(sequence(0, size({packed}) * {per} - 1), i -> cast({sql_reversed(one, nbits)} as int))"
