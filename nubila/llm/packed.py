"""64-bit numbers as bytes for packed rows of a shuffle."""

from __future__ import annotations

import numpy as np

U = np.uint64


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers as bytes of one weight side by side, without the weights that are zero in all."""
    x = x.astype("<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and x:
        part = np.frombuffer(x, np.uint8).reshape(-1, n)
        out[:, : len(part)] = part.T
    return out.view("<u8").ravel()


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=U(0)))
