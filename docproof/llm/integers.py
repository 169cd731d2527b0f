"""Vectors of whole numbers as compact numpy blocks."""

import numpy as np


def whole(lists, scale: float) -> np.ndarray:
    """floor(scale * x) of an Arrow list column of equally long vectors of finite numbers, as 64-bit integers."""
    from docproof.llm.vectors import matrix

    floors = np.floor(scale * matrix(lists))
    if np.abs(floors).max(initial=0) >= 2.0**63:
        raise ValueError("a scaled component is beyond 64 bits")
    return floors.astype(np.int64)


def narrow(values: np.ndarray) -> bytes:
    """Values in the smallest of 16, 32 and 64 bits that holds them all, after one byte that tells which."""
    reach = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    width = next(w for w in (2, 4, 8) if reach < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def widen(blob: bytes, rows: int) -> np.ndarray:
    """The 64-bit rows of ``narrow``."""
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).astype(np.int64).reshape(rows, -1)


def longs(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", np.int64)
