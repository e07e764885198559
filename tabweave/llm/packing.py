"""Arrays of numbers as short byte strings: many of them travel in one row."""

from __future__ import annotations

import numpy as np

#: Bytes of a 64-bit hash that are kept as a key, and the mask of their bits.
BYTES = 6
KEY = np.uint64((1 << 8 * BYTES) - 1)


def pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def unpack_keys(packed: list[bytes]) -> np.ndarray:
    short = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :BYTES] = short
    return wide.view(np.uint64).ravel()


def pack_ids(ids: np.ndarray, which: np.ndarray | None = None) -> bytes:
    """The distinct ids (of those which are asked for), and of each the place there in as few bytes as will do."""
    if which is None:
        own, place = np.unique(ids, return_inverse=True)
    else:
        used = np.bincount(which, minlength=len(ids)) > 0
        own, place = ids[used], (np.cumsum(used) - 1)[which]
    return np.int64(len(own)).tobytes() + own.astype(np.int64).tobytes() + place.astype(_width(len(own))).tobytes()


def unpack_ids(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(packed, np.int64, n, 8)[np.frombuffer(packed, _width(n), offset=8 + 8 * n)]


def pack_small(values: np.ndarray) -> bytes:
    """Numbers below 2^32, in two bytes each if all are below 2^16."""
    wide = len(values) and int(values.max()) >= 1 << 16
    return (b"\1" if wide else b"\0") + values.astype(np.uint32 if wide else np.uint16).tobytes()


def unpack_small(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint32 if packed[:1] == b"\1" else np.uint16, offset=1).astype(np.uint32)


def _width(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def by_part(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each part that occurs, and the places that have it."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    own = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return [(int(own[a]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True)]
