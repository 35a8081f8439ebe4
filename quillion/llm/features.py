"""Hashed text features, computed over whole batches of texts with numpy.

Texts become arrays of code points; polynomial prefix sums modulo 2**64 give a
hash for every word at once, and weighted sums of neighbours one for every
character n-gram. Blocks hold at most ``BLOCK`` code points, so memory does not
grow with a text; longer texts are cut at white space and their parts added up
(a single word longer than a block counts as several).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"] = _powers(_P, BLOCK + 4)
        _TABLES["down"] = _powers(pow(_P, -1, 1 << 64), BLOCK + 4)
    return _TABLES["up"], _TABLES["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the high bits."""
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(32))) * _MIX
    return h ^ (h >> _U(32))


def blocks(texts: list[str | None], size: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts and the index of the text of each, by blocks of bounded size."""
    which, parts, held = [], [], 0
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while at < len(t):
            end = min(len(t), at + size)
            if end < len(t):
                end = max((t.rfind(c, at, end) for c in (" ", "\n", "\t")), default=-1) + 1 or end
                end = end if end > at else at + size
            if held + end - at > size and parts:
                yield which, parts
                which, parts, held = [], [], 0
            which.append(i)
            parts.append(t[at:end])
            held += end - at
            at = end
    if parts:
        yield which, parts


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the parts, each between single spaces, and where each begins."""
    text = " ".join(["", *parts, ""])
    starts = np.cumsum([1, *(len(p) + 1 for p in parts[:-1])])
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the first and last entry are False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def run_hashes(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of x[s:e] for each run; equal runs have equal hashes."""
    up, down = (t if len(t) >= len(x) else None for t in _tables())
    if up is None:
        up, down = _powers(_P, len(x)), _powers(pow(_P, -1, 1 << 64), len(x))
    h = np.zeros(len(x) + 1, _U)
    np.cumsum((x.astype(_U) + _U(1)) * up[: len(x)], out=h[1:])
    return mix((h[e] - h[s]) * down[s] + (e - s).astype(_U))
