"""Sets of word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_BLANK = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: An odd number, so that its powers can be divided out again modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Distinct shingles of each UTF-8 text, ascending; words end at white space, A-Z is lower-cased.

    A text of fewer words than ``width``, but not none, is one shingle.
    """
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < 1 << 20):
            size += len(texts[j] or b"") + 1
            j += 1
        out += _some(texts[i:j], width)
        i = j
    return out


def _some(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    data = b" ".join([(t or b"").translate(_BLANK) for t in texts])
    if not data.strip():
        return [np.zeros(0, np.uint64)] * len(texts)
    values = np.frombuffer(data, np.uint8)
    power, inverse = _powers_to(max(len(values), width) + 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (values != 32).view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    lengths = np.array([len(t or b"") for t in texts])
    bounds = np.searchsorted(starts, np.append(np.cumsum(lengths + 1) - lengths - 1, len(values) + 1)).tolist()
    places = max(0, len(hashes) - width + 1)  # none if the texts hold fewer words together
    total = np.zeros(places, np.uint64)
    for k in range(width):
        total += hashes[k : k + places] * power[k + 1]
    total = mix(total)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * power[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """A digest that equal sets share."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
