"""Word shingles of whole texts as 64-bit hashes, for many texts at once, inside tasks.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A set holds the distinct shingles of k
words; a text with fewer words has one, its whole sequence; a text without words has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
BYTES_AT_ONCE = 1 << 19
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _BACK)):
            _POWERS[i] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n + BYTES_AT_ONCE, b, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes."""
    raw = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = edge[::2], edge[1::2]
    powers, backs = _powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * powers[: len(raw)])])
    return starts, mixed((sums[stops] - sums[starts]) * backs[starts] + (stops - starts).astype(np.uint64))


_BETWEEN = re.compile(rb"[\x20\x09-\x0d]")


def _stretches(text: bytes) -> Iterator[bytes]:
    """A text cut at spaces into stretches of about BYTES_AT_ONCE, so that long texts take no more memory at once."""
    at = 0
    while at < len(text):
        space = _BETWEEN.search(text, at + BYTES_AT_ONCE)
        stop = space.start() if space else len(text)
        yield text[at:stop]
        at = stop


def _cut(texts: list[bytes], k: int) -> list[np.ndarray]:
    if len(texts) == 1 and len(texts[0]) > BYTES_AT_ONCE:
        words = np.concatenate([_words(x)[1] for x in _stretches(texts[0])])
        of = np.array([0, len(words)])
    else:
        starts, words = _words(b"\n".join(texts))
        of = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in texts)]))
    joint = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        joint = mixed(joint + words[i : i + len(joint)] + np.uint64(i + 1))
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joint[a : b - k + 1]))
        elif b > a:
            own = np.zeros(1, np.uint64)
            for i, w in enumerate(words[a:b]):
                own = mixed(own + w + np.uint64(i + 1))
            out.append(mixed(own + np.uint64(b - a) * np.uint64(0xD6E8FEB86659FD93)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each whole text."""
    out, held, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BYTES_AT_ONCE:
            out += _cut(held, k)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    return out + (_cut(held, k) if held else [])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, max(len(b) - 1, 0))] == a).sum()) if len(b) else 0
