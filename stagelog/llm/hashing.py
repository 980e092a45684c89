"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_POWERS = {}
BLOCK = 1 << 16  # bytes hashed at once; a longer word is a block of its own


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(BLOCK, 1 << (n - 1).bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        held = np.cumprod(steps)
        if len(held) <= 1 << 21:
            _POWERS[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z folded), and how many words each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h, k = np.empty(len(begin), np.uint64), 0
    while k < len(begin):
        at = int(begin[k])
        stop = max(k + 1, int(np.searchsorted(end, at + BLOCK, side="right")))
        first, after = begin[k:stop] - at, end[k:stop] - at
        size = int(after[-1])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data[at:at + size]] * _powers(_BASE, size))])
        h[k:stop] = mix((sums[after] - sums[first]) * _powers(_INVERSE, size)[first])
        k = stop
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return h, np.diff(np.searchsorted(begin, bounds))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words; of all its words if there are fewer."""
    h, counts = word_hashes(texts)
    out, at = [], 0
    if len(h) >= width:
        runs = mix(sum((h[k:len(h) - width + 1 + k] * _PLACE[k] for k in range(width)), np.uint64(0)))
    for n in counts:
        if n >= width:
            out.append(np.unique(runs[at:at + n - width + 1]))
        elif n:
            out.append(mix(np.array([(h[at:at + n] * np.array(_PLACE[:n])).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def pieces(texts: list[bytes], limit: int = 1 << 20):
    """Index ranges of ``texts`` of about ``limit`` bytes each."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > limit:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
