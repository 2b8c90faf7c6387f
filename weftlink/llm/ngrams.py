"""Words and word n-grams as 64-bit hashes, computed over a text's bytes at once."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xBF58476D1CE4E5B9
_STEP = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (the six characters of ``bytes.split``), as UTF-8; null has none."""
    return text.encode().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, for at least ``n`` places."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = out[0], out[1]
    return _powers[size]


def _hash_bytes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words in some bytes: differences of one running polynomial, shifted to a common place."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _tables(len(raw) + 1) if not _powers or len(raw) >= next(iter(_powers)) else next(iter(_powers.values()))
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * inverse[starts])


def text_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """The hash of each word of a text, A-Z lower-cased first if asked. Long texts go in pieces between words."""
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode()
    raw = np.frombuffer(data.lower() if lower else data, np.uint8)
    if len(raw) <= _STEP:
        return _hash_bytes(raw)
    space = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    cuts = np.unique(np.concatenate([[0], space[np.minimum(np.searchsorted(space, np.arange(_STEP, len(raw), _STEP)), len(space) - 1)] if len(space) else [], [len(raw)]]).astype(np.int64))
    return np.concatenate([_hash_bytes(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words (none if there are fewer)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= MULTIPLIER
        out += words[k : len(words) - n + 1 + k]
    return mix(out)
