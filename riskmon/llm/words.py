"""Vectorised hashes of words and of windows of words, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

CHUNK = 1 << 20
# Longer words, in bytes, are hashed by a digest.
SHORT = 64
# Keeps the first k bytes of eight.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240607)
BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
PLACE_CODE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _hash_chunk(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a text that is split at blanks.

    Eight bytes at a time pass through a bijection, so words of eight bytes or fewer
    and of one length never share a hash; long words take a digest.
    """
    data = np.frombuffer(blob, np.uint8)
    inside = np.concatenate(([False], ~BLANK[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    size = last - first
    out = mix(size.astype(np.uint64) + np.uint64(BASE))
    eights = np.ndarray(len(data) + 1, "<u8", blob + bytes(8), strides=(1,))
    at = np.flatnonzero(size <= SHORT)
    for k in range(0, SHORT, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        out[at] = mix(out[at] ^ (eights[first[at] + k] & HEAD[np.minimum(size[at] - k, 8)]))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(blake2b(blob[first[i] : last[i]], digest_size=8).digest(), "little")
    return out, first


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the bounds of each text's words."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    pending: list[int] = []
    size = 0

    def flush() -> None:
        if pending:
            got, first = _hash_chunk(b"\n".join(texts[i] for i in pending))
            starts = np.cumsum([0] + [len(texts[i]) + 1 for i in pending])
            counts[pending] = np.diff(np.searchsorted(first, starts))
            hashes.append(got)
            pending.clear()

    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            flush()
            size = 0
            for part in parts(text):
                got, _ = _hash_chunk(part)
                hashes.append(got)
                counts[i] += len(got)
            continue
        if size + len(text) > CHUNK:
            flush()
            size = 0
        pending.append(i)
        size += len(text) + 1
    flush()
    bounds = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), bounds


def parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes that end between words."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and not BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def hash_windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of `length` words; the caller drops those that cross texts."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out += words[k : k + n] * PLACE_CODE[k]
    return mix(out)
