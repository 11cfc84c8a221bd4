"""Words and word-window hashes shared by the text operators.

Texts are handled as UTF-8 bytes: bytes of A-Z are lower-cased and every byte from 0x80 on belongs to a word, which is the
same as working on code points.
"""

from __future__ import annotations

import numpy as np
import xxhash

# Bytes of a text to those of its normalised form: A-Z to a-z, digits and all from 0x80 on kept, the rest to blanks.
ALPHANUMERIC = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
PRIME = np.uint64(0x9E3779B185EBCA87)
SHIFT = np.uint64(29)


def blank_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words between blanks (0x20, 0x09-0x0D), A-Z lower-cased; none for null."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def alphanumeric_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and code points from 0x80 on, A-Z lower-cased; none for null."""
    return (text or "").encode().translate(ALPHANUMERIC).split()


def alphanumeric_bytes(text: str | None) -> bytes:
    return (text or "").encode().translate(ALPHANUMERIC)


def blank_bytes(text: str | None) -> bytes:
    return (text or "").encode().lower()


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)
STEP = 0x9E3779B97F4A7C13
FINAL = np.uint64(0xD6E8FEB86659FD93)
PART = 1 << 18


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PART, base, np.uint64)]), dtype=np.uint64)


POWERS, INVERSE = _powers(STEP), _powers(pow(STEP, -1, 1 << 64))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word between blanks of ``data``."""
    edges = np.diff(np.concatenate([[True], BLANK[np.frombuffer(data, np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(data: bytes, places: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of every word of ``data``: a polynomial in its bytes, read off running sums over the whole text, mixed.

    The sums run over parts of the text, so powers are needed up to the length of a part only.
    """
    own = np.frombuffer(data, np.uint8)
    starts, ends = word_places(data) if places is None else places
    found = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(starts):
            first = int(starts[at])
            last = max(at + 1, int(np.searchsorted(ends, first + PART, "right")))
            part = own[first : int(ends[last - 1])]
            if len(part) > PART:  # one word longer than a part
                found[at] = xxhash.xxh3_64_intdigest(part.tobytes())
            else:
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(BYTES[part] * POWERS[: len(part)], out=sums[1:])
                low, high = starts[at:last] - first, ends[at:last] - first
                found[at:last] = (sums[high] - sums[low]) * INVERSE[low]
            at = last
        found ^= found >> np.uint64(32)
        found *= FINAL
        found ^= found >> SHIFT
    return found


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of ``length`` words; different lengths give unrelated hashes."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    found = np.full(count, length, np.uint64)
    for i in range(length):
        found ^= hashes[i : i + count]
        found *= PRIME
        found ^= found >> SHIFT
    return found
