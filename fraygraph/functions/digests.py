"""md5 uniforms of whole series of keys: the numbers that ``ranking.unit_uniform`` makes of ``ranking.random_key``, by blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

# Last digits that vary over a fixed start, keys hashed as one block, and the number of keys below which a block is not worth its steps.
BLOCK_DIGITS, LANES, FEW = 5, 50_000, 400
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _compressed(state: tuple, words: list, lanes: int) -> tuple:
    """One step of md5 (RFC 1321) over 16 words, each a number or an array of ``lanes``; the state is in arrays of 1 or ``lanes``."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        plain = not isinstance(word, np.ndarray)
        if not plain and a.size < lanes:  # from here on the keys differ
            a, b, c, d = (np.broadcast_to(x, lanes).copy() for x in (a, b, c, d))
            f, t = np.empty_like(a), np.empty_like(a)
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        a += f
        a += np.array((int(abs(math.sin(i + 1)) * 2**32) + (word if plain else 0)) % 2**32, dtype=np.uint32)
        if not plain:
            a += word
        shift = SHIFTS[turn][i % 4]
        np.left_shift(a, np.array(shift, dtype=np.uint32), out=t)
        np.right_shift(a, np.array(32 - shift, dtype=np.uint32), out=a)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return tuple(x + y for x, y in zip(state, (a, b, c, d)))


def _last_digits(digits: int, at: int) -> list[np.ndarray]:
    """The numbers of so many digits, zeros in front, as bytes from place ``at`` of a little-endian word on; one array per word."""
    numbers = np.arange(10**digits, dtype=np.uint32)
    words = [np.zeros(10**digits, np.uint32) for _ in range((at + digits + 3) // 4)]
    for j in range(digits):
        byte = numbers // np.uint32(10 ** (digits - 1 - j)) % np.uint32(10) + np.uint32(48)
        words[(at + j) // 4] |= byte << np.uint32(8 * ((at + j) % 4))
    return words


def _hashed(parts: list[tuple[bytes, int, int]], digits: int, tables: dict) -> np.ndarray:
    """Uniforms of all parts (start, first, last): a start and the numbers first .. last - 1 written with ``digits`` digits. Starts are equally long."""
    counts = [last - first for _, first, last in parts]
    lanes = sum(counts)
    if lanes < FEW:
        heads = [hashlib.md5(start + b"%0*d" % (digits, i)).digest()[:7] for start, first, last in parts for i in range(first, last)]
        return np.array([int.from_bytes(h, "big") >> 4 for h in heads], dtype=np.float64) / 2.0**52
    begin = len(parts[0][0])
    size, at = begin + digits, begin % 4
    end = bytes(digits) + b"\x80" + bytes(-(size + 9) % 64) + (8 * size).to_bytes(8, "little")
    starts = np.frombuffer(b"".join(start + end for start, _, _ in parts), "<u4").reshape(len(parts), -1)
    words = [int(x[0]) if (x == x[0]).all() else np.repeat(x, counts) for x in starts.T]
    if (digits, at) not in tables:
        tables[digits, at] = _last_digits(digits, at)
    for j, table in enumerate(tables[digits, at], begin // 4):
        words[j] = np.concatenate([table[first:last] for _, first, last in parts]) + np.asarray(words[j], dtype=np.uint32)
    state = tuple(np.array([x], dtype=np.uint32) for x in BEGIN)
    for j in range(0, len(words), 16):
        state = _compressed(state, words[j : j + 16], lanes)
    high, low = (x.byteswap().astype(np.uint64) for x in state[:2])
    return ((high << np.uint64(20)) | (low >> np.uint64(12))).astype(np.float64) / 2.0**52


def uniforms(series: list[tuple[bytes, int]]) -> Iterator[np.ndarray]:
    """Uniforms in [0, 1) from the first 13 hex digits of md5(start + i), i = 0 .. n - 1 in decimal digits, for every (start, n), by blocks.

    What has equally many digits is hashed together. The order follows from the lengths of the starts and the numbers n alone.
    """
    tables: dict = {}
    waiting: dict = {}
    for start, n in series:
        parts = [(start, digits, 10 ** (digits - 1) if digits > 1 else 0, min(n, 10**digits)) for digits in range(1, BLOCK_DIGITS + 1)]
        parts += [(start + b"%d" % k, BLOCK_DIGITS, 0, min(n - k * 10**BLOCK_DIGITS, 10**BLOCK_DIGITS)) for k in range(1, -(-n // 10**BLOCK_DIGITS))]
        for begin, digits, first, last in parts:
            for at in range(first, last, LANES):
                alike = waiting.setdefault((len(begin), digits), [])
                alike.append((begin, at, min(at + LANES, last)))
                if sum(b - a for _, a, b in alike) >= LANES:
                    yield _hashed(waiting.pop((len(begin), digits)), digits, tables)
    for (_, digits), alike in waiting.items():
        yield _hashed(alike, digits, tables)
