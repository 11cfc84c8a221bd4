"""Simple-8b word-aligned coding: a 4-bit selector and up to 60 ids in the 60 other bits of each 64-bit word.

Words of a document start afresh, so a document is decoded from its word offset alone. Values of more than 60 bits go to an
escape table of the block, and the word holds their place in it; every word therefore stands for itself and decoding works
on all words of a block at once.

A block is: magic, four unsigned 64-bit counts (documents, ids, words, escapes), then as little-endian arrays the document
ids (int64), their validity (uint8), ids per document (uint32), first word per document (uint32), escapes and words (uint64).
"""

from __future__ import annotations

import numpy as np

# Ids per word by selector; each has 60 // count bits. Selector 15 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
MAGIC = b"S8B1"
FOUR, SIXTY = np.uint64(4), np.uint64(60)


# The most ids of each number of bits that share a word.
BY_BITS = np.array([next((c for c in COUNTS if 60 // c >= max(1, bits)), 0) for bits in range(65)], np.uint8)
BY_VALUE = BY_BITS[np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(int)]


def _fitting(ids: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The most ids from each place on that fit one word and belong to one document; 0 for a value that needs an escape.

    A stretch fits if every id in it may share a word with so many; the least such number slides over the ids.
    """
    least = BY_VALUE[np.minimum(ids, np.uint64(0xFFFF)).astype(np.int64)]
    large = np.flatnonzero(ids > np.uint64(0xFFFF))
    if len(large):
        powers = np.array([(1 << bits) - 1 for bits in range(65)], np.uint64)
        least[large] = BY_BITS[np.searchsorted(powers, ids[large])]
    fits, width = np.minimum(least, 1), 1
    for count in COUNTS[-2::-1]:
        if len(ids) < count:
            break
        wider = least.copy()
        wider[: len(ids) - (count - width)] = np.minimum(least[: len(ids) - (count - width)], least[count - width :])
        least, width = wider, count
        good = (least >= count) & (room >= count)
        if not good.any():
            break
        fits[good] = count
    return fits


def encode(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each document, and escapes of the concatenated ``ids`` of documents with ``lengths``."""
    ids = np.ascontiguousarray(ids, np.uint64)
    ends = np.cumsum(lengths, dtype=np.int64)
    room = np.minimum(np.repeat(ends, lengths) - np.arange(len(ids)), 60).astype(np.uint8)
    steps = _fitting(ids, room).tobytes()
    begins, at, last = bytearray(len(ids)), 0, len(ids)
    while at < last:
        begins[at] = 1
        at += steps[at] or 1
    starts = np.flatnonzero(np.frombuffer(begins, np.uint8))
    taken = np.frombuffer(steps, np.uint8)[starts]
    words = np.zeros(len(starts), np.uint64)
    for selector, count in enumerate(COUNTS):
        own = np.flatnonzero(taken == count)
        if len(own):
            packed = np.full(len(own), selector << 60, np.uint64)
            for j in range(count):
                packed |= ids[starts[own] + j] << np.uint64(j * (60 // count))
            words[own] = packed
    large = np.flatnonzero(taken == 0)
    words[large] = np.uint64(ESCAPE << 60) | np.arange(len(large), dtype=np.uint64)
    first = np.searchsorted(starts, ends - lengths).astype(np.uint32)
    return words, first, ids[starts[large]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of ``words``, in order."""
    selectors = (words >> SIXTY).astype(np.int64)
    counts = np.array([*COUNTS, 1, 1], np.int64)[selectors]
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for selector in np.unique(selectors).tolist():
        own = np.flatnonzero(selectors == selector)
        packed = words[own]
        if selector == ESCAPE:
            ids[starts[own]] = escapes[(packed & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        bits = 60 // COUNTS[selector]
        mask = np.uint64((1 << bits) - 1)
        for j in range(COUNTS[selector]):
            ids[starts[own] + j] = (packed >> np.uint64(j * bits)) & mask
    return ids


def pack_block(doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    words, first, escapes = encode(ids, lengths)
    counts = np.array([len(doc_ids), len(ids), len(words), len(escapes)], "<u8")
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [counts, names, valid, np.asarray(lengths, "<u4"), first.astype("<u4"), escapes.astype("<u8"), words.astype("<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def unpack_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, all ids, and ids per document of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of packed ids")
    documents, _, n_words, n_escapes = np.frombuffer(payload, "<u8", 4, 4).tolist()
    at = 36

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(payload, kind, count, at)
        at += found.nbytes
        return found

    names, valid, lengths = take("<i8", documents), take("<u1", documents), take("<u4", documents)
    take("<u4", documents)
    escapes, words = take("<u8", n_escapes), take("<u8", n_words)
    return [n if v else None for n, v in zip(names.tolist(), valid.tolist())], decode(words, escapes), lengths


def unpack_document(payload: bytes, place: int) -> np.ndarray:
    """Ids of one document of a block, read from its own words only."""
    documents, _, n_words, n_escapes = np.frombuffer(payload, "<u8", 4, 4).tolist()
    head = 36 + 9 * documents
    first = np.frombuffer(payload, "<u4", documents, head + 4 * documents)
    last = int(first[place + 1]) if place + 1 < documents else n_words
    tail = head + 8 * documents
    escapes = np.frombuffer(payload, "<u8", n_escapes, tail)
    words = np.frombuffer(payload, "<u8", n_words, tail + 8 * n_escapes)
    return decode(words[int(first[place]) : last], escapes)
