"""64-bit hashes of words and word n-grams, computed for all words of a text at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
# Bytes of a text that are hashed at once; the tables of powers have one entry more.
BLOCK = 1 << 18
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each value (a bijection)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words, maximal runs without ASCII white space, in text order.

    The text is hashed in blocks of ``BLOCK`` bytes; a word that goes on in the next block is carried over as its sum so
    far and its length. Beside the result, memory is that of one block, however long text or word.
    """
    found = [np.zeros(0, np.uint64)]
    carried, length = 0, 0
    for offset in range(0, len(text), BLOCK):
        data = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - offset), offset)
        starts, ends, sums = _runs(data)
        lengths = (ends - starts).astype(np.uint64)
        if length and len(starts) and not starts[0]:
            sums[0] = (carried + int(sums[0]) * pow(_BASE, length, 2**64)) % 2**64
            lengths[0] += np.uint64(length)
        elif length:
            sums, lengths = np.append(np.uint64(carried), sums), np.append(np.uint64(length), lengths)
        carried, length = 0, 0
        if len(ends) and ends[-1] == len(data) and offset + BLOCK < len(text):
            carried, length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        found.append(mixed(sums ^ lengths))
    return found[1] if len(found) == 2 else np.concatenate(found)


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, and their polynomial sums."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACES[data]
    edges = np.diff(solid)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * inverses[starts]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words, in order."""
    size = len(words) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    total = np.full(size, np.uint64(n))
    for i in range(n):
        total = mixed(total ^ words[i : i + size])
    return total


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``n`` words; with fewer words the whole sequence is one."""
    return set_of(word_hashes(text), n)


def set_of(words: np.ndarray, n: int) -> np.ndarray:
    """``shingle_set`` from word hashes."""
    grams = gram_hashes(words, n if len(words) >= n else len(words)) if len(words) else words
    grams = np.sort(grams)
    keep = np.ones(len(grams), bool)
    keep[1:] = grams[1:] != grams[:-1]
    return grams[keep]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < size:
        grown = max(1 << 14, 1 << (size - 2).bit_length()) + 1
        tables = []
        for factor in (_BASE, _INVERSE):
            table = np.ones(1, np.uint64)
            while len(table) < grown:
                table = np.concatenate((table, table * np.uint64(pow(factor, len(table), 2**64))))
            tables.append(table[:grown].copy())
        _powers = tuple(tables)
    return _powers
