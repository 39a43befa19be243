"""Hashed n-gram features of whole texts, computed on arrays of code points.

Every feature is a number below ``2 ** bits``; streams (characters of each order, words, word shapes) are told apart by
a salt in the hash.  Long texts are taken in overlapping chunks, so memory is bounded and no gram is lost; a chunk of
words ends with a word, and the next one begins two words before that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np

from tessera.llm.minhash import mix64

CHUNK = 500_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class SparseRows:
    """Rows of slots, and of values if there are any, in a few long arrays; a row is a view of them."""

    def __init__(self, rows: Iterable[tuple[np.ndarray, np.ndarray | None]]):
        parts: list[tuple] = []
        for some in batched(rows, 256):
            slots = np.concatenate([s for s, _ in some]).astype(np.int32)
            values = None if some[0][1] is None or len(some[0][1]) != len(some[0][0]) else np.concatenate([v for _, v in some]).astype(np.float32)
            parts.append((slots, values, [len(s) for s, _ in some]))
        self.at = np.concatenate([[0], np.cumsum([n for *_, sizes in parts for n in sizes])]).astype(np.int64)
        self.slots = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        self.values = np.concatenate([p[1] for p in parts]) if parts and parts[0][1] is not None else None

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray | None]:
        where = slice(self.at[i], self.at[i + 1])
        return self.slots[where], None if self.values is None else self.values[where]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def chunks(points: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    if len(points) <= CHUNK:
        yield points
        return
    for at in range(0, len(points), CHUNK):
        yield points[at : at + CHUNK + overlap]


def word_chunks(points: np.ndarray, overlap: int = 2) -> Iterator[np.ndarray]:
    """Chunks that end with a word, each but the first beginning ``overlap`` words before the end of the last."""
    if len(points) <= CHUNK:
        yield points
        return
    white = np.flatnonzero(is_white(points))
    at = 0
    while at < len(points):
        place = int(np.searchsorted(white, at + CHUNK))
        if place == len(white):
            yield points[at:]
            return
        end = int(white[place])
        yield points[at:end]
        # back over ``overlap`` words: a word starts after a white point that none follows at once
        starts = white[max(0, place - 64 * overlap) : place]
        starts = starts[~is_white(points[starts + 1])] + 1
        back = int(starts[-overlap]) if len(starts) >= overlap else end
        at = back if back > at else end


def _slot(values: np.ndarray, salt: int, bits: int) -> np.ndarray:
    salted = (values + np.uint64(salt)) * _PRIME
    return ((salted ^ (salted >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def character_grams(points: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Slots of all runs of 1 to 3 code points."""
    found = []
    for n in orders:
        if len(points) < n:
            continue
        value = points[: len(points) - n + 1].copy()
        for k in range(1, n):
            value = (value << np.uint64(21)) ^ points[k : len(points) - n + 1 + k]
        found.append(_slot(value, n, bits))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def is_white(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def word_grams(points: np.ndarray, bits: int) -> np.ndarray:
    """Slots of words, of word shapes one by one and in twos, and of repeats of the word before.

    A shape says whether a word has small and capital ASCII letters, other letters, digits, and marks, and its length.
    """
    white = is_white(points)
    edge = np.diff(np.concatenate(([1], white.astype(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.int64)
    kinds = np.select(
        [(points >= 97) & (points <= 122), (points >= 65) & (points <= 90), (points >= 48) & (points <= 57), points > 127, white],
        [np.uint64(1), np.uint64(2), np.uint64(4), np.uint64(8), np.uint64(0)],
        np.uint64(16),
    )
    shape = np.bitwise_or.reduceat(kinds, starts) + (np.minimum(np.log2(ends - starts).astype(np.uint64), np.uint64(5)) << np.uint64(5))
    mixed = mix64(points * _PRIME + _offsets(starts, len(points)))
    mixed[white] = 0
    word = np.add.reduceat(mixed, starts)
    same = np.concatenate(([False], word[1:] == word[:-1])).astype(np.uint64)
    twice = np.concatenate(([0], same[1:] & same[:-1])).astype(np.uint64)
    pair = (shape[:-1] << np.uint64(20)) ^ shape[1:]
    return np.concatenate([_slot(word, 11, bits), _slot(shape, 12, bits), _slot(pair, 13, bits), _slot(same + twice, 14, bits)])


def _offsets(starts: np.ndarray, n: int) -> np.ndarray:
    """For each position, how far it is from the last start; before the first, from 0."""
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    return (np.arange(n) - np.maximum.accumulate(begin)).astype(np.uint64)


def counted(text: str | None, orders: tuple[int, ...], bits: int, *, fold: bool = True) -> np.ndarray:
    """How often each slot of character grams occurs, white space taken as one space; ``fold`` puts it in small letters."""
    points = code_points(text.lower() if text and fold else text)
    points = np.where(is_white(points), np.uint64(32), points)
    total = np.zeros(1 << bits, np.int64)
    for part in chunks(points, max(orders) - 1):
        total += np.bincount(character_grams(part, orders, bits), minlength=1 << bits)
    return total


def present(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Sorted slots of character grams, words and shapes that occur at all, capital letters kept."""
    seen = np.zeros(1 << bits, bool)
    for part in chunks(code_points(text), max(orders) - 1):
        seen[character_grams(part, orders, bits)] = True
    for part in word_chunks(code_points(text)):
        seen[word_grams(part, bits)] = True
    return np.flatnonzero(seen)
