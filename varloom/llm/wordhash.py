"""Hashes of words and of runs of words with NumPy, for the operators in Python.

A word's hash is the sum, modulo 2**64, of a pseudo-random value for each of its bytes at its place (a hash by tabulation), mixed. The values
come from a table for the first PLACES bytes of a word and from the same rule, computed, beyond. No law ties the value of a byte at one place
to that at another, as powers of a base would: words such as those of Thue and Morse, which collide under any polynomial modulo 2**64, don't.
A word is a run of bytes other than space and U+0009 to U+000D, which no other character's UTF-8 bytes contain. Its hash is the same in every
process. Runs of words are hashed from their words' hashes, position by position.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
#: The white space of every contract here.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
_position = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Places of a word whose values are in the table.
PLACES = 64
#: Bytes of a text that are hashed at once; bytes of texts and rows that the operators work on at once.
PIECE = 1 << 20
BYTES, ROWS = 2 << 20, 512


def blocks(batch, text: int, size: int = BYTES, rows: int = ROWS):
    """A batch in slices of at most so many bytes of text and rows; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > at and (total + n > size or k - at == rows):
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and the first byte and the end of each word."""
    b = np.frombuffer(text, dtype=np.uint8)
    gap = np.concatenate([[True], SPACES[b], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return b, edge[::2], edge[1::2]


def _values(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A value for each byte at its place in a word."""
    return mixed(mixed(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ (byte.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_table = _values(np.tile(np.arange(256), PLACES), np.repeat(np.arange(PLACES), 256))
_table_lower = _table.reshape(PLACES, 256).copy()
_table_lower[:, 65:91] = _table_lower[:, 97:123]
_table_lower = _table_lower.ravel()


def _sums(b: np.ndarray, start: np.ndarray, end: np.ndarray, before: int, lower: bool) -> np.ndarray:
    """The sum of each word's values; before: the bytes of the first word that an earlier piece had."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    size = (end - start).astype(np.int32)
    first = np.cumsum(size, dtype=np.int32) - size
    byte = b[~SPACES[b]]
    place = np.arange(len(byte), dtype=np.int32) - np.repeat(first, size)
    if before:
        place[: size[0]] += before
    table = _table_lower if lower else _table
    if before + int(size.max()) <= PLACES:
        return np.add.reduceat(table[(place << 8) | byte], first)
    value = table[(np.minimum(place, PLACES - 1) << 8) | byte]
    far = np.flatnonzero(place >= PLACES)
    c = byte[far]
    value[far] = _values(np.where((c >= 65) & (c <= 90), c + 32, c) if lower else c, place[far])
    return np.add.reduceat(value, first)


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """uint64 of each word. lower: with A-Z lower-cased. Long texts are taken in pieces, so that memory beyond the result is bounded; a
    word that goes on from piece to piece is summed up."""
    out, open_sum, open_size = [], 0, 0
    for at in range(0, len(text), PIECE):
        b, start, end = bounds(text[at : at + PIECE])
        goes_on = open_size > 0 and len(start) > 0 and start[0] == 0
        if open_size and not goes_on:
            out.append(_closed(open_sum, open_size))
            open_sum = open_size = 0
        size = end - start
        h = _sums(b, start, end, open_size, lower)
        if goes_on:
            h[:1] += np.uint64(open_sum)
            size[0] += open_size
        if len(h) and end[-1] == len(b) and at + PIECE < len(text):
            open_sum, open_size = int(h[-1]), int(size[-1])
            h, size = h[:-1], size[:-1]
        else:
            open_sum = open_size = 0
        out.append(mixed(h + size.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _closed(total: int, size: int) -> np.ndarray:
    return mixed(np.array([(total + size) % 2**64], dtype=np.uint64))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """uint64 of each k consecutive words; if there are fewer, none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out += words[i : i + n] * _position[i % 64]
        if i % 64 == 63:
            out = mixed(out)
    return mixed(out)


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted set of hashes of the text's k-word shingles, A-Z lower-cased; with fewer words, of the whole sequence."""
    w = word_hashes(text, lower=True)
    return np.unique(runs(w, k if len(w) >= k else max(1, len(w)))) if len(w) else w
