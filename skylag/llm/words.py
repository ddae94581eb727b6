"""Words of texts as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return of the
UTF-8 text, which is the same as ``[^\\x20\\x09-\\x0D]+`` on its characters. Texts are worked off in slices of about
``SLICE`` bytes that end between words, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
# Separators of loose words: every ASCII character but letters and digits.
_LOOSE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_random = np.random.Generator(np.random.PCG64(20240601))
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 65536)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64)
                      for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def _slice_words(data: np.ndarray, lower: bool, loose: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of one slice; ``loose`` words end at punctuation too."""
    solid = ~(_LOOSE if loose else _SPACE)[data]
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    powers, inverse = _power_tables(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((_FOLDED if lower else _BYTES)[data] * powers[:len(data)])])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _STEP), starts, ends


def _cuts(data: np.ndarray) -> list[int]:
    """Where to cut a long text: after a space near each multiple of SLICE."""
    cuts, at = [0], 0
    while len(data) - at > SLICE + 32768:
        end = at + SLICE
        spaces = np.flatnonzero(_SPACE[data[end:end + 32768]])
        while not len(spaces) and end < len(data):  # a word longer than the look-ahead
            end += 32768
            spaces = np.flatnonzero(_SPACE[data[end:end + 32768]])
        if not len(spaces):
            break
        at = end + int(spaces[0]) + 1
        cuts.append(at)
    return [*cuts, len(data)]


def text_words(data: np.ndarray, lower: bool = False, loose: bool = False) -> np.ndarray:
    """Hashes of the words of one text given as bytes."""
    cuts = _cuts(data)
    return np.concatenate([_slice_words(data[a:b], lower, loose)[0] for a, b in zip(cuts, cuts[1:])])


def text_bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text without copying; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    valid = np.asarray(texts.is_valid())
    for ok, a, b in zip(valid, offsets, offsets[1:]):
        yield data[a:b] if ok else data[:0]


def batch_words(texts: pa.Array, lower: bool = False, loose: bool = False) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Words of many texts at once: yields (first row, word offsets per row, hashes) for groups of about SLICE bytes."""
    group: list[np.ndarray] = []
    first = size = 0

    def flush():
        if len(group) == 1:
            hashes = text_words(group[0], lower, loose)
            return first, [0, len(hashes)], hashes
        sizes = np.array([len(g) + 1 for g in group])
        data = np.full(int(sizes.sum()), 32, np.uint8)
        places = np.concatenate([[0], np.cumsum(sizes)])
        for at, g in zip(places, group):
            data[at:at + len(g)] = g
        hashes, starts, _ = _slice_words(data, lower, loose)
        return first, np.searchsorted(starts, places).tolist(), hashes

    row = 0
    for data in text_bytes(texts):
        if group and size + len(data) > SLICE:
            yield flush()
            group, first, size = [], row, 0
        group.append(data)
        size += len(data) + 1
        row += 1
    if group:
        yield flush()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _STEP + hashes[j:j + n]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole sequence of words, of any length."""
    n = len(hashes)
    powers, _ = _power_tables(n)
    total = np.array([np.sum(hashes * powers[:n], dtype=np.uint64)]) + np.array([n], np.uint64) * _STEP
    return int(mix(total)[0])


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of one batch hold about ``limit`` bytes or one row."""
    for batch in batches:
        sizes = np.fromiter((len(x) for x in text_bytes(batch.column(column))), np.int64, batch.num_rows)
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
