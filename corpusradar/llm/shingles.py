"""Sets of word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from corpusradar.llm.common import fold_bytes, mixed, span_hashes, words

_STEP = np.uint64(0xD6E8FEB86659FD93)


def _chained(columns: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = columns[0]
        for column in columns[1:]:
            value = mixed(value * _STEP) + column
        return mixed(value + np.uint64(len(columns)))


def shingle_sets(octets: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles after lower-casing A-Z; a row of fewer words has its
    whole sequence as one shingle, a row without words none."""
    octets = fold_bytes(octets)
    starts, ends, rows = words(octets, bounds)
    hashes = span_hashes(octets, starts, ends)
    n_rows = len(bounds) - 1
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    if len(hashes) >= size:
        many = _chained([hashes[j:len(hashes) - size + 1 + j] for j in range(size)])
    sets = []
    for row in range(n_rows):
        a, b = int(first[row]), int(first[row + 1])
        if b - a >= size:
            sets.append(np.unique(many[a:b - size + 1]))
        elif b > a:
            sets.append(_chained([hashes[i:i + 1] for i in range(a, b)]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
