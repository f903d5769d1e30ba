"""Texts as arrays of code points, for whole batches at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Stands between the texts of a batch; no text keeps it (it is no character).
BREAK = 0x10FFFF
SPACE = 32


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the basic plane: lower case (where that is one letter), white space, letters."""
    low = np.arange(1 << 16, dtype=np.uint32)
    space, letter = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        c = chr(i)
        space[i], letter[i] = c.isspace(), c.isalpha()
        if len(c.lower()) == 1:
            low[i] = ord(c.lower())
    return low, space, letter


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def batches_of(texts: list[str], most: int):
    """Slices of ``texts`` of at most ``most`` code points together, or of one text."""
    start = 0
    while start < len(texts):
        stop, n = start, 0
        while stop < len(texts) and (stop == start or n + len(texts[stop]) <= most):
            n += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop
