"""Runs of characters (grams) of lines, as numbers, for whole Arrow columns.

A gram of up to three characters is one 64-bit number that holds its code
points, so different grams are different numbers and nothing is hashed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SIZE = 3
#: characters read at a time
SLICE = 1 << 20
#: no cased letter stands beyond
CASED = 0x1E944


@cache
def _folds() -> np.ndarray:
    """The one character that stands for all those a search without regard to
    case takes for the same: lower case of the upper case, one by one."""
    out = np.arange(CASED, dtype=np.uint32)
    for code in range(CASED):
        one = chr(code)
        upper = one.upper()
        lower = (upper if len(upper) == 1 else one).lower()
        if lower[0] != one:
            out[code] = ord(lower[0])
    return out


def folded(points: np.ndarray) -> np.ndarray:
    """Code points without case."""
    return np.where(points < CASED, _folds()[np.minimum(points, CASED - 1)], points)


def of_text(text: str, size: int = SIZE) -> list[int]:
    """The grams of one text in order; shorter texts have none."""
    points = [ord(c) + 1 for c in text]
    return [sum(p << (21 * (SIZE - 1 - k)) for k, p in enumerate(points[i : i + size])) for i in range(len(points) - size + 1)]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (none null), and the number of each text's."""
    wide = pa.types.is_large_string(texts.type)
    places = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or places[-1] == places[0]:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    data = memoryview(texts.buffers()[2])[places[0] : places[-1]]
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32), np.diff(starts[places - places[0]])


def of_lines(texts: pa.Array, sizes: tuple[int, ...] = (SIZE,), fold: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, numbers of their texts), in the order of the texts, a slice of
    about SLICE characters at a time; repeats are included."""
    lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        points, n = code_points(texts.slice(at, to - at))
        points = (folded(points) if fold else points).astype(np.int64) + 1
        owner = np.repeat(np.arange(at, to), n)
        for size in sizes:
            if len(points) < size:
                continue
            grams = np.zeros(len(points) - size + 1, np.int64)
            for k in range(size):
                grams |= points[k : len(points) - size + 1 + k] << (21 * (SIZE - 1 - k))
            within = owner[: len(grams)] == owner[size - 1 :]
            yield grams[within], owner[: len(grams)][within]
        at = to
