"""Texts as arrays of code points, so that whole Arrow batches are treated at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points treated at once; a batch with more is cut between texts, a longer text into overlapping pieces.
SLICE = 1 << 21


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the length of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, lengths


def slices(texts: list[str | None], overlap: int, size: int = SLICE) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(text numbers, offsets, texts) with at most about `size` code points each. A text longer than
    that comes as pieces that overlap by `overlap`; null texts are left out."""
    numbers: list[int] = []
    offsets: list[int] = []
    pieces: list[str] = []
    held = 0
    for number, text in enumerate(texts):
        if text is None:
            continue
        for at in range(0, max(1, len(text) - overlap), size):
            piece = text[at : at + size + overlap]
            if held and held + len(piece) > size + overlap:
                yield numbers, offsets, pieces
                numbers, offsets, pieces, held = [], [], [], 0
            numbers.append(number)
            offsets.append(at)
            pieces.append(piece)
            held += len(piece)
    if pieces:
        yield numbers, offsets, pieces


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step, for arrays of uint64 (which wrap around)."""
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    return x ^ (x >> _SHIFT)


def gram_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` code points from each position (shorter array by length - 1).

    Hashes of spans are joined by doubling, so the work grows with log(length)."""
    if codes.size < length:
        return np.empty(0, np.uint64)
    span = mix(codes.astype(np.uint64) + np.uint64(0x51ED27))
    width, done, out = 1, 0, None
    left = length
    while left:
        if left & 1:
            n = codes.size - done - width + 1
            part = span[done : done + n]
            out = part.copy() if out is None else mix(out[:n] * np.uint64(3) + part)
            done += width
        left >>= 1
        if left:
            span = mix(span[:-width] * np.uint64(5) + span[width:])
            width *= 2
    return out


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbouring values (shorter array by width - 1)."""
    if values.size < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: values.size - rest], values[rest:]) if rest else values


def whole(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """(text numbers, texts) with about `size` code points each; no text is cut, null texts are left out."""
    numbers: list[int] = []
    held = 0
    for number, text in enumerate(texts):
        if text is None:
            continue
        if numbers and held + len(text) > size:
            yield numbers, [texts[n] for n in numbers]
            numbers, held = [], 0
        numbers.append(number)
        held += len(text)
    if numbers:
        yield numbers, [texts[n] for n in numbers]
