"""Problem 4: pieces of bounded length, cut at natural boundaries, with a fixed overlap.

Dynamic programming over boundary positions: the cheapest chain of cuts from a text's start to its end,
where a cut costs its kind's penalty and a piece the square of its unused share. A piece runs from
`overlap` characters before the cut in front of it (or the text's start) to the next cut.

Natural boundaries come first; only a text that they can't cut is cut at weak ones as well (behind
clause marks, white space), and only if these don't do either at any position. As penalties grow far
faster than imbalance, a text gets no more cuts of a worse kind than it must.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 600
OVERLAP = 150
KINDS = ("paragraph", "sentence", "latin sentence", "clause", "space", "forced")
PENALTY = (0.0, 0.25, 0.5, 50.0, 100.0, 5000.0)
#: Natural boundaries lie behind a match, and so do weak ones.
NATURAL = ((0, re.compile(r"\n{2,}")), (1, re.compile(r"[。！？…]+[\n\r]*")), (2, re.compile(r"[.!?][ \t\n\r]+")))
WEAK = ((3, re.compile(r"[，、；：,;:]+")), (4, re.compile(r"\s+")))


def _boundaries(text: str, patterns: tuple) -> dict[int, int]:
    """Position -> best kind, for positions within the text."""
    found: dict[int, int] = {}
    for kind, pattern in patterns:
        for m in pattern.finditer(text):
            if m.end() < len(text):
                found[m.end()] = min(kind, found.get(m.end(), kind))
    return found


def _chain(n: int, cuts: dict[int, int], limit: int, overlap: int) -> list[int] | None:
    """The cheapest chain of cuts, or None where none keeps all pieces within the limit."""
    at = np.array([0, *sorted(cuts), n], np.int64)
    penalty = np.array([0.0, *(PENALTY[cuts[p]] for p in sorted(cuts)), 0.0])
    start = np.maximum(at - overlap, 0)
    first = np.searchsorted(start, at - limit, "left")  # the first position whose piece reaches so far at most
    best, back = np.full(at.size, np.inf), np.zeros(at.size, np.int64)
    best[0] = 0
    for j in range(1, at.size):
        i = first[j]
        if i >= j:
            continue
        cost = best[i:j] + ((limit - (at[j] - start[i:j])) / limit) ** 2
        k = int(np.argmin(cost))
        best[j], back[j] = cost[k] + penalty[j], i + k
    if not np.isfinite(best[-1]):
        return None
    chain, j = [], at.size - 1
    while back[j]:
        j = back[j]
        chain.append(int(at[j]))
    return chain[::-1]


def split_plan(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], list[int]]:
    """The pieces (start, end), and the kind of the cut behind each but the last."""
    n = len(text)
    if n <= limit:
        return [(0, n)], []
    cuts = _boundaries(text, NATURAL)
    chain = _chain(n, cuts, limit, overlap)
    if chain is None:
        cuts = _boundaries(text, WEAK) | cuts
        chain = _chain(n, cuts, limit, overlap)
    if chain is None:
        cuts = dict.fromkeys(range(1, n), len(KINDS) - 1) | cuts
        chain = _chain(n, cuts, limit, overlap)
    edges = [0, *chain, n]
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(edges, edges[1:])], [cuts[c] for c in chain]


def _split(limit: int, overlap: int):
    schema = pa.schema([("item_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("piece", pa.string()), ("cut", pa.string()), ("natural", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                pieces, kinds = split_plan(text, limit, overlap)
                natural = all(k < 3 for k in kinds)
                rows += [(key, n, a, text[a:b], KINDS[kinds[n]] if n < len(kinds) else "end", natural) for n, (a, b) in enumerate(pieces)]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item_id, text -> item_id, piece_no, start, piece, cut (kind of the boundary at its end), natural
    (whether all cuts of the item are at natural boundaries), for items longer than `limit` characters.

    Null texts and texts within the limit are not oversized and give no rows. Each row of `items` is
    split for itself; further columns are not carried along. The overlap must be less than the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    schema = "item_id bigint, piece_no int, start bigint, piece string, cut string, natural boolean"
    return items.select(F.col("item_id").cast("bigint"), "text").filter(F.length("text") > limit).mapInArrow(_split(limit, overlap), schema)
