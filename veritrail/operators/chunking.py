"""Overlapping windows with boundary-aware ends, for retrieval."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP = 600, 150
# Kinds of boundary, best first.
BOUNDARIES = (r"\n\n+", r"[。！？…]+[\n\r]*", r"[.!?][ \t\n\r]+")


def windows(text: str, target: int = TARGET, overlap: int = OVERLAP, crawl: bool = False) -> list[tuple[int, str]]:
    """(offset, text) of the windows. Each ends at the last boundary of the best kind within the target, or
    at the next one beyond; it begins `overlap` before the end of the one in front of it.

    Where that would hardly move (a window no longer than the overlap), the next begins at that end;
    with `crawl` it begins one character on, as by the original rule."""
    n = len(text)
    kind = {n: 0} if n else {}
    for rank, pattern in enumerate(BOUNDARIES):
        for m in re.finditer(pattern, text):
            kind.setdefault(m.end(), rank)
    ends = sorted(kind)
    out, start = [], 0
    while start < n:
        low, high = bisect_right(ends, start), bisect_right(ends, start + target)
        end = max(ends[low:high], key=lambda e: (-kind[e], e), default=None)
        end = ends[low] if end is None else end
        if text[start:end].strip():
            out.append((start, text[start:end]))
        if end >= n:
            break
        start = end - overlap if end - overlap > start else start + 1 if crawl else end
    return out


def _cut(target: int, overlap: int, crawl: bool):
    schema = pa.schema([("text_id", pa.int64()), ("chunk_no", pa.int32()), ("offset", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, at, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for k, (at, w) in enumerate(windows(t, target, overlap, crawl))]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def chunk_texts(texts: DataFrame, text_id: str, target: int = TARGET, overlap: int = OVERLAP, crawl: bool = False) -> DataFrame:
    """text_id, text -> text_id, chunk_no, offset, text. Null and blank texts have no chunks."""
    rows = texts.select(F.col(text_id).cast("bigint"), "text").mapInArrow(_cut(target, overlap, crawl), "text_id bigint, chunk_no int, offset int, text string")
    return rows.withColumnRenamed("text_id", text_id)
