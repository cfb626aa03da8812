"""Reference texts as wholes, put together again from their overlapping chunks.

Evidence is a matter of the whole text: a name 100 characters from a keyword is near it wherever a chunk ends. A text
isn't built as one string, as one source may hold a third of everything. It is cut into pieces of equal length, each
with what stands around it, so that whatever begins in a piece is seen in full there and counted there only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece, of what is added in front and behind, and of a stretch of text that is put together at once.
PIECE, BEFORE, BEHIND, STRETCH = 1024, 80, 256, 1 << 16

_OUT = pa.schema([("source_path", pa.string()), ("piece_no", pa.int64()), ("lead", pa.int32()), ("own", pa.int32()), ("text", pa.string())])


def joined(parts: list[tuple[int, str]], low: int, high: int) -> str:
    """The characters low to high of a text, from chunks (offset, text) in order: where chunks overlap the first one
    counts; a gap between them is newlines. Ends where the last chunk ends."""
    out, at = [], low
    for offset, text in parts:
        end = min(offset + len(text), high)
        if end <= at:
            continue
        if offset > at:
            out.append("\n" * (offset - at))
            at = offset
        out.append(text[at - offset : end - offset])
        at = end
    return "".join(out)


def _pieces(piece: int, before: int, behind: int, stretch: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = key[1].as_py() * stretch
        rows = sorted(zip(table.column("chunk_offset").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0], -len(r[1]), r[1]))
        low = max(0, first - before)
        text = joined(rows, low, first + stretch + behind)
        out = []
        for start in range(first, min(first + stretch, low + len(text)), piece):
            own = min(piece, low + len(text) - start)
            begin = max(low, start - before)
            out.append((key[0].as_py(), start // piece, start - begin, own, text[begin - low : start + own + behind - low]))
        return pa.Table.from_pylist([dict(zip(_OUT.names, r)) for r in out], _OUT)

    return run


def pieces(chunks: DataFrame, piece: int = PIECE, before: int = BEFORE, behind: int = BEHIND, stretch: int = STRETCH) -> DataFrame:
    """chunks (source_path, chunk_offset, text) -> source_path, piece_no, lead, own, text: the texts in pieces. The
    first `lead` characters of text stand in front of the piece, then come its `own` ones, then those behind it; its own
    begin at character piece_no * piece of the whole text.

    Chunks of one offset count as the longest; null texts count for nothing; a null offset counts as 0. A stretch is put
    together from the chunks that reach into it, so no source is collected as a whole; where a stretch ends in a gap, the
    gap's newlines are left out. Terms longer than `behind` + 1
    characters may be missed over the edge of a piece."""
    if stretch % piece:
        raise ValueError("a stretch is a whole number of pieces")
    rows = chunks.select("source_path", F.greatest(F.coalesce("chunk_offset", F.lit(0)), F.lit(0)).cast("bigint").alias("chunk_offset"), "text").filter("text <> ''")
    low = F.greatest(F.floor((F.col("chunk_offset") - behind) / stretch), F.lit(0))
    high = F.floor((F.col("chunk_offset") + F.length("text") - 1 + before) / stretch)
    rows = rows.select("*", F.explode(F.sequence(low, high)).alias("_stretch"))
    return rows.groupBy("source_path", "_stretch").applyInArrow(_pieces(piece, before, behind, stretch), "source_path string, piece_no bigint, lead int, own int, text string")
