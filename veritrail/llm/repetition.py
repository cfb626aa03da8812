"""Problem 8: repetition inside a document, by line-first cleaning.

A document is judged line by line (a line runs to and with its newline; a text without newlines is one
line). A line fails, and is removed, by any of three rules:

- boilerplate: at least `line_share` of its characters lie in stretches of `gram` characters that also start earlier
  in the document;
- punctuation: it has visible text that doesn't end with closing punctuation;
- navigation: it has visible text, at most `short` characters, and two separators or more.

What the other lines hold is the cleaned text. A document that loses too much text to the boilerplate rule is
rejected: if r of its n characters are repeated and r >= limit * n, then the lines that don't fail hold less than
line_share of their characters of r, so the failing lines hold at least (limit - line_share) / (1 - line_share) * n
characters. Documents that lose so much are looked at more closely: they are rejected if r >= limit * n. No repetitive document
escapes, whatever its lines are like, and one long line with a repeated phrase in it rejects none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .codes import code_points, gram_hashes, mix, whole

GRAM = 10
LIMIT = 0.3
LINE_SHARE = 0.15
SHORT = 40
# What a line may end with, what separates entries, what isn't visible.
ENDS = "。！？…；：.!?;:”’\"'』」》）)】]—"
SEPARATORS = "|>»›·•/｜＞"
BLANKS = (0x9, 0xA, 0xD, 0x20, 0xA0, 0x2002, 0x2003, 0x3000)
_ENDS, _SEPARATORS, _BLANKS = (np.array(sorted(x), np.uint32) for x in (map(ord, ENDS), map(ord, SEPARATORS), BLANKS))

SCHEMA = "{id} bigint, n_chars bigint, n_lines int, boilerplate_lines int, punctuation_lines int, navigation_lines int, boilerplate_chars bigint, lost_chars bigint, repeated_chars bigint, rejected boolean"


def _among(codes: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.minimum(np.searchsorted(values, codes), values.size - 1)] == codes


def repeated_characters(codes: np.ndarray, ends: np.ndarray, text_of: np.ndarray, gram: int) -> np.ndarray:
    """For each character, whether it belongs to a stretch of `gram` characters that starts a second
    time or more in the same text. Equal hashes are compared character by character."""
    hit = np.zeros(codes.size + 1, np.int32)
    hashes = gram_hashes(codes, gram)
    if hashes.size:
        starts = np.flatnonzero(np.arange(hashes.size) + gram <= ends[text_of[: hashes.size]])
        keys = hashes[starts] ^ mix(text_of[starts].astype(np.uint64) + np.uint64(77))
        # sorted with the place in the low bits: equal upper bits are neighbours, in the order of the text
        low = np.uint64(max(1, int(starts.size - 1).bit_length()))
        packed = keys >> low << low | np.arange(starts.size, dtype=np.uint64)
        packed.sort()
        keys, at = packed >> low, starts[(packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)]
        again = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        now, before = at[again], at[again - 1]
        same = text_of[now] == text_of[before]
        for k in range(gram):
            same &= codes[now + k] == codes[before + k]
        if not same.all():  # two stretches with one hash: settle their key's starts by content
            seen: dict[tuple, bool] = {}
            bad = np.isin(keys, keys[again[~same]])
            good = same & ~bad[again]
            extra = [p for p in at[bad] if seen.setdefault((text_of[p], codes[p : p + gram].tobytes()), p) != p]
            now, same = np.r_[now[good], np.asarray(extra, np.int64)], slice(None)
        now = now[same].astype(np.int64)
        hit[now] += 1  # each start stands once in now
        hit[now + gram] -= 1
    return np.cumsum(hit[:-1]) > 0


def _clean(gram: int, short: int, line_share: float, limit: float, cleaned: bool, schema: pa.Schema, id_column: str):
    loss = (limit - line_share) / (1 - line_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column(id_column)
            for numbers, pieces in whole(texts):
                codes, lengths = code_points(pieces)
                ends = np.cumsum(lengths)
                text_of = np.repeat(np.arange(len(pieces)), lengths)
                # lines: one begins at each text's start and behind each newline within a text
                is_start = np.zeros(codes.size, bool)
                is_start[(ends - lengths)[lengths > 0]] = True
                inner = np.flatnonzero(codes == 10) + 1
                is_start[inner[inner < codes.size]] = True
                start = np.flatnonzero(is_start)
                line_of = text_of[start] if start.size else np.empty(0, np.int64)
                size = np.diff(np.r_[start, codes.size])
                add = lambda values: np.add.reduceat(values.astype(np.int64), start) if start.size else np.empty(0, np.int64)
                count = lambda w=None: np.bincount(line_of, weights=w, minlength=len(pieces)).astype(np.int64)
                # the rules
                repeated = add(repeated_characters(codes, ends, text_of, gram))
                visible = np.where(_among(codes, _BLANKS), -1, np.arange(codes.size))
                last = np.maximum.reduceat(visible, start) if start.size else visible
                full = last >= 0
                boilerplate = (repeated > 0) & (repeated >= line_share * size)
                punctuation = full & ~_among(codes[np.maximum(last, 0)], _ENDS) if start.size else full
                navigation = full & (size <= short) & (add(_among(codes, _SEPARATORS)) >= 2)
                fails = boilerplate | punctuation | navigation
                # the loss, and for who loses much the closer look
                to_boilerplate, total = count(boilerplate * size), count(repeated)
                rejected = (lengths > 0) & (to_boilerplate >= loss * lengths) & (total >= limit * lengths)
                columns = [lengths, count(), count(boilerplate), count(punctuation), count(navigation), to_boilerplate, count(fails * size), total, rejected]
                arrays = [ids.take(pa.array(numbers)), *map(pa.array, columns)]
                if cleaned:
                    keep = np.repeat(~fails, size)
                    kept = codes[keep].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                    cut = np.r_[0, np.cumsum(np.bincount(text_of[keep], minlength=len(pieces)))].tolist()
                    arrays.append(pa.array([kept[a:b] for a, b in zip(cut, cut[1:])], pa.string()))
                yield pa.record_batch([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return run


def clean_lines(docs: DataFrame, id_column: str = "doc_id", gram: int = GRAM, short: int = SHORT, line_share: float = LINE_SHARE, limit: float = LIMIT, cleaned: bool = True) -> DataFrame:
    """id, text -> n_chars, n_lines, lines failing each rule, boilerplate_chars and lost_chars (of lines failing that
    rule, or any), repeated_chars, rejected, and the cleaned text (unless not asked for); one row a row of docs.

    A null text counts as empty: no characters, no lines, not rejected. Texts are never cut; memory follows the
    longest text. Further columns are not carried along."""
    if not 0 <= line_share < limit:
        raise ValueError("line_share must be less than limit")
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.bool_()] + [pa.string()] * cleaned
    columns = SCHEMA.format(id=id_column) + ", cleaned string" * cleaned
    schema = pa.schema(list(zip((x.split()[0] for x in columns.split(", ")), types)))
    return docs.selectExpr(f"cast({id_column} as bigint) {id_column}", "text").mapInArrow(_clean(gram, short, line_share, limit, cleaned, schema, id_column), columns)
