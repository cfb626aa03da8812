"""Problem 1: long spans that stand word for word in records of different origins.

A generalised suffix tree over all suffixes would shuffle each text fifty times over. Here only the
part of it is built that can have internal nodes of depth `span` with leaves of two origins:

1. Each window of `span` characters is assigned to the position in it whose `prefix`-gram hashes
   smallest (leftmost on ties). That depends on the window's content alone, so equal windows anywhere
   have equal anchors at equal offsets, and the windows of one anchor in a row are one stretch of text.
2. The anchor's gram is the first prefix by which suffixes are split into groups. A prefix seen in one
   origin only can't lead to a shared node (two long columns are shuffled, pre-aggregated to the least and the greatest
   origin, no text). A second scan gives out the stretches at the other prefixes, through a filter of bounded size.
3. Equal stretches are merged with least and greatest origin and come together by prefix. The prefix of a group with more
   suffixes than `group_limit`, that is than a task should hold in memory, is lengthened to `span` characters: its suffixes are
   split by their first `span` characters, and each such group is one node, found by a pre-aggregated groupBy. Lengths between
   the two would split the same suffixes once more and end at the same nodes.
4. In a group, the suffixes that begin at windows are sorted, and the lengths of the common prefixes of neighbours
   give the subtree's internal nodes; those of depth `span` with leaves of two origins are the shared windows.
5. Neighbouring and overlapping shared windows of a record are joined to its maximal shared spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.membership import membership
from ..session import materialize
from .codes import code_points, gram_hashes, slices, window_minimum

SPAN = 50
PREFIX = 16
GROUP_LIMIT = 100_000
_AT_BITS = 25


def _stretches(texts: list[str | None], span: int, prefix: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, start, number of windows and prefix hash of each anchor's stretch of windows."""
    width = span - prefix + 1
    for numbers, offsets, pieces in slices(texts, span - 1):
        codes, lengths = code_points(pieces)
        hashes = gram_hashes(codes, prefix)
        if hashes.size < width:
            continue
        at = np.arange(hashes.size, dtype=np.uint64)
        packed = (hashes >> np.uint64(_AT_BITS) << np.uint64(_AT_BITS)) | at
        anchor = window_minimum(packed, width) & np.uint64((1 << _AT_BITS) - 1)
        ends = np.cumsum(lengths)
        text_of = np.repeat(np.arange(len(pieces)), lengths)[: anchor.size]
        windows = np.flatnonzero(np.arange(anchor.size) + span <= ends[text_of])
        if not windows.size:
            continue
        anchor, text_of = anchor[windows].astype(np.int64), text_of[windows]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text_of[1:] != text_of[:-1])])
        count = np.diff(np.r_[first, windows.size])
        text = text_of[first]
        start = windows[first] - (ends - lengths)[text] + np.asarray(offsets, np.int64)[text]
        yield np.asarray(numbers, np.int64)[text], start, count, hashes[anchor[first]].view(np.int64)


def _prefix_origins(span: int, prefix: int):
    schema = pa.schema([("prefix", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origins = batch.column("origin").to_numpy()
            for number, _, _, key in _stretches(batch.column("text").to_pylist(), span, prefix):
                origin = origins[number]
                order = np.lexsort((origin, key))
                key, origin = key[order], origin[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                last = np.r_[first[1:], key.size] - 1
                yield pa.record_batch([pa.array(key[first]), pa.array(origin[first]), pa.array(origin[last])], schema=schema)

    return run


def _shared_stretches(known, span: int, prefix: int):
    schema = pa.schema([("prefix", pa.int64()), ("record", pa.int64()), ("origin", pa.int64()), ("n_chars", pa.int32()), ("start", pa.int64()), ("stretch", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records, origins, texts = batch.column("record").to_numpy(), batch.column("origin").to_numpy(), batch.column("text").to_pylist()
            for number, start, count, key in _stretches(texts, span, prefix):
                hit = known.value(key)
                number, start, count = number[hit], start[hit], count[hit]
                cut = [texts[n][a : a + w] for n, a, w in zip(number.tolist(), start.tolist(), (count + span - 1).tolist())]
                sizes = [len(texts[n]) for n in number.tolist()]
                yield pa.record_batch([pa.array(key[hit]), pa.array(records[number]), pa.array(origins[number]), pa.array(sizes, pa.int32()), pa.array(start), pa.array(cut, pa.string())], schema=schema)

    return run


def deep_nodes(group: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray]:
    """texts of some groups in a row, with their group's number and least and greatest origin: for each suffix that begins
    at a window (number of its text, place in it) whether it lies below an internal node of depth `span` with leaves of
    two origins. Returned as the text's number and place of those that do."""
    codes, lengths = code_points(texts)
    of = np.repeat(np.arange(len(texts)), lengths - span + 1)
    place = np.arange(of.size) - np.repeat(np.cumsum(lengths - span + 1) - (lengths - span + 1), lengths - span + 1)
    first = np.cumsum(lengths) - lengths
    # suffixes, as far as a node's depth matters, behind their group's number; big-endian, so that bytes sort as characters
    rows = np.empty((of.size, span + 1), ">u4")
    rows[:, 0] = group[of]
    rows[:, 1:] = np.lib.stride_tricks.sliding_window_view(codes, span)[first[of] + place]
    order = np.argsort(rows.view(f"V{4 * (span + 1)}").ravel(), kind="stable")
    rows = rows[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1) - 1, span)  # of neighbours; -1 in different groups
    node = np.cumsum(np.r_[0, common < span]) if of.size else of
    begins = np.flatnonzero(np.r_[True, common < span]) if of.size else of
    least, most = np.minimum.reduceat(low[of[order]], begins), np.maximum.reduceat(high[of[order]], begins)
    inside = order[(least < most)[node]]
    return of[inside], place[inside]


def _trees(span: int, most: int = 1 << 16):
    schema = pa.schema([("stretch", pa.string()), ("marks", pa.int64())])

    def close(held: list[tuple[object, str, int, int]]) -> pa.RecordBatch:
        keys: dict[object, int] = {}
        group = np.fromiter((keys.setdefault(h[0], len(keys)) for h in held), np.int64, len(held))
        low, high = (np.fromiter((h[k] for h in held), np.int64, len(held)) for k in (2, 3))
        text, place = deep_nodes(group, low, high, [h[1] for h in held], span)
        marks = np.zeros(len(held), np.int64)
        np.bitwise_or.at(marks, text, np.int64(1) << place)
        some = np.flatnonzero(marks)
        return pa.record_batch([pa.array([held[n][1] for n in some], pa.string()), pa.array(marks[some])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, str, int, int]] = []
        suffixes, prefix = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("prefix", "stretch", "low", "high"))):
                if row[0] != prefix and suffixes > most:
                    yield close(held)
                    held, suffixes = [], 0
                prefix = row[0]
                held.append(row)
                suffixes += len(row[1]) - span + 1
        if held:
            yield close(held)

    return run


def _joined(span: int):
    schema = pa.schema([("record", pa.int64()), ("n_chars", pa.int32()), ("spans", pa.list_(pa.list_(pa.int64()))), ("shared_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            if not len(lists):
                continue
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
            record = np.repeat(np.arange(len(sizes)), sizes)
            start, marks = flat.field("start").to_numpy(), flat.field("marks").to_numpy()
            bits = np.arange(int(np.bitwise_or.reduce(marks)).bit_length())
            row, bit = np.nonzero(marks[:, None] >> bits & 1)
            at, record = start[row] + bits[bit], record[row]
            order = np.lexsort((at, record))
            at, record = at[order], record[order]
            first = np.flatnonzero(np.r_[True, (record[1:] != record[:-1]) | (at[1:] > at[:-1] + span)])
            spans = np.stack([at[first], at[np.r_[first[1:], at.size] - 1] + span], axis=1)
            count = np.bincount(record[first], minlength=len(sizes))
            total = np.bincount(record[first], weights=spans[:, 1] - spans[:, 0], minlength=len(sizes)).astype(np.int64)
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(spans) + 1, 2), pa.int32()), pa.array(spans.ravel()))
            nested = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pairs)
            yield pa.record_batch([batch.column("record"), batch.column("n_chars"), nested, pa.array(total)], schema=schema)

    return run


def shared_spans(records: DataFrame, span: int = SPAN, prefix: int = PREFIX, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """record (bigint, key), origin (string), text -> record, n_chars, spans (start and end of each
    maximal stretch, in code points), shared_chars, for the records that share at least `span`
    consecutive characters with a record of another origin.

    Null and shorter texts share nothing. A null origin is an origin of its own. A record delivered
    several times with the same text and origin counts once. Further columns are not carried along.
    `span - prefix` is at most 61, for the marks of a stretch are the bits of a long."""
    if not 1 <= span - prefix <= 61:
        raise ValueError("span - prefix must lie between 1 and 61")
    texts = records.select(F.col("record").cast("bigint"), F.xxhash64(F.coalesce("origin", F.lit("\0null"))).alias("origin"), "text").filter(F.length("text") >= span)
    shared = (
        texts.select("origin", "text")
        .mapInArrow(_prefix_origins(span, prefix), "prefix bigint, low bigint, high bigint")
        .groupBy("prefix").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("low < high").select("prefix")
    )
    shared = materialize(shared, "prefixes")
    known = membership(shared, "prefix", shared.count())
    columns = "prefix bigint, record bigint, origin bigint, n_chars int, start bigint, stretch string"
    stretches = materialize(texts.mapInArrow(_shared_stretches(known, span, prefix), columns), "stretches")
    groups = materialize(stretches.groupBy("prefix", "stretch").agg(F.min("origin").alias("low"), F.max("origin").alias("high")), "groups")
    large = groups.groupBy("prefix").agg(F.sum(F.length("stretch") - (span - 1)).alias("_n")).filter(F.col("_n") > group_limit).select("prefix", F.lit(True).alias("_large"))
    sized = groups.join(large, "prefix", "left")
    trees = (
        sized.filter("_large is null").select("prefix", "stretch", "low", "high")
        .repartition("prefix").sortWithinPartitions("prefix")
        .mapInArrow(_trees(span), "stretch string, marks bigint")
    )
    suffixes = sized.filter("_large").select(
        "stretch", "low", "high", F.posexplode(F.expr(f"transform(sequence(1, length(stretch) - {span - 1}), i -> substring(stretch, i, {span}))")).alias("at", "suffix")
    )
    nodes = suffixes.groupBy("suffix").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("suffix")
    split = suffixes.join(nodes, "suffix").groupBy("stretch").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("marks"))
    marked = trees.unionByName(split)
    return (
        stretches.select("stretch", "record", "n_chars", "start").join(marked, "stretch")
        .groupBy("record").agg(F.max("n_chars").alias("n_chars"), F.collect_set(F.struct("start", "marks")).alias("places"))
        .mapInArrow(_joined(span), "record bigint, n_chars int, spans array<array<bigint>>, shared_chars bigint")
    )
