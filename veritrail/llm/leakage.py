"""Problem 7: test items that stand, wholly or in part, in documents.

Size-partitioned MinHash containment search, verified by exact shingle containment. Both sides are
reduced to their letters, digits and ideographs (compatibility forms and case levelled) and cut into
shingles of `stretch` such characters.

1. Items are partitioned by the power of two of their number of distinct shingles. The sketch of an item is its
   k shingles of least hash (bottom-k MinHash). k is set by the partition: from the least number c of shingles that an
   item contained to `share` has in common with a document, and the most shingles n that an item of the partition has,
   so that an item with c common shingles escapes its sketch with a probability of `miss` at most,
   (1 - k/n)^c <= miss; with k = n - c + 1 no contained item escapes at all, so k is never more.
2. One scan of the documents looks up sketched shingles only, through a filter of bounded size, and keeps
   documents that may hold one. A join with the sketches gives the candidates.
3. A candidate's item is compared with the document in full: the characters of the item that stand in
   shingles of the document are counted exactly.

A document's side needs no sketch of fixed length, in which a short item would drown, and signatures with bands were not
taken: the common part may stand in any order at any places, so no window of a document need be similar to the item.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.membership import membership
from ..session import materialize
from .codes import code_points, gram_hashes, whole

STRETCH = 16
SHARE = 0.5
MISS = 1e-6
#: Items that a document is compared with at once; a document with more comes once for each so many.
TOGETHER = 256
_TABLE = 0x30000
_SLOW = 0xFFFFFFFF


@cache
def _letters() -> np.ndarray:
    """For each code point what remains of it: a code point, 0 for nothing, or _SLOW where the text
    around matters (combining marks) or several characters come out."""
    table = np.zeros(_TABLE, np.uint32)
    for code in range(_TABLE):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or not (c.isalnum() or unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c):
            continue
        out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).lower())
        if unicodedata.combining(c) or len(out) != 1:
            table[code] = _SLOW if any(x.isalnum() for x in out) or unicodedata.combining(c) else 0
        elif out.isalnum():
            table[code] = ord(out)
    return table


def bare(text: str) -> str:
    """The letters, digits and ideographs of a text, compatibility forms and case levelled."""
    return "".join(c for c in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower()) if c.isalnum())


def bare_map():
    """The levelling of bare() as SQL around a column, for the oracle: characters that become one other character by a
    table that follows from the Unicode database."""
    single = {}
    for code in range(0x80, 0x20000):
        out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", chr(code)).lower()) if not 0xD800 <= code < 0xE000 else ""
        if len(out) == 1 and out != chr(code) and unicodedata.normalize("NFC", chr(code)) == chr(code):
            single[chr(code)] = out
    quoted = lambda x: "'" + "".join(x).replace("'", "''") + "'"
    return lambda column: f"nfc_normalize(translate(lower(nfc_normalize({column})), {quoted(single)}, {quoted(single.values())}))"


def _bare_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and lengths of bare(text) for all texts."""
    table = _letters()
    codes, lengths = code_points(texts)
    found = table[np.minimum(codes, _TABLE - 1)]
    found[codes >= _TABLE] = _SLOW
    text_of = np.repeat(np.arange(len(texts)), lengths)
    slow = np.unique(text_of[found == _SLOW])
    if slow.size:
        again = list(texts)
        for n in slow:
            again[n] = bare(texts[n])
        codes, lengths = code_points(again)
        text_of = np.repeat(np.arange(len(texts)), lengths)
        found = table[np.minimum(codes, _TABLE - 1)]
        rest = (codes >= _TABLE) | (found == _SLOW) | np.isin(text_of, slow)
        found[rest] = codes[rest]
    keep = found != 0
    return found[keep], np.bincount(text_of[keep], minlength=len(texts))


def least_common(text: np.ndarray, hashes: np.ndarray, stretch: int, share: float) -> int:
    """The least number of distinct shingles that a document must have in common with an item (code points and
    shingle hashes) to hold `share` of it: each covers `stretch` characters wherever it stands in the item."""
    times = np.sort(np.unique(hashes, return_counts=True)[1])[::-1]
    return int(np.searchsorted(np.cumsum(times) * stretch, math.ceil(share * text.size)) + 1)


def _bare_items(stretch: int, share: float):
    schema = pa.schema([("item_id", pa.int64()), ("bare", pa.string()), ("n", pa.int32()), ("c", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                text = bare(text)
                if len(text) >= stretch:
                    codes = code_points([text])[0]
                    hashes = gram_hashes(codes, stretch)
                    rows.append((item, text, np.unique(hashes).size, least_common(codes, hashes, stretch, share)))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _sketches(stretch: int):
    schema = pa.schema([("hash", pa.int64()), ("bare", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, k in zip(batch.column("bare").to_pylist(), batch.column("k").to_pylist()):
                least = np.unique(gram_hashes(code_points([text])[0], stretch))[:k]
                yield pa.record_batch([pa.array(least.view(np.int64)), pa.array([text] * least.size)], schema=schema)

    return run


def _scan(known, stretch: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for numbers, pieces in whole(texts):
                codes, lengths = _bare_codes(pieces)
                hashes = gram_hashes(codes, stretch)
                at = known.value(hashes)
                ends = np.cumsum(lengths)
                text = np.searchsorted(ends, at, "right")
                inside = at + stretch <= ends[text] if at.size else np.empty(0, bool)
                at, text = at[inside], text[inside]
                out = []
                for n in np.unique(text):
                    part = codes[ends[n] - lengths[n] : ends[n]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                    out.append((ids[numbers[n]], part, np.unique(hashes[at[text == n]]).view(np.int64)))
                if out:
                    yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], schema=schema)

    return run


def held_characters(item: str, doc: np.ndarray, doc_hashes: np.ndarray, order: np.ndarray, stretch: int) -> int:
    """How many of the item's characters stand in the document (code points, shingle hashes and their order) in
    common shingles. Equal hashes are compared character by character."""
    codes = code_points([item])[0]
    hashes = gram_hashes(codes, stretch)
    left = np.searchsorted(doc_hashes, hashes, "left", sorter=order)
    known = np.flatnonzero(doc_hashes[order[np.minimum(left, order.size - 1)]] == hashes) if order.size else np.empty(0, np.int64)
    at = order[left[known]]
    same = np.ones(known.size, bool)
    for k in range(stretch):
        same &= codes[known + k] == doc[at + k]
    if not same.all():  # one hash, two contents: look for the text itself
        text = doc.tobytes().decode("utf-32-le", "surrogatepass")
        for j in np.flatnonzero(~same):
            same[j] = item[known[j] : known[j] + stretch] in text
    hit = np.zeros(codes.size + 1, np.int64)
    np.add.at(hit, known[same], 1)
    np.add.at(hit, known[same] + stretch, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def _verify(stretch: int, share: float):
    schema = pa.schema([("doc_id", pa.int64()), ("bare", pa.string()), ("item_chars", pa.int64()), ("leaked_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                codes = code_points([text])[0]
                hashes = gram_hashes(codes, stretch)
                order = np.argsort(hashes, kind="stable")
                for item in items:
                    held = held_characters(item, codes, hashes, order, stretch)
                    if held >= share * len(item):
                        rows.append((doc, item, len(item), held))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def item_sketches(items: DataFrame, stretch: int = STRETCH, share: float = SHARE, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """item_id, text -> (item_id, bare, n, c) of the items with a shingle at all, and (bare, partition, n, k) of
    their distinct bare texts: size partition, distinct shingles and size of the sketch."""
    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").distinct()
    # by number: items are little data and much work
    known = materialize(rows.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_bare_items(stretch, share), "item_id bigint, bare string, n int, c int"), "items")
    texts = known.groupBy("bare").agg(F.first("n").alias("n"), F.first("c").alias("c")).withColumn("partition", F.floor(F.log2("n")).cast("int"))
    bounds = texts.groupBy("partition").agg(F.max("n").alias("most"), F.min("c").alias("least"))  # a row a power of two
    fraction = 1 - F.pow(F.lit(miss), 1 / F.col("least"))
    k = F.least(F.ceil(F.col("n") * fraction), F.col("n") - F.col("c") + 1)
    return known, texts.join(F.broadcast(bounds), "partition").select("bare", "partition", "n", F.greatest(k, F.lit(1)).cast("int").alias("k"))


def leaked_items(docs: DataFrame, items: DataFrame, stretch: int = STRETCH, share: float = SHARE, miss: float = MISS, together: int = TOGETHER) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, item_chars, leaked_chars for each
    document and item of which at least `share` of the letters, digits and ideographs stand in the
    document in stretches of at least `stretch`.

    Null texts and items with fewer than `stretch` such characters match nothing. Repeated rows give one
    row; items of one bare text are searched for once. The documents are scanned once, however many items there are."""
    known, sized = item_sketches(items, stretch, share, miss)
    sketches = materialize(sized.mapInArrow(_sketches(stretch), "hash bigint, bare string"), "sketches")
    lookup = membership(sketches, "hash", sketches.count())
    docs = docs.filter(F.length("text") >= stretch).select(F.col("doc_id").cast("bigint"), "text")
    held = materialize(docs.mapInArrow(_scan(lookup, stretch), "doc_id bigint, text string, hashes array<bigint>"), "held")
    met = held.select("doc_id", F.explode("hashes").alias("hash")).join(sketches, "hash").select("doc_id", "bare").distinct()
    # a document that holds any number of items is compared with some of them at a time
    many = met.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("_parts"))
    shares = met.join(many, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("bare"), F.col("_parts")).alias("_part")).agg(F.collect_list("bare").alias("items"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = shares.join(held.select("doc_id", "text"), "doc_id").repartition(parts, "doc_id", "_part").select("doc_id", "text", "items")
    found = pairs.mapInArrow(_verify(stretch, share), "doc_id bigint, bare string, item_chars bigint, leaked_chars bigint")
    rows = found.join(known.select("item_id", "bare"), "bare")
    return rows.groupBy("doc_id", "item_id").agg(F.max("item_chars").alias("item_chars"), F.max("leaked_chars").alias("leaked_chars"))
