"""Which terms stand in which texts, and where: the join on containment, without a nested loop.

A term can only stand where its grams of three characters stand (a shorter term is its own gram). Grams fit
into a long (21 bits a code point).

1. One scan of the texts counts the grams that terms have, added up within each task before anything is shuffled.
2. Each term is sought by its rarest gram, the anchor, at a known place in the term.
3. A second scan gives out the places of anchors only, each with the characters around it: a filter of bounded
   size in the scan keeps all other grams from being shuffled. The join on the gram then compares the term with those
   characters and has its place at once, so texts are neither shuffled nor read a third time.

Only terms longer than HEAD are found by their first HEAD characters and compared with the text itself afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import apart
from ..session import materialize, spread
from .membership import membership

GRAM, HEAD = 3, 64


def packed_grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place (from 0) and gram of all grams of `size` characters."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if codes.size < size:
        return (np.empty(0, np.int64),) * 3
    gram = codes[: codes.size - size + 1].copy()
    for k in range(1, size):
        gram = gram << 21 | codes[k : codes.size - size + 1 + k]
    text_of = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(codes.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.flatnonzero(text_of[: gram.size] == text_of[size - 1 :])
    return text_of[inside], place[inside], gram[inside]


@cache
def _lower() -> dict[int, str]:
    return {c: low for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1 and low != chr(c)}


def levelled(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_lower())


def _shares(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts (null as empty) in runs of about `most` characters, with the number of the first."""
    low, held = 0, 0
    for high in range(1, len(texts) + 1):
        held += len(texts[high - 1] or "")
        if held >= most or high == len(texts):
            yield low, [t or "" for t in texts[low:high]]
            low, held = high, 0


def _term_grams(ignore_case: bool):
    schema = pa.schema([("term", pa.string()), ("sought", pa.string()), ("at", pa.int32()), ("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = np.array(batch.column("term").to_pylist(), object)
            sought = np.array([levelled(t) if ignore_case else t for t in terms], object)
            for size in range(1, GRAM + 1):
                mine = np.flatnonzero([min(GRAM, len(t)) == size for t in sought]) if terms.size else np.empty(0, np.int64)
                if mine.size:
                    term, at, gram = packed_grams([t[:HEAD] for t in sought[mine]], size)
                    yield pa.record_batch([pa.array(terms[mine[term]], pa.string()), pa.array(sought[mine[term]], pa.string()), pa.array(at.astype(np.int32)), pa.array(gram)], schema=schema)

    return run


def _frequencies(known, ignore_case: bool, most: int = 1 << 20):
    schema = pa.schema([("gram", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for _, texts in _shares(batch.column(0).to_pylist()):
                _, _, gram = packed_grams([levelled(t) for t in texts] if ignore_case else texts, GRAM)
                new, count = np.unique(gram[known.value(gram)], return_counts=True)
                every, where = np.unique(np.r_[grams, new], return_inverse=True)
                grams, times = every, np.bincount(where, weights=np.r_[times, count], minlength=every.size).astype(np.int64)
                if grams.size > most:
                    yield pa.record_batch([pa.array(grams), pa.array(times)], schema=schema)
                    grams, times = grams[:0], times[:0]
        yield pa.record_batch([pa.array(grams), pa.array(times)], schema=schema)

    return run


def _places(known, sizes: list[int], reach: int, ignore_case: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.drop_columns(["text"])
            for low, texts in _shares(batch.column("text").to_pylist()):
                level = [levelled(t) for t in texts] if ignore_case else texts
                differs = np.array([a is not b and a != b for a, b in zip(level, texts)])
                for size in sizes:
                    number, place, gram = packed_grams(level, size)
                    hit = known.value(gram)
                    number, place, gram = number[hit], place[hit], gram[hit]
                    # a row a text and gram, with its places in order
                    order = np.lexsort((place, gram, number))
                    number, place, gram = number[order], place[order], gram[order]
                    first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (gram[1:] != gram[:-1])]) if number.size else number
                    ends = pa.array(np.r_[first, number.size].astype(np.int32))
                    spots = list(zip(number.tolist(), place.tolist()))
                    cut = lambda of, n, p: of[n][max(0, p - reach) : p + reach]
                    around = pa.array([cut(level, n, p) for n, p in spots] if size == GRAM else [None] * len(spots), pa.string())
                    # as written: only where that differs from the levelled characters
                    written = pa.array([cut(texts, n, p) if differs[n] else None for n, p in spots] if differs.any() else [None] * len(spots), pa.string())
                    lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(place.astype(np.int32)), around, written)]
                    extra = [pa.array(gram[first]), *lists, pa.array([len(texts[n]) for n in number[first].tolist()], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*keys.take(pa.array(number[first] + low)).columns, *extra], schema=schema)

    return run


def contains_join(terms: DataFrame, texts: DataFrame, *keys: str, ignore_case: bool = False) -> DataFrame:
    """terms (term), texts (keys, text) -> term, keys, places, n_found, n_exact, n_chars: each distinct term and
    the texts that contain it, with the places of its occurrences (from 1, in order, also those that overlap), the number
    of occurrences that don't overlap, of those as written, and the text's length.

    Null and empty terms and null texts meet nothing. The keys tell texts apart; a text delivered twice is found twice.
    `ignore_case` finds and counts terms in either case, character by character."""
    terms = terms.select("term").filter("term is not null and term <> ''").distinct()
    grams = materialize(terms.mapInArrow(_term_grams(ignore_case), "term string, sought string, at int, gram bigint"), "term-grams")
    texts = spread(texts.select(*keys, "text").filter("text is not null"), *keys)
    sized = F.least(F.length("sought"), F.lit(GRAM)).alias("size")
    counts = {r["size"]: r for r in grams.groupBy(sized).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sought")).alias("longest")).collect()}  # three rows at most
    sizes = sorted(counts) or [GRAM]
    whole = grams.filter(F.length("sought") < GRAM).select("term", "sought", "at", "gram")
    long = grams.filter(F.length("sought") >= GRAM)
    if GRAM in counts:
        known = membership(long, "gram", counts[GRAM]["n"])
        frequency = texts.select("text").mapInArrow(_frequencies(known, ignore_case), "gram bigint, times bigint").groupBy("gram").agg(F.sum("times").alias("times"))
        # the rarest gram of a term; a gram that no text has keeps its term from being found at all
        met = long.join(frequency, "gram", "left").groupBy("term", "sought").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram", "at")).alias("a"))
        whole = whole.unionByName(met.filter("a.times > 0").select("term", "sought", "a.at", "a.gram"))
    anchors = materialize(whole, "anchors")
    known = membership(anchors, "gram", anchors.count())
    longest = max((r["longest"] for r in counts.values()), default=0)
    reach = min(HEAD, longest)  # as much around a place as the longest term needs
    types = texts.select(*keys).limit(0).toArrow().schema
    schema = pa.schema([*types, ("gram", pa.int64()), ("place", pa.list_(pa.int32())), ("around", pa.list_(pa.string())), ("written", pa.list_(pa.string())), ("n_chars", pa.int32())])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    found = texts.mapInArrow(_places(known, sizes, reach, ignore_case, schema), f"{columns}, gram bigint, place array<int>, around array<string>, written array<string>, n_chars int").join(anchors, "gram")
    width = F.least(F.length("sought"), F.lit(HEAD))
    lead = lambda s: F.least(s["place"], F.lit(reach))
    cut = lambda s, c: F.substring(s[c], lead(s) - F.col("at") + 1, width)
    stands = lambda s: s["around"].isNull() | (lead(s) >= F.col("at")) & (cut(s, "around") == F.left("sought", width))
    as_written = lambda s: F.coalesce(cut(s, "written"), cut(s, "around"), F.col("sought")) == F.left("term", width)
    # a term that is its own gram stands at every place, in a text without capitals as it is sought
    own = (F.length("sought") < GRAM) & F.col("written")[0].isNull()
    zipped = F.filter(F.arrays_zip("place", "around", "written"), stands)
    moved = lambda spots: F.transform(spots, lambda s: s["place"] - F.col("at") + 1)
    none = F.array().cast("array<int>")
    places = F.when(own, F.transform("place", lambda p: p + 1)).otherwise(moved(zipped))
    exact = F.when(own, F.when(F.col("sought") == F.col("term"), F.transform("place", lambda p: p + 1)).otherwise(none)).otherwise(moved(F.filter(zipped, as_written)))
    found = found.select("term", "sought", *keys, "n_chars", places.alias("places"), (exact if ignore_case else none).alias("exact")).filter("size(places) > 0")
    if longest > HEAD:
        more = found.filter(F.length("sought") > HEAD).join(texts.dropDuplicates(list(keys)), list(keys))
        level = F.lower if ignore_case else lambda c: c
        part = lambda p: F.substring(F.col("text"), p, F.length("term"))
        more = more.withColumns({"places": F.filter("places", lambda p: level(part(p)) == level(F.col("term"))), "exact": F.filter("exact", lambda p: part(p) == F.col("term"))})
        found = found.filter(F.length("sought") <= HEAD).unionByName(more.select(*found.columns).filter("size(places) > 0"))
    n_found = apart(F.col("places"), F.length("term")).alias("n_found")
    n_exact = apart(F.col("exact"), F.length("term")).alias("n_exact") if ignore_case else n_found.alias("n_exact")
    return found.select("term", *keys, "places", n_found, n_exact, "n_chars")
