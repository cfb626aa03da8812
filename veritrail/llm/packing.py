"""Problem 6: documents into containers of fixed capacity by sum-of-squares packing.

Online: a document of size s goes to that fill level (a partially filled container, or an empty one)
whose use makes the sum of the squared counts of containers by level smallest. The counts, and for each
level the containers at it, are kept in an array indexed by level; levels are counted in steps of `grain`
tokens, as thousands of levels with a container each would leave nothing to choose between.

At scale each group of some `group_size` documents (by hash of the id) is packed for itself, which leaves
a few containers a group partly filled. The documents of containers with more than `slack` of their capacity free
are packed again in the same way, largest first, `widen` groups together, as often as it takes until one group is left, and
once more. So no task ever holds more than a group, and what is left over at the end is a few containers in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CAPACITY = 4096
GROUP_SIZE = 20_000
GRAIN = 16
SLACK = 0.02
WIDEN = 32


class SumOfSquares:
    """Open containers by fill level; put() gives the number of the container that takes an item."""

    def __init__(self, capacity: int, grain: int = GRAIN):
        self.capacity, self.grain, self.made = capacity, grain, 0
        self.levels = capacity // grain + 1
        self.count = np.zeros(self.levels + 1, np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(self.levels + 1)]

    def put(self, size: int) -> int:
        step = -(-size // self.grain)
        top = self.levels - 1 - step  # a container at a level up to here surely has room
        best, at = 2 * self.count[min(step, self.levels)] + 1, 0
        if top >= 1:
            now, then = self.count[1 : top + 1], self.count[1 + step : top + step + 1].copy()
            then[-1] = 0  # the last level is full and isn't counted
            change = np.where(now > 0, 2 * (then - now + 1), np.iinfo(np.int64).max)
            change[-1] = 1 - 2 * now[-1] if now[-1] > 0 else change[-1]
            k = top - 1 - int(np.argmin(change[::-1]))  # on ties the fullest
            if change[k] < best:
                best, at = change[k], k + 1
        if at:
            number, fill = self.open[at].pop()
            self.count[at] -= 1
        else:
            number, fill, self.made = self.made, 0, self.made + 1
        fill += size
        level = -(-fill // self.grain)
        if level < self.levels - 1:
            self.open[level].append((number, fill))
            self.count[level] += 1
        return number


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_key", "item_id", "part_no"], kind="stable")
        packer = SumOfSquares(capacity)
        pdf["container"] = [packer.put(int(s)) for s in pdf["size"]]
        fill = pdf.groupby("container")["size"].transform("sum")
        return pdf.assign(fill=fill)[["group_id", "item_id", "part_no", "part_offset", "size", "container", "fill"]]

    return run


_OUT = "group_id bigint, item_id bigint, part_no int, part_offset bigint, size int, container int, fill bigint"


def pack_items(items: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, slack: float = SLACK, widen: int = WIDEN) -> DataFrame:
    """item_id, size, and maybe cuts -> container_id (string), item_id, part_no, part_offset, size, fill (of the container).

    An item larger than the capacity, and no other, is divided: at its cuts (array of the offsets at which its parts begin,
    0 first, no part larger than the capacity), or where there are none into parts of the capacity and a rest. Offsets
    are in units of size. Items of size null, zero or less take no room and are left out. A repeated item_id counts
    once, with its largest size. Equal sizes and ties go by item_id."""
    if "cuts" not in items.columns:
        items = items.withColumn("cuts", F.lit(None).cast("array<bigint>"))
    items = items.filter("size > 0").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.max(F.struct(F.col("size").cast("bigint").alias("total"), "cuts")).alias("m")).select("item_id", "m.*")
    items = materialize(items, "sizes")
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(capacity).cast("bigint"))
    starts = F.when((F.col("total") > capacity) & F.col("cuts").isNotNull(), F.col("cuts").cast("array<bigint>")).otherwise(steps)
    parts = items.select("item_id", "total", starts.alias("starts")).select("item_id", "total", "starts", F.posexplode("starts").alias("part_no", "part_offset"))
    parts = parts.withColumn("size", (F.coalesce(F.get("starts", F.col("part_no") + 1), F.col("total")) - F.col("part_offset")).cast("int"))
    place = ("item_id", "part_no", "part_offset", "size")
    done = parts.filter(F.col("size") == capacity).select(F.concat(F.lit("w"), "item_id", F.lit("-"), "part_no").alias("container_id"), *place, F.lit(capacity).cast("bigint").alias("fill"))
    groups = max(1, -(-items.count() // group_size))
    order = F.xxhash64(F.lit(7), "item_id")
    rest, number = parts.filter(F.col("size") < capacity).select(F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("group_id"), *place), 0
    while True:
        # by number: a group is little data but much work, so groups mustn't be put together by size
        loose = rest.withColumn("order_key", order).repartition(int(min(groups, 4096)), "group_id")
        packed = materialize(loose.groupBy("group_id").applyInPandas(_pack(capacity), _OUT), "packed")
        last = groups == 1 and number > 1
        full = F.lit(True) if last else F.col("fill") >= (1 - slack) * capacity
        done = done.unionByName(packed.filter(full).select(F.concat(F.lit(f"r{number}-"), "group_id", F.lit("-"), "container").alias("container_id"), *place, "fill"))
        if last:
            return done
        groups, number, order = max(1, groups // widen), number + 1, -F.col("size").cast("bigint")
        rest = packed.filter(~full).select(F.pmod("group_id", F.lit(groups)).alias("group_id"), *place)


def byte_cuts(size: str = "size", text: str = "text", capacity: int = CAPACITY):
    """A function for mapInArrow over item_id, size, text -> item_id, size, cuts: for texts whose tokens are their UTF-8
    bytes and an end mark, the offsets of parts of at most the capacity that end at the ends of characters."""
    schema = pa.schema([("item_id", pa.int64()), ("size", pa.int64()), ("cuts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, n, content in zip(*(batch.column(c).to_pylist() for c in ("item_id", size, text))):
                raw, cuts = content.encode("utf-8", "surrogatepass"), [0]
                while n - cuts[-1] > capacity:
                    at = cuts[-1] + capacity
                    while at < len(raw) and raw[at] & 0xC0 == 0x80:
                        at -= 1
                    cuts.append(at)
                out.append((item, n, cuts))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def byte_sized(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, text, n_tokens (may be null) -> item_id, size, cuts: sizes in tokens of the ByT5 tokenizer (UTF-8 bytes and
    an end mark). A missing size is worked out from the text, and only then, or to divide it, does the text count."""
    size = F.coalesce(F.col("n_tokens").cast("bigint"), F.octet_length("text").cast("bigint") + 1)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("item_id"), size.alias("size"), "text")
    none = F.lit(None).cast("array<bigint>").alias("cuts")
    large = rows.filter((F.col("size") > capacity) & F.col("text").isNotNull()).mapInArrow(byte_cuts(capacity=capacity), "item_id bigint, size bigint, cuts array<bigint>")
    return rows.filter((F.col("size") <= capacity) | F.col("text").isNull()).select("item_id", "size", none).unionByName(large)


def _windows(capacity: int):
    schema = pa.schema([("container_id", pa.string()), ("n_parts", pa.int32()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, parts in zip(batch.column("container_id").to_pylist(), batch.column("parts").to_pylist()):
                tokens: list[int] = []
                for p in sorted(parts, key=lambda p: (p["item_id"], p["part_no"])):
                    ids = [b + 3 for b in p["content"]]
                    tokens += ids + [1] * (p["size"] - len(ids))
                out.append((key, len(parts), tokens))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def windows(packed: DataFrame, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """packed (of pack_items over byte_sized(docs)), docs (doc_id, text) -> container_id, n_parts, tokens: the token ids
    of each container (a byte's id is its value plus 3, the end mark is 1). A container holds at most the capacity, so
    nothing larger is ever collected."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("item_id"), F.encode("text", "UTF-8").alias("bytes")).dropDuplicates(["item_id"])
    content = F.expr("substring(bytes, cast(part_offset + 1 as int), size)").alias("content")
    parts = packed.join(texts, "item_id").select("container_id", F.struct("item_id", "part_no", "size", content).alias("part"))
    return parts.groupBy("container_id").agg(F.collect_list("part").alias("parts")).mapInArrow(_windows(capacity), "container_id string, n_parts int, tokens array<int>")
