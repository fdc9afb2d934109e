"""Sharding by bytes: a minimax contiguous partition of ordered groups of equal texts.

Groups are atomic and ordered: those heavier than a fair share of what is left come first, each a shard by itself, the
others follow by a 62-bit hash of their text (texts of equal hash are one group, which does no harm). The smallest capacity
that lets the shards hold the groups is found by binary search; a greedy check fills shard after shard. Cuts are hashes, so
a row finds its shard by comparing its own hash with them: no join, and the rows of a heavy group stay where they are.

The check needs sums of sizes at the cuts only. The driver holds sums over ranges of hashes, never the groups: at each step
a check that may cut only between ranges bounds the capacity from above, one that may cut inside an unresolved range bounds
it from below, and the ranges where a cut can lie between the two are split into at most ``FINE`` parts by one job over the
written group sizes. It ends when all cuts lie at single groups: the result is that of a check over all groups.

Defined results: a null text is '' (8 bytes); shards are numbered in the groups' order, and some are empty when there are
fewer groups than shards; slots count from 0 in each shard by hash and doc_id (null ids first); rows repeated in full take
slots next to each other; an empty table gives no rows; extra columns stay, except those that have the name of a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialize, workers_import
from pointloom.operators.views import global_index

#: Hashes are below 1 << BITS.
BITS = 62
#: Ranges of the first look, and parts that a range of hashes is split into later.
COARSE, FINE = 1 << 14, 1 << 6

#: Sums over at most so many parts of each of the ranges [a, b), as _parts gives them.
Look = Callable[[np.ndarray, int], np.ndarray]


def text_hash(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")).cast("binary")), 64 - BITS)


def _parts(ranges: np.ndarray, parts: int, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows first hash, hash after the last, bytes, groups for the parts of ranges (rows a, b in order) that have any."""
    a, b = ranges.T
    shift = np.array([max(0, (int(w) - 1).bit_length() - (parts.bit_length() - 1)) for w in b - a], np.int64)
    k = np.maximum(np.searchsorted(a, hashes, "right") - 1, 0)
    inside = (hashes >= a[k]) & (hashes < b[k])
    k, hashes = k[inside], hashes[inside]
    first, one, where, n = np.unique((hashes - a[k] >> shift[k] << shift[k]) + a[k], return_index=True, return_inverse=True, return_counts=True)
    size = np.zeros(len(first), np.int64)
    np.add.at(size, where, sizes[inside])
    return np.stack([first, np.minimum(first + (np.int64(1) << shift[k[one]]), b[k[one]]), size, n], axis=1)


def looker(groups: DataFrame) -> Look:
    """groups: hash, bytes. One job for all ranges; at most parts rows a range reach the driver."""
    workers_import(groups.sparkSession)

    def look(ranges: np.ndarray, parts: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _parts(ranges, parts, np.asarray(batch.column(0)), np.asarray(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], ["first", "end", "bytes", "n"])

        sums = groups.select("hash", "bytes").mapInArrow(run, "first long, end long, bytes long, n long")
        return np.array(sums.groupBy("first", "end").agg(F.sum("bytes"), F.sum("n")).collect(), np.int64).reshape(-1, 4)

    return look


class Sums:
    """Known sums over ranges of hashes, in order; a range of one group is resolved."""

    def __init__(self, look: Look):
        self.look = look
        self._take(look(np.array([[0, 1 << BITS]]), COARSE))

    def _take(self, rows: np.ndarray) -> None:
        self.rows = rows[np.argsort(rows[:, 0])]
        self.first, _, self.bytes, self.groups = self.rows.T
        self.before = np.concatenate([[0], np.cumsum(self.bytes)])
        self.total = int(self.before[-1])

    def split(self, which: np.ndarray) -> None:
        """Look closer at the ranges of these numbers."""
        closer = self.look(self.rows[which, :2], FINE)
        self._take(np.concatenate([np.delete(self.rows, which, axis=0), closer]))

    def above(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts at known ranges' starts: the range where each shard ends; None when they do not reach the end."""
        at, cuts = 0, []
        for _ in range(shards):
            at = int(np.searchsorted(self.before, self.before[at] + capacity, "right")) - 1
            cuts.append(at)
        return cuts if at == len(self.first) else None

    def below(self, capacity: int, shards: int) -> list[int] | None:
        """The furthest range where each shard can end if unresolved ranges could be cut anywhere."""
        at, cuts = 0, []
        for _ in range(shards):
            at = min(at + capacity, self.total)
            k = int(np.searchsorted(self.before, at, "right")) - 1
            if k < len(self.first) and self.groups[k] == 1:
                at = int(self.before[k])
            cuts.append(k)
        return cuts if at == self.total else None


def _least(fits: Callable[[int], bool], low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def partition(look: Look, shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the hash where each shard but the first begins. largest: bytes of the largest group."""
    sums = Sums(look)
    while True:
        start = max(largest, -(-sums.total // shards))
        high = _least(lambda c: sums.above(c, shards) is not None, start, sums.total)
        low = _least(lambda c: sums.below(c, shards) is not None, start, high)
        near, far = _nearest(sums, low, shards), sums.below(high, shards)
        touched = np.unique(np.concatenate([np.arange(i, min(j + 1, len(sums.first))) for i, j in zip(near, far, strict=False)]))
        unresolved = touched[sums.groups[touched] > 1]
        if not len(unresolved):
            return high, [int(np.append(sums.first, 1 << BITS)[k]) for k in sums.above(high, shards)[:-1]]
        sums.split(unresolved)


def _nearest(sums: Sums, capacity: int, shards: int) -> list[int]:
    """The nearest range where each shard can end, up to the first that cannot leave its range."""
    at, cuts = 0, []
    for _ in range(shards):
        to = int(np.searchsorted(sums.before, sums.before[at] + capacity, "right")) - 1
        cuts.append(to)
        if to == at:
            break
        at = to
    return cuts


def plan(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Hashes of groups that are a shard each, and the hashes where the shards after the first light one begin."""
    largest = [(r["bytes"], r["hash"]) for r in groups.orderBy(F.desc("bytes"), "hash").limit(shards).select("bytes", "hash").collect()]
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy: list[int] = []
    for size, key in largest:
        if shards - len(heavy) == 1 or size * (shards - len(heavy)) <= left:
            break
        heavy.append(key)
        left -= size
    if not left:
        return heavy, []
    light = groups.filter(~F.col("hash").isin(heavy)) if heavy else groups
    return heavy, partition(looker(light), shards - len(heavy), max(s for s, k in largest if k not in heavy))[1]


def shard(df: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with size, text_crc32, law, shard, slot and grown_shard (null: the law is not one of keys)."""
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new and c not in drop]
    rows = df.select(F.struct(*keep).alias("row"), F.col(f"`{doc_id}`").alias("id"), text_hash(body).alias("hash"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("crc"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("hash").agg(F.sum("size").alias("bytes")), "groups")
    heavy, cuts = plan(groups, shards)
    place = F.lit(len(heavy)) + sum(((F.col("hash") >= c).cast("int") for c in cuts), F.lit(0))
    for k, key in enumerate(heavy):
        place = F.when(F.col("hash") == key, F.lit(k)).otherwise(place)
    placed = global_index(rows.withColumn("shard", place.cast("int")), ["shard", "hash", "id"], "place")
    begins = materialize(placed, "placed")
    starts = begins.groupBy("shard").agg(F.min("place").alias("start"))
    out = begins.join(F.broadcast(starts), "shard")  # a row a shard
    return out.select(
        "row.*", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
