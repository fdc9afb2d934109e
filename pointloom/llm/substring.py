"""Substring deduplication with fixed-block anchors.

Texts are cut into non-overlapping reference blocks of (window + 1) // 2 words, which are indexed; any window of
``window`` words holds one whole block. Every rolling window of a block's length probes the index. A block that is indexed
and stands in two places or more is an anchor wherever it stands; both copies of a repeat hold one, since each holds a
block that the other probes. An anchor is extended to all full windows around it. These windows travel as the words they
consist of and are equal when their words are: hashes deal them out and bring them side by side, they decide nothing. The
union of windows that stand in two places is the maximal repeat, and all its words go.

Documents are packed into batches of about ``BATCH_BYTES`` and written once. Each batch reduces its probes to distinct
hashes, and its windows to distinct stretches of words, before a shuffle: a passage in a third of all documents leaves a
batch once. Probes and windows meet in buckets whose number follows the size of the corpus (``bucket_bytes`` of text for
each), so a bucket holds as much at any size. Batches do not send to all buckets but up a tree: a node takes the rows of
about ``fan`` batches or nodes below for a part of all hashes, makes them distinct, and sends them on to as many nodes, each
for a finer part, until one node has a bucket of the whole corpus; answers come down the same way. Thus neither a bucket gets
a row from each batch that holds a passage, nor a batch has a row for each bucket. A stretch is a run of windows that share the least hash of a few neighbouring
words: equal windows share it, too, and meet in its bucket. Answers are bits, in an order that the batch makes again.

Defined results: null texts have no words; texts shorter than a window lose nothing; repeated rows are copies of each
other; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import materialize, workers_import
from pointloom.session import TASK_BYTES

#: Text of documents packed together; a longer document is a batch of its own.
BATCH_BYTES = 6 << 20
#: Text for each bucket of probes and windows.
BUCKET_BYTES = 12 << 20
#: Buckets of the smallest corpora, so that no core is idle.
LEAST_BUCKETS = 8
#: Nodes below one, and buckets that it sends to: up to as many buckets, batches send to them directly.
FAN = 256
#: Partitions up to which each bucket has its own.
OWN_PARTITIONS = 1024
#: Least bits of a block's hash: the upper ones choose its bucket, the lower 32 tell it from others there.
KEY_BITS = 43
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


#: For each byte: whether it parts words.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def rolling(words: np.ndarray, size: int, base: int = FIRST) -> np.ndarray:
    """Hash of each run of size words; runs that would pass the end are left out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(base)
        out += words[k : k + n]
    return mixed(out)


def least_of(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of size values, by doubling."""
    have = 1
    while 2 * have <= size:
        h, have = np.minimum(h[: len(h) - have], h[have:]), 2 * have
    rest = size - have
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def bits_of(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def powers(n: int, known: list[np.ndarray] = [np.empty(0, np.uint64)] * 2) -> list[np.ndarray]:  # noqa: B006
    """The first n powers of a multiplier modulo 2**64 and of its inverse, kept for the next batch."""
    if len(known[0]) < n:
        for k, base in enumerate((SECOND, pow(SECOND, -1, 1 << 64))):
            known[k] = np.full(n, base, np.uint64)
            known[k][:1] = 1
            np.cumprod(known[k], out=known[k])
    return [p[:n] for p in known]


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word raw[begin:end]: a polynomial of its bytes modulo 2**64, from sums over all bytes."""
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(up * (raw + np.uint8(1)), out=total[1:])  # no byte of UTF-8 is 255
    return mixed((total[end] - total[begin]) * down[begin])


def ordered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys below 2**bits, and the keys in it. Places share a number with the keys where they fit."""
    low = max(1, (len(keys) - 1).bit_length())
    if bits + low > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = np.sort(keys << np.uint64(low) | np.arange(len(keys), dtype=np.uint64))
    return (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return first, np.diff(np.r_[first, len(keys)])


def scaled(key: np.ndarray, n: int) -> np.ndarray:
    """Keys of 32 bits as buckets 0 to n - 1, in the order of the keys."""
    return (key.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Tree:
    """The nodes between batches and buckets. Those of level k are numbered by a group of batches and one of fan**k parts of
    all keys; the last level has a single group, so its nodes are the buckets."""

    def __init__(self, total: int, bucket_bytes: int, fan: int):
        wanted = max(LEAST_BUCKETS, -(-total // bucket_bytes))
        self.levels = next(k for k in range(1, 64) if fan**k >= wanted)
        self.fan = next(f for f in range(max(2, int(wanted ** (1 / self.levels)) - 1), wanted + 1) if f**self.levels >= wanted)
        self.buckets = self.fan**self.levels
        self.partitions = min(self.buckets, max(OWN_PARTITIONS, -(-total // TASK_BYTES)))
        self.key_bits = max(KEY_BITS, 32 + (self.buckets - 1).bit_length())

    def parts(self, level: int) -> int:
        return self.fan**level

    def group(self, batch: int) -> int:
        return int(mixed(np.array([batch], np.uint64))[0] % np.uint64(self.buckets))

    def above(self, group: int, level: int, part: int) -> int:
        """The node of a level for a part of the keys; group is that of a batch, or of a node of the level below."""
        return group // self.fan * self.parts(level) + part

    def dealt(self, rows: DataFrame, *order: str) -> DataFrame:
        where = (F.col("node") * self.partitions / self.buckets).cast("int")
        return rows.repartitionById(self.partitions, where).sortWithinPartitions("node", *order)


class Batch:
    """Words of the documents packed in one row, and what is computed from them alike in each step.

    plain has all words, a space after each; word k is plain[begins[k] : begins[k + 1] - 1].
    """

    def __init__(self, sizes: bytes, texts: bytes, window: int, buckets: int, key_bits: int = KEY_BITS):
        self.raw, self.key_bits = zstandard.decompress(texts), key_bits
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets
        self.sizes = np.frombuffer(sizes, "<i8")
        ends = np.cumsum(np.maximum(self.sizes, 0) + 1)  # a text ends in a line break of its own
        raw = np.frombuffer(self.raw, np.uint8)
        blank = BLANK[raw]
        before, after = np.r_[True, blank[:-1]], np.r_[blank[1:], True]
        begin, end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        self.hashes = word_hashes(raw, begin, end)
        self.plain = np.where(blank, np.uint8(0x20), raw)[~blank | ~before]
        self.begins = np.r_[0, np.cumsum(end - begin + 1)]
        self.starts = np.r_[0, np.searchsorted(begin, ends)]
        self.ends = ends - 1
        n = len(begin)
        doc = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        self.place = np.arange(n) - self.starts[doc]
        self.left = self.starts[doc + 1] - np.arange(n)
        self.long = (np.diff(self.starts) >= window)[doc]

    def __len__(self) -> int:
        return len(self.hashes)

    def texts(self) -> list[str | None]:
        return [None if n < 0 else self.raw[e - n : e].decode() for n, e in zip(self.sizes.tolist(), self.ends.tolist(), strict=True)]

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of rolling blocks in documents of a window or more, in the order of their hashes; the distinct hashes
        (key_bits bits), where each one's run begins, and how long it is."""
        at = np.flatnonzero(self.long & (self.left >= self.block))
        order, keys = ordered(rolling(self.hashes, self.block)[at] >> np.uint64(64 - self.key_bits), self.key_bits)
        first, counts = runs(keys)
        return at[order], keys[first], first, counts

    def cuts(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of ascending hashes, and where each bucket's run begins and the last ends."""
        bucket = scaled(known >> np.uint64(self.key_bits - 32), self.buckets)
        first, _ = runs(bucket)
        return bucket[first], np.r_[first, len(bucket)]

    def windows(self, anchored: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Stretches of windows around anchors: first window, number of windows, number among distinct ones; the distinct
        ones as words joined by spaces, their order by key, and their keys. anchored: (bucket, bits) of the answers."""
        at, known, _, counts = self.probes()
        names, edges = self.cuts(known)
        hot = np.zeros(len(known), bool)
        for a in anchored:
            k = int(np.searchsorted(names, a["bucket"]))
            hot[edges[k] : edges[k + 1]] = bits_of(a["bits"], edges[k + 1] - edges[k])
        mine = at[np.repeat(hot, counts)]
        edge = np.bincount(np.maximum(mine - (self.window - self.block), mine - self.place[mine]), minlength=len(self) + 1)
        edge[mine + 1] -= 1
        wanted = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.window))
        few = max(1, self.window // 4)
        least = least_of(rolling(self.hashes, few, SECOND), self.window - few + 1)[wanted] if len(wanted) else np.empty(0, np.uint64)
        new = np.r_[True, (np.diff(wanted) > 1) | (self.place[wanted[1:]] == 0) | (least[1:] != least[:-1])] if len(wanted) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        first, count = wanted[begin], np.diff(np.r_[begin, len(wanted)])
        plain = self.plain.tobytes()
        distinct: dict[bytes, int] = {}
        numbers = np.array([distinct.setdefault(plain[a:b], len(distinct)) for a, b in zip(self.begins[first].tolist(), (self.begins[first + count + self.window - 1] - 1).tolist(), strict=True)], np.int64)
        key = np.empty(len(distinct), np.uint64)
        key[numbers] = least[begin]
        key &= np.uint64(0xFFFFFFFF)  # the upper bits are small in a least hash
        texts = list(distinct)
        plainly = key.tolist()
        order = np.array(sorted(range(len(texts)), key=lambda k: (plainly[k], texts[k])), np.int64)
        return first, count, numbers, texts, order, key.astype("<u4")


def pack(df: DataFrame, text: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Batches: batch, bytes, sizes (-1: null) and the compressed texts of its documents, a line break after each, and their
    other columns in rest."""
    others = [F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(0).alias("none")]
    rows = df.select(F.struct(*others).alias("rest"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sizes", T.BinaryType()), T.StructField("texts", T.BinaryType()), T.StructField("rest", T.ArrayType(rows.schema["rest"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, packer = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        raws: list[bytes] = []
        sizes: list[int] = []
        parts: list[pa.Array] = []
        total = 0

        def full() -> pa.RecordBatch:
            rest = pa.concat_arrays(parts)
            columns = [pa.array([number], pa.int64()), pa.array([total], pa.int64()), pa.array([np.array(sizes, "<i8").tobytes()]), pa.array([packer.compress(b"\n".join([*raws, b""]))]), pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest)]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            rest, start = batch.column("rest"), 0
            for i, t in enumerate(batch.column("text")):
                raw = t.as_py().encode() if t.is_valid else None
                sizes.append(-1 if raw is None else len(raw))
                raws.append(raw or b"")
                total += len(raw or b"")
                if total > batch_bytes or len(sizes) >= 1 << 16:
                    parts.append(rest.slice(start, i + 1 - start))
                    yield full()
                    number, start, total, raws, sizes, parts = number + 1, i + 1, 0, [], [], []
            if start < batch.num_rows:
                parts.append(rest.slice(start))
        if sizes:
            yield full()

    return rows.mapInArrow(run, schema)


#: What goes up: to a node, from a source (a batch, or a node of the level below).
RISING = "node long, source long, keys binary, flags binary, texts binary"


def table_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def risen(rows: list[tuple]) -> pa.RecordBatch:
    return table_of(rows, ["node", "source", "keys", "flags", "texts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])


def answered(rows: list[tuple]) -> pa.RecordBatch:
    return table_of(rows, ["source", "part", "bits"], [pa.int64(), pa.int64(), pa.binary()])


def each_node(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one node after the other, from rows sorted by node."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["node"] != held[0]["node"]:
                yield held[0]["node"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["node"], held


def settled(rows: DataFrame, tree: Tree, level: int, kind: Probes | Stretches) -> DataFrame:
    """For each source the bits that the buckets say of its keys, by part of the keys; parts without a set bit are left out."""
    parts = tree.parts(level)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, held in each_node(batches):
            yield answered([(row["source"], node, np.packbits(bits).tobytes()) for row, bits in zip(held, kind.settle(held), strict=True) if bits.any()])

    def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, held in each_node(batches):
            up = lambda part, node=node: tree.above(node // parts, level + 1, part)
            yield risen(kind.rows(kind.merged(held), node, up, tree, level + 1))

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, held in each_node(batches):
            said, below = [r for r in held if r["bits"] is not None], [r for r in held if r["bits"] is None]
            if said:
                found = kind.spread(kind.merged(below), said, below, tree, level + 1)
                yield answered([(row["source"], node % parts, np.packbits(bits).tobytes()) for row, bits in zip(below, found, strict=True) if bits.any()])

    if level == tree.levels:
        return tree.dealt(rows).mapInArrow(last, "source long, part long, bits binary")
    rows = materialize(rows, "level")
    above = settled(tree.dealt(rows).mapInArrow(rise, RISING), tree, level + 1, kind)
    both = above.withColumnRenamed("source", "node").unionByName(rows, allowMissingColumns=True)
    return tree.dealt(both).mapInArrow(fall, "source long, part long, bits binary")


def answers(rows: DataFrame, tree: Tree, kind: Probes | Stretches, out: str) -> DataFrame:
    """For each batch the (bucket, bits) of its rows."""
    found = settled(rows, tree, 1, kind).withColumnRenamed("source", "batch")
    return found.groupBy("batch").agg(F.collect_list(F.struct(F.col("part").alias("bucket"), "bits")).alias(out))


class Probes:
    """Hashes of blocks, ascending, with two flags each: indexed, and in two places. Before the last level they have 64 bits."""

    def __init__(self, key_bits: int):
        self.key_bits = key_bits

    def rows(self, merged: tuple, source: int, up: Callable[[int], int], tree: Tree, level: int) -> list[tuple]:
        """A row for each part of the keys at a level that has some."""
        keys, indexed, many = merged
        first, sizes, parts = self.cut(keys, tree, level)
        kept = keys.astype("<u4" if level == tree.levels else "<u8")  # the bucket tells the rest
        spans = zip(parts.tolist(), first.tolist(), (first + sizes).tolist(), strict=True)
        return [(up(k), source, kept[x:y].tobytes(), np.packbits(np.r_[indexed[x:y], many[x:y]]).tobytes(), None) for k, x, y in spans]

    def cut(self, keys: np.ndarray, tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = scaled(keys >> np.uint64(self.key_bits - 32), tree.parts(level))
        first, sizes = runs(part)
        return first, sizes, part[first]

    def taken(self, held: list[dict], kind: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        hashes = [np.frombuffer(r["keys"], kind) for r in held]
        flags = [bits_of(r["flags"], 2 * len(h)) for r, h in zip(held, hashes, strict=True)]
        return hashes, *(np.concatenate([f[k * len(h) : (k + 1) * len(h)] for f, h in zip(flags, hashes, strict=True)]) for k in (0, 1))

    def merged(self, held: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, indexed, many = self.taken(held, "<u8")
        order, keys = ordered(np.concatenate(hashes), self.key_bits)
        first, count = runs(keys)
        return keys[first], np.logical_or.reduceat(indexed[order], first), np.logical_or.reduceat(many[order], first) | (count > 1)

    def spread(self, merged: tuple, said: list[dict], below: list[dict], tree: Tree, level: int) -> Iterator[np.ndarray]:
        """What was said of the merged keys, for each row that they came from."""
        first, sizes, parts = self.cut(merged[0], tree, level)
        good = np.zeros(len(merged[0]), bool)
        for r in said:
            k = int(np.searchsorted(parts, r["part"]))
            good[first[k] : first[k] + sizes[k]] = bits_of(r["bits"], sizes[k])
        return (good[np.searchsorted(merged[0], np.frombuffer(r["keys"], "<u8"))] for r in below)

    def settle(self, held: list[dict]) -> list[np.ndarray]:
        """Which hashes of each row are indexed somewhere and stand in two places or more."""
        hashes, indexed, many = self.taken(held, "<u4")
        order, keys = ordered(np.concatenate(hashes).astype(np.uint64), 32)
        first, count = runs(keys)
        good = np.logical_or.reduceat(indexed[order], first) & (np.logical_or.reduceat(many[order], first) | (count > 1))
        out = np.empty(len(order), bool)
        out[order] = np.repeat(good, count)
        return np.split(out, np.cumsum(list(map(len, hashes)))[:-1])


class Stretches:
    """Runs of windows as words joined by spaces, in the order of their keys, with a flag each: in two places."""

    def __init__(self, window: int):
        self.window = window

    def rows(self, merged: tuple, source: int, up: Callable[[int], int], tree: Tree, level: int) -> list[tuple]:
        keys, texts, many = merged
        first, sizes, parts = self.cut(keys, tree, level)
        packer = zstandard.ZstdCompressor(level=1)
        spans = zip(parts.tolist(), first.tolist(), (first + sizes).tolist(), strict=True)
        return [(up(k), source, None if level == tree.levels else keys[x:y].tobytes(), np.packbits(many[x:y]).tobytes(), packer.compress(b"\n".join(texts[x:y]))) for k, x, y in spans]

    def cut(self, keys: np.ndarray, tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = scaled(keys, tree.parts(level))
        first, sizes = runs(part)
        return first, sizes, part[first]

    def merged(self, held: list[dict]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        seen: dict[tuple[int, bytes], bool] = {}
        for r in held:
            texts = zstandard.decompress(r["texts"]).split(b"\n")
            for key, many in zip(zip(np.frombuffer(r["keys"], "<u4").tolist(), texts, strict=True), bits_of(r["flags"], len(texts)).tolist(), strict=True):
                seen[key] = many or key in seen
        order = sorted(seen)
        return np.array([k for k, _ in order], "<u4"), [t for _, t in order], np.array([seen[k] for k in order], bool)

    def many(self, texts: list[bytes]) -> np.ndarray:
        """Windows of each stretch."""
        return np.fromiter((t.count(b" ") for t in texts), np.int64, len(texts)) + (2 - self.window)

    def spread(self, merged: tuple, said: list[dict], below: list[dict], tree: Tree, level: int) -> Iterator[np.ndarray]:
        keys, texts, _ = merged
        first, sizes, parts = self.cut(keys, tree, level)
        edges = np.r_[0, np.cumsum(self.many(texts))]
        good = np.zeros(edges[-1], bool)
        for r in said:
            k = int(np.searchsorted(parts, r["part"]))
            x, y = edges[first[k]], edges[first[k] + sizes[k]]
            good[x:y] = bits_of(r["bits"], y - x)
        place = {t: (edges[k], edges[k + 1]) for k, t in enumerate(texts)}
        return (np.concatenate([good[slice(*place[t])] for t in zstandard.decompress(r["texts"]).split(b"\n")]) for r in below)

    def settle(self, held: list[dict]) -> list[np.ndarray]:
        return settle_windows(held, self.window)


def repeated_windows(words: np.ndarray, at: np.ndarray, window: int, hashed: Callable[..., np.ndarray] = rolling) -> np.ndarray:
    """Whether the window at each place has the same words (numbers) as another one."""
    spare = max(1, (len(at) - 1).bit_length())
    order, h = ordered(hashed(words.astype(np.uint64), window)[at] >> np.uint64(spare), 64 - spare)
    at = at[order]
    same = h[1:] == h[:-1]
    pair = np.flatnonzero(same)
    equal = np.ones(len(pair), bool)
    for k in range(window):
        equal &= words[at[pair] + k] == words[at[pair + 1] + k]
    again = np.zeros(len(at), bool)
    again[pair[equal]] = again[pair[equal] + 1] = True
    if not equal.all():  # other words with an equal hash: compare all windows of such a hash
        group = np.cumsum(np.r_[0, ~same])
        mine = np.flatnonzero(np.isin(group, group[pair[~equal]]))
        _, which, counts = np.unique(words[at[mine][:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
        again[mine] = counts[which] > 1
    out = np.empty(len(at), bool)
    out[order] = again
    return out


def settle_windows(held: list[dict], window: int) -> list[np.ndarray]:
    """Which windows of each row's stretches stand in two places or more, stretch after stretch. Words are compared."""
    known: dict[bytes, int] = {}
    numbers, counts = [], []
    for r in held:
        mine = np.array([known.setdefault(x, len(known)) for x in zstandard.decompress(r["texts"]).split(b"\n")], np.int64)
        numbers.append(mine)
        counts.append(1 + bits_of(r["flags"], len(mine)))
    times = np.bincount(np.concatenate(numbers), np.concatenate(counts), len(known))
    vocabulary: dict[bytes, int] = {}
    lines = [x.split() for x in known]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    words = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for line in lines for w in line), np.int32, sizes.sum())
    del lines, known
    begins = np.cumsum(sizes) - sizes
    many = sizes - window + 1
    ends = np.cumsum(many)
    at = np.arange(ends[-1]) + np.repeat(begins - ends + many, many)
    again = repeated_windows(words, at, window) | np.repeat(times > 1, many)
    out = []
    for mine in numbers:
        n = many[mine]
        out.append(again[np.arange(n.sum()) + np.repeat(ends[mine] - many[mine] - np.cumsum(n) + n, n)])
    return out


def drop_repeats(df: DataFrame, text: str = "text", window: int = 35, bucket_bytes: int = BUCKET_BYTES, kept: str = "kept_text", batch_bytes: int = BATCH_BYTES, fan: int = FAN) -> DataFrame:
    """df with n_words, n_removed and ``kept``, the words that stay joined by one space."""
    workers_import(df.sparkSession)
    packed = materialize(pack(df, text, batch_bytes), "packed")
    tree = Tree(packed.agg(F.sum("bytes")).first()[0] or 0, bucket_bytes, fan)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Batch]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch, i, Batch(batch.column("sizes")[i].as_py(), batch.column("texts")[i].as_py(), window, tree.parts(1), tree.key_bits)

    rolled, stretched = Probes(tree.key_bits), Stretches(window)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, b in unpacked(batches):
            at, known, first, counts = b.probes()
            indexed = np.logical_or.reduceat(b.place[at] % b.block == 0, first) if len(first) else np.empty(0, bool)
            source = batch.column("batch")[i].as_py()
            up = lambda part, group=tree.group(source): tree.above(group, 1, part)
            yield risen(rolled.rows((known, indexed, counts > 1), source, up, tree, 1))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, b in unpacked(batches):
            _, _, numbers, texts, order, key = b.windows(batch.column("anchors")[i].as_py())
            many = np.bincount(numbers, minlength=len(texts)) > 1
            source = batch.column("batch")[i].as_py()
            up = lambda part, group=tree.group(source): tree.above(group, 1, part)
            yield risen(stretched.rows((key[order], [texts[k] for k in order.tolist()], many[order]), source, up, tree, 1))

    anchors = materialize(answers(packed.select("batch", "sizes", "texts").mapInArrow(probes, RISING), tree, rolled, "anchors"), "anchors")
    dealt = packed.repartition(tree.partitions, "batch")
    anchored = dealt.join(anchors.repartition(tree.partitions, "batch").hint("shuffle_hash"), "batch")
    spans = answers(anchored.select("batch", "sizes", "texts", "anchors").mapInArrow(stretches, RISING), tree, stretched, "spans")
    found = dealt.join(anchors.repartition(tree.partitions, "batch").hint("shuffle_hash"), "batch", "left").join(spans.repartition(tree.partitions, "batch").hint("shuffle_hash"), "batch", "left")

    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(kept, T.StringType())]
    names = {f.name.lower() for f in new}
    stay = [f for f in df.schema.fields if f.name.lower() not in names]

    def gone(b: Batch, anchored: list, answered: list) -> np.ndarray:
        """Whether each word of a batch goes."""
        first, count, numbers, texts, order, key = b.windows(anchored)
        many = np.zeros(len(texts), np.int64)
        many[numbers] = count
        offset = np.zeros(len(texts), np.int64)  # of a distinct stretch's windows, in the order of the answers
        offset[order] = np.cumsum(many[order]) - many[order]
        again = np.zeros(int(many.sum()), bool)
        parts = scaled(key[order], b.buckets)
        for a in answered:
            x, y = np.searchsorted(parts, a["bucket"], "left"), np.searchsorted(parts, a["bucket"], "right")
            start, size = offset[order[x]], int(many[order[x:y]].sum())
            again[start : start + size] = bits_of(a["bits"], size)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = (np.repeat(first, count) + step)[again[np.repeat(offset[numbers], count) + step]]
        edge = np.zeros(len(b) + 1, np.int64)
        edge[starts] += 1
        edge[starts + window] -= 1
        return np.cumsum(edge[:-1]) > 0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, b in unpacked(batches):
            anchored, answered = (batch.column(c)[i].as_py() for c in ("anchors", "spans"))
            drop = gone(b, anchored, answered) if anchored and answered else np.zeros(len(b), bool)
            removed = np.diff(np.r_[0, np.cumsum(drop)][b.starts])
            wide = np.diff(b.begins) * ~drop
            rest_bytes = b.plain[np.repeat(~drop, np.diff(b.begins))].tobytes()
            edges = np.r_[0, np.cumsum(wide)][b.starts].tolist()
            texts = [rest_bytes[x : max(x, y - 1)].decode() for x, y in zip(edges[:-1], edges[1:], strict=True)]
            rest = batch.column("rest")[i].values
            plain = pa.array(b.texts(), pa.string())
            columns = [plain if f.name == text else rest.field(f.name) for f in stay]
            whole = pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(b.starts)), pa.array(removed), pa.array(texts, pa.string())], [*(f.name for f in stay), *(f.name for f in new)])
            for k in range(0, whole.num_rows, 512):
                yield whole.slice(k, 512)

    return found.select("sizes", "texts", "rest", "anchors", "spans").mapInArrow(finish, T.StructType([*stay, *new]))
