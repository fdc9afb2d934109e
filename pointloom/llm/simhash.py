"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints that differ in at most ``max_bits`` bits agree in all but that many of ``blocks`` equal parts of their 64
bits. For every choice of parts that agree, the trie's bits are ordered so that the agreeing parts come first: walking
these leaves no error to spend, so equal values of them are one subtree, which a shuffle by that value brings together.
Below it pairs of nodes are walked together bit by bit, differing bits are summed, and a pair of nodes is dropped when
the sum exceeds the budget. With 8 parts and 3 bits a subtree holds at most 2**24 fingerprints, whatever the data.

A task returns a spanning forest of the links it finds, never all pairs of a dense group: pairs of nodes that already lie
in one component are not walked further. Equal fingerprints are one class before the join.

Defined results: a null or blank text has fingerprint zero and is linked like any other; a component is named by its
smallest doc_id, null ids apart (null when all are null); repeated rows share their class; extra columns stay; of a group
one row stays, whatever its rows repeat (``keep_one_per_group``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import append, materialize, new_name, workers_import
from pointloom.llm.graph import components

SEED = 42
#: A fingerprint or component is hot when it has more than one row in HOT.
HOT = 1000
CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles of the ASCII-lower-cased text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        parts = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        parts = [joined[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the fingerprint of each text as a signed long; no shuffle."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64), pa.int64())]

    return append(df, [text], [T.StructField(out, T.LongType())], make, drop=drop)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of a[i] and b[i] in place; true for the links that joined two trees."""
    used = np.zeros(len(a), bool)
    while True:
        ra, rb = root[a], root[b]
        open_ = np.flatnonzero(ra != rb)
        if not len(open_):
            return used
        high, low = np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_])
        tops, first = np.unique(high, return_index=True)
        root[tops] = low[first]
        used[open_[first]] = True
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def trie_links(group: np.ndarray, bits: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows of equal group whose bits differ in at most budget places.

    Rows are sorted by (group, bits); each group is a trie of ``width`` levels whose nodes are ranges of rows.
    """
    n = len(bits)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    root = np.arange(n)
    sums = [np.r_[0, np.cumsum(bits >> level & 1)] for level in range(width)]
    stack = [(width - 1, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > CHUNK:
            for at in range(0, len(a0), CHUNK):
                s = slice(at, at + CHUNK)
                stack.append((level, a0[s], a1[s], b0[s], b1[s], err[s]))
            continue
        if links:  # node pairs that lie within one component have nothing to add
            breaks = np.r_[0, np.cumsum(root[1:] != root[:-1])]
            done = (breaks[a1 - 1] == breaks[a0]) & (breaks[b1 - 1] == breaks[b0]) & (root[a0] == root[b0])
            a0, a1, b0, b1, err = (x[~done] for x in (a0, a1, b0, b1, err))
        if level < 0:
            cross = a0 != b0
            a, b = a0[cross], b0[cross]
            used = unite(root, a, b)
            if used.any():
                links.append((a[used], b[used]))
            continue
        am, bm = a1 - (sums[level][a1] - sums[level][a0]), b1 - (sums[level][b1] - sums[level][b0])
        itself = a0 == b0
        sides = (
            (a0, am, b0, bm, err, None),
            (am, a1, bm, b1, err, None),
            (a0, am, bm, b1, err + 1, None),
            (am, a1, b0, bm, err + 1, ~itself),
        )
        nodes = []
        for x0, x1, y0, y1, e, mask in sides:
            good = (x0 < x1) & (y0 < y1) & (e <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            if mask is not None:
                good &= mask
            nodes.append(tuple(v[good] for v in (x0, x1, y0, y1, e)))
        if sum(len(x[0]) for x in nodes) > CHUNK:
            stack += [(level - 1, *x) for x in reversed(nodes) if len(x[0])]
        else:
            merged = tuple(np.concatenate(c) for c in zip(*nodes, strict=True))
            if len(merged[0]):
                stack.append((level - 1, *merged))
    if not links:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])


def fingerprint_links(classes: DataFrame, max_bits: int = 3, blocks: int = 8) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) as all pairs within max_bits would."""
    spark = classes.sparkSession
    workers_import(spark)
    size = 64 // blocks
    full = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    loose = [c for c in combinations(range(blocks), max_bits)]  # the parts that may differ
    masks = [full & ~sum(((1 << size) - 1) << size * p for p in c) for c in loose]
    masks_array = np.array(masks, dtype=np.uint64)
    width = size * max_bits

    mask = F.element_at(F.array(*(F.lit(signed(m)) for m in masks)), F.col("t") + 1)
    rows = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"))
    fixed = F.col("fp").bitwiseAND(mask)
    rows = rows.repartition("t", fixed).sortWithinPartitions("t", fixed)

    def pairs(t: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        key = fp & masks_array[t]
        new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(new)
        keep = np.bincount(group)[group] > 1
        group, fp, t = group[keep], fp[keep], t[keep]
        if not len(fp):
            return None
        low = np.zeros(len(fp), np.int64)
        parts = np.array(loose)[t]
        for k in range(max_bits):
            part = fp >> (parts[:, k] * size).astype(np.uint64) & np.uint64((1 << size) - 1)
            low = low << size | part.astype(np.int64)
        order = np.lexsort((low, group))
        a, b = trie_links(group[order], low[order], width, max_bits)
        value = fp[order].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(value[a]), pa.array(value[b])], ["a", "b"]) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_fp = [], []
        for batch in batches:
            t = batch.column("t").to_numpy(zero_copy_only=False).astype(np.int64)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(t):
                continue
            key = fp & masks_array[t]
            last = np.flatnonzero((t != t[-1]) | (key != key[-1]))  # the last subtree may go on in the next batch
            cut = last[-1] + 1 if len(last) else 0
            if cut or held_t and (held_t[-1][-1] != t[0] or (held_fp[-1][-1] & masks_array[held_t[-1][-1]]) != key[0]):
                held_t.append(t[:cut])
                held_fp.append(fp[:cut])
                if out := pairs(np.concatenate(held_t), np.concatenate(held_fp)):
                    yield out
                held_t, held_fp = [], []
            held_t.append(t[cut:])
            held_fp.append(fp[cut:])
        if held_t and (out := pairs(np.concatenate(held_t), np.concatenate(held_fp))):
            yield out

    return rows.mapInArrow(run, "a long, b long").distinct()


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table, which has key once and n, the number of rows with that key.

    A key of more than 1 in HOT rows would send all of these to one task. There are fewer than HOT such keys, whatever the
    data, so they are broadcast, and only the others are dealt out.
    """
    total = rows.count()
    hot, cold = table.filter(F.col("n") * HOT > total).drop("n"), table.filter(F.col("n") * HOT <= total).drop("n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def _named(rows: DataFrame, max_bits: int) -> DataFrame:
    """rows (fp, doc_id and others) with component_id."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    links = materialize(fingerprint_links(classes.select("fp"), max_bits), "fingerprint-links")
    member = components(links)
    linked = member.join(classes.withColumnRenamed("fp", "node"), "node")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    named = looked_up(member, least, "root").select(F.col("node").alias("fp"), "component_id")
    ids = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return looked_up(rows, materialize(ids, "components"), "fp")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp (signed long) and component_id, the smallest doc_id reachable."""
    rows = with_fingerprint(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), shingle=shingle, drop=("text",))
    return _named(materialize(rows, "fingerprints"), max_bits).select("doc_id", "fp", "component_id")


def hex16(fp: str) -> F.Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one_per_group(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """One row of df for each component: that with the smallest doc_id, null ids last, and of rows that repeat it the first.

    Rows are decided one by one, so two texts of one id are not confused, and repeated rows and rows without an id are
    copies like any other. df is written with a number for each row; only fingerprints, ids and numbers meet in shuffles
    until the numbers of the rows that go are joined back.
    """
    row = new_name(df, "_row")
    whole = materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = whole.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(row).alias("row"))
    rows = materialize(with_fingerprint(rows, shingle=shingle, drop=("text",)), "fingerprints")
    # components are named by the row that stays: the order of rows is that of (no id, id, row)
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    named = _named(rows.select("fp", best.alias("doc_id"), "row"), max_bits)
    gone = named.filter(F.col("component_id.row") != F.col("row")).select(F.col("row").alias(row))
    return whole.join(gone, row, "left_anti").select(*(f"`{c}`" for c in df.columns))
