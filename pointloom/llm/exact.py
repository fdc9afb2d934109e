"""Exact deduplication by Grace hashing.

Each input partition first combines its own copies, so that a text that makes up a third of all rows leaves a partition
once. A shuffle by hash is the first partitioning. In a task, records fill an open-addressing table that compares the
complete text; if they outgrow ``budget`` bytes, all records are dealt to spill files by further hash bits, file by file,
again and again, until each bucket fits. Spill files are local to a task, gone when it ends, and made anew if it is rerun.

Defined results: null is an empty text; the smallest doc_id stays, null ids apart (null when a group has no other);
rows that repeat the id that stays share its decision; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import sys
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pointloom.llm.common import materialize, new_name, workers_import

FANOUT_BITS = 4
#: Bytes of texts a table may hold.
BUDGET = 96 << 20


class Table:
    """Open addressing with linear probing; a slot holds the number of an entry, compared by hash and complete text."""

    def __init__(self, bits: int = 12):
        self.slots = np.full(1 << bits, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[str] = []
        self.least: list = []
        self.counts: list[int] = []
        self.bytes = 0

    def _slot(self, h: int, text: str | None) -> int:
        mask, slots = len(self.slots) - 1, self.slots
        at = h & mask
        while (entry := slots[at]) >= 0 and not (text is not None and self.hashes[entry] == h and self.texts[entry] == text):
            at = at + 1 & mask
        return at

    def add(self, h: int, text: str, least, count: int) -> None:
        at = self._slot(h, text)
        if (entry := self.slots[at]) >= 0:
            self.counts[entry] += count
            if least is not None and (self.least[entry] is None or least < self.least[entry]):
                self.least[entry] = least
            return
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.least.append(least)
        self.counts.append(count)
        self.bytes += sys.getsizeof(text) + 150  # characters beyond Latin-1 take two or four bytes each
        if 2 * len(self.texts) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for number, known in enumerate(self.hashes):
                self.slots[self._slot(known, None)] = number

    def entries(self) -> Iterator[tuple]:
        return zip(self.hashes, self.texts, self.least, self.counts, strict=True)


def grace(records: Iterator[tuple], budget: int = BUDGET, depth: int = 0, folder: str | None = None) -> Iterator[tuple]:
    """(hash, text, least, count) with equal texts combined; spills by hash bits when they outgrow the budget."""
    table = Table()
    for record in records:
        table.add(*record)
        if table.bytes > budget and len(table.texts) > 1 and depth * FANOUT_BITS < 56:
            break
    else:
        yield from table.entries()
        return
    with tempfile.TemporaryDirectory(dir=folder) as own:
        paths = [os.path.join(own, f"{k}") for k in range(1 << FANOUT_BITS)]
        files = [open(p, "wb") for p in paths]  # noqa: SIM115
        try:
            shift, mask = 60 - depth * FANOUT_BITS, (1 << FANOUT_BITS) - 1
            for source in (table.entries(), records):
                for record in source:
                    pickle.dump(record, files[record[0] >> shift & mask], protocol=5)
                table = None
        finally:
            for f in files:
                f.close()
        for p in paths:
            yield from grace(_load(p), budget, depth + 1, own)
            os.unlink(p)


def _load(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while f.peek(1):
            yield pickle.load(f)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "least", "n")), strict=True):
            yield row[0] & 0xFFFFFFFFFFFFFFFF, *row[1:]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def normalised(text: Column) -> Column:
    """Each run of ASCII blanks as one space; runs that are a single space already are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size."""
    workers_import(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("text"))
    arrow = to_arrow_type(df.schema[doc_id].dataType)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(table.entries())
            for at in range(0, len(found), 512):
                h, t, least, n = zip(*found[at : at + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([_signed(x) for x in h], pa.int64()), pa.array(t, pa.string()), pa.array(least, arrow), pa.array(n, pa.int64())], ["h", "text", "least", "n"])

        for batch in batches:
            ids = batch.column("doc_id")
            for i, t in enumerate(batch.column("text")):
                body = t.as_py()
                table.add(xxhash.xxh64_intdigest(body), body, ids[i].as_py(), 1)
                if table.bytes > budget // 2:
                    yield from flush()
                    table = Table()
        yield from flush()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            digest, least, n = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(least, arrow), pa.array(n, pa.int64())], ["text_sha256", "keep_id", "group_size"])

        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None  # where Spark itself spills
        for _, body, least, n in grace(_records(batches), budget, 0, spill):
            out.append((hashlib.sha256(body.encode()).hexdigest(), least, n))
            if len(out) == 4096:
                yield batch()
                out.clear()
        if out:
            yield batch()

    dealt = rows.mapInArrow(combine, f"h long, text string, least {kind}, n long").repartition("h")
    return dealt.mapInArrow(final, f"text_sha256 string, keep_id {kind}, group_size long")


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """df with text_sha256, keep_id, group_size and kept; every row stays."""
    many = materialize(groups(df, doc_id, text, budget).filter("group_size > 1"), "copies")
    sha, kept_id, size, digest = (new_name(df, f"_{c}") for c in ("sha", "keep", "size", "digest"))
    many = many.toDF(sha, kept_id, size)
    ident = F.col(f"`{doc_id}`")
    new = {"text_sha256", "keep_id", "group_size", "kept"}
    rows = df.withColumn(digest, F.sha2(normalised(F.col(f"`{text}`")).cast("binary"), 256))
    keep = F.when(F.col(sha).isNull(), ident).otherwise(F.col(kept_id))
    return rows.join(many, F.col(digest) == F.col(sha), "left").select(
        *(F.col(f"`{c}`") for c in df.columns if c.lower() not in new),
        F.col(digest).alias("text_sha256"), keep.alias("keep_id"),
        F.coalesce(F.col(size), F.lit(1).cast("long")).alias("group_size"), ident.eqNullSafe(keep).alias("kept"),
    )
