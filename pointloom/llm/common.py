"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.session import fresh_folder, qualified, workers_import
from pointloom.session import written as materialize

__all__ = ["BLANK", "WORD", "Recent", "append", "fresh_folder", "materialize", "new_name", "qualified", "workers_import"]

#: White space as the contracts define it: space and the five ASCII control blanks.
BLANK = r"[\x20\x09-\x0D]+"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def new_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def append(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list[pa.Array]]],
    drop: Iterable[str] = (),
    rows: int = 512,
) -> DataFrame:
    """Add columns computed from Arrow arrays, batch by batch; all other columns pass through.

    ``make()`` runs once a task and returns a function of the input arrays. A column of df that has the name of a
    new one is replaced. Output leaves in slices of ``rows`` rows, so no batch of long texts piles up.
    """
    workers_import(df.sparkSession)
    new = {f.name.lower() for f in fields}
    gone = {c.lower() for c in drop} | new
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType(kept + fields)
    keep = [f.name for f in kept]
    names = keep + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = work(*(part.column(c) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names)
        pa.default_memory_pool().release_unused()  # the worker lives on, and later tasks need other memory

    order = [c for c in df.columns if c.lower() not in gone or c in inputs]
    return df.select(*(F.col(f"`{c}`") for c in order)).mapInArrow(run, schema)


class Recent:
    """A bounded cache for keys that are asked for in sets: when full, its entries become the older half, which those in use
    outlive. Beyond its size it has the keys of one set; those longer than ``longest`` stay for that set only."""

    def __init__(self, size: int, longest: int = 64):
        self.size, self.longest = size, longest
        self.now: dict = {}
        self.older: dict = {}
        self.long: list = []

    def fill(self, keys: set, make: Callable[[list], dict]) -> dict:
        """A dictionary with the entry of each key, until the next call; make gives those of new ones."""
        for key in self.long:
            del self.now[key]
        if len(self.now) >= self.size:
            self.older, self.now = self.now, {}
        again = {key: self.older[key] for key in keys.difference(self.now) if key in self.older}
        self.now |= again
        new = list(keys.difference(self.now))
        self.now |= make(new)
        self.long = [key for key in new if len(key) > self.longest]
        return self.now
