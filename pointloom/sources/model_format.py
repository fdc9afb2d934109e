"""Binary sparse models as a Spark data source that is read in pieces.

Records of images and points have lengths of their own, so a piece of a file has to know where its first record begins.
``index_files`` finds that in parallel: each piece guesses a record's begin by plausible values, walks from there to the
first record beyond its end, and the pieces' walks are then checked against each other. A piece whose guess is not where the
walk before it ended is walked again from there, so guesses cost time at most, never records; count and length of the file
are checked at the end. What reaches the driver is a row a piece.

The format ``sparse_model`` reads the pieces. It decodes the columns of the schema it is given and passes over the others
(tracks and observations above all), applies conditions on numbers of the record's head before it decodes lists, and leaves
out pieces whose ids cannot match. Conditions are an option of the read: Spark 4.1 keeps the filters that it pushed into a
Python source for one query when the same frame is used in another, which then lacks rows, so none are taken that way. Without an index a file is one piece, unless it is larger than ``piece_bytes``: then the
process that plans the read walks it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pointloom.session import qualified, workers_import
from pointloom.sources.sparse import CAMERA, IMAGE, OBSERVED, POINT, POINT_HEAD, TRACKED, parse_cameras

FORMAT = "sparse_model"
#: Bytes of a file that one task reads.
PIECE_BYTES = 32 << 20
#: Bytes that are read at once.
CHUNK = 4 << 20

IMAGE_HEAD = np.dtype([("image_id", "<i4"), ("qvec", "<f8", 4), ("tvec", "<f8", 3), ("camera_id", "<i4")])
#: By kind: schema, head of a record, its id, the list after it and that list's items.
KINDS = {"images": (IMAGE, IMAGE_HEAD, "image_id", "points2d", OBSERVED), "points": (POINT, POINT_HEAD, "point3d_id", "track", TRACKED)}


def _count_at(kind: str, data: bytes, at: int) -> int:
    """Where a record's count of items is; -1 when data ends before."""
    at += KINDS[kind][1].itemsize
    if kind == "images":
        at = data.find(b"\0", at) + 1 if at < len(data) else 0
    return at if 0 < at <= len(data) - 8 else -1


def blocks(source, kind: str, start: int, stop: int) -> Iterator[tuple[bytes, list[int], list[int], int]]:
    """Bytes, begins (and the last end), places of counts, and the last end's place in the file, for records that begin in
    start..stop. Bytes are held for CHUNK or one record."""
    item = KINDS[kind][4].itemsize
    source.seek(start)
    data, base, at, begins, counts = b"", start, 0, [], []
    while base + at < stop:
        where = _count_at(kind, data, at)
        end = where + 8 + item * int.from_bytes(data[where : where + 8], "little") if where >= 0 else -1
        if 0 <= end <= len(data):
            begins.append(at)
            counts.append(where)
            at = end
            continue
        if begins:
            yield data, [*begins, at], counts, base + at
        data, base, at, begins, counts = data[at:], base + at, 0, [], []
        more = source.read(max(CHUNK, end - at - len(data)))
        if not more:
            raise ValueError(f"a record at {base} is cut short")
        data += more
    if begins:
        yield data, [*begins, at], counts, base + at


def _unaligned(raw: np.ndarray, kind: str, at: int, n: int) -> np.ndarray:
    """Numbers that begin at each of the n bytes from at on."""
    out = np.empty(n, kind)
    width = out.itemsize
    for shift in range(min(width, n)):
        out[shift::width] = np.frombuffer(raw, kind, (n - shift + width - 1) // width, at + shift)
    return out


def _plausible(kind: str, raw: np.ndarray, n: int) -> np.ndarray:
    """Which of the first n bytes can begin a record, by its numbers. Nothing depends on this being right."""
    with np.errstate(all="ignore"):
        if kind == "points":
            numbers = [_unaligned(raw, "<f8", at, n) for at in (8, 16, 24, 35)]
            return np.all([(np.abs(v) < 1e9) & ((np.abs(v) > 1e-12) | (v == 0)) for v in numbers], axis=0) & (_unaligned(raw, "<u8", 0, n) < 1 << 48) & (_unaligned(raw, "<u8", 43, n) < 1 << 24)
        q = [_unaligned(raw, "<f8", at, n) for at in (4, 12, 20, 28)]
        t = [_unaligned(raw, "<f8", at, n) for at in (36, 44, 52)]
        return (np.abs(sum(v * v for v in q) - 1) < 1e-2) & np.all([np.abs(v) < 1e12 for v in t], axis=0) & (_unaligned(raw, "<i4", 0, n) >= 0) & (_unaligned(raw, "<i4", 60, n) >= 0)


def guess(source, kind: str, start: int, stop: int, size: int) -> int:
    """A place in start..stop where records seem to begin, -1 without one: the next few are plausible as well."""
    head = KINDS[kind][1].itemsize + 8
    for low in range(start, min(stop, size - head), CHUNK):
        n = min(CHUNK, stop - low, size - head - low)
        source.seek(low)
        raw = np.frombuffer(source.read(n + head), np.uint8)
        for at in np.flatnonzero(_plausible(kind, raw, n)).tolist():
            place, seen = low + at, 0
            while seen < 8 and place < size:
                source.seek(place)
                data = source.read(4096)
                where = _count_at(kind, data, 0)
                if where < 0 or not _plausible(kind, np.frombuffer(data, np.uint8), 1)[0]:
                    break
                place += where + 8 + KINDS[kind][4].itemsize * int.from_bytes(data[where : where + 8], "little")
                seen += 1
            if place == size or (seen == 8 and place < size):
                return low + at
    return -1


def _walk(source, kind: str, start: int, stop: int) -> tuple[int, int, int, int]:
    """Where the walk over records from start ends, their number, and their least and largest id (0, -1 without any)."""
    end, n, low, high = start, 0, 0, -1
    for data, begins, _, end in blocks(source, kind, start, stop):
        ids = _heads(kind, data, np.array(begins[:-1]))[KINDS[kind][2]]
        low, high = (int(min(ids.min(), low)), int(max(ids.max(), high))) if n else (int(ids.min()), int(ids.max()))
        n += len(ids)
    return end, n, low, high


def _heads(kind: str, data: bytes, at: np.ndarray) -> np.ndarray:
    head = KINDS[kind][1]
    return np.frombuffer(data, np.uint8)[at[:, None] + np.arange(head.itemsize)].view(head).ravel()


def index_files(spark: SparkSession, path: str, kind: str, piece_bytes: int = PIECE_BYTES) -> list[dict]:
    """Pieces of all files of a path: path, start, stop, n, low, high. One job, and one more for each piece guessed wrong."""
    workers_import(spark)
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # names, not contents
    pieces = [(qualified(spark, f["path"]), f["length"], max(8, at), min(at + piece_bytes, f["length"])) for f in sorted(found) for at in range(0, f["length"], piece_bytes)]
    if not pieces:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(place) as source:
                    start = row["start"]
                    if start > 8 and not row["known"]:
                        start = guess(source, kind, start, row["stop"], row["length"])
                    try:
                        walked = _walk(source, kind, start, row["stop"]) if 0 <= start < row["stop"] else (start, 0, 0, -1)
                    except ValueError:
                        walked, start = (-1, 0, 0, -1), -1
                    total = 0
                    if row["start"] == 8:
                        source.seek(0)
                        total = struct.unpack("<Q", source.read(8))[0]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (row["path"], row["stop"], start, *walked, total)], ["path", "stop", "start", "end", "n", "low", "high", "total"])

    def job(rows: list[tuple], known: bool) -> dict:
        dealt = spark.createDataFrame([(*r, known) for r in rows], "path string, length long, start long, stop long, known boolean").repartition(len(rows))
        walks = dealt.mapInArrow(run, "path string, stop long, start long, end long, n long, low long, high long, total long")
        return {(r["path"], r["stop"]): r for r in walks.collect()}  # a row a piece

    walks, out = job(pieces, False), []
    expected, n, total, before = 8, 0, 0, None
    for place, length, _, stop in [*pieces, (None, 0, 0, 0)]:
        if place != before:
            if before is not None and (expected != size or n != total):
                raise ValueError(f"{before}: {n} records in {expected} of {size} bytes, {total} announced")
            expected, n, before, size = 8, 0, place, length
            total = walks[place, stop]["total"] if place else 0
        if place is None or expected >= stop:
            continue  # a record goes on over the whole piece
        walk = walks[place, stop]
        if walk["start"] != expected:
            walk = job([(place, length, expected, stop)], True)[place, stop]
            if walk["end"] < 0:
                raise ValueError(f"{place}: a record at or after {expected} is cut short")
        out.append({"path": place, "start": expected, "stop": stop, "n": walk["n"], "low": walk["low"], "high": walk["high"]})
        expected, n = walk["end"], n + walk["n"]
    return out


class Piece(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


#: Conditions on numbers of a record's head.
TESTS = {
    "=": lambda v, x: v == x, ">": lambda v, x: v > x, ">=": lambda v, x: v >= x, "<": lambda v, x: v < x, "<=": lambda v, x: v <= x, "in": lambda v, x: np.isin(v, list(x)),
}
#: Whether ids of low..high can meet one.
REACHES = {
    "=": lambda low, high, x: low <= x <= high, ">": lambda low, high, x: high > x, ">=": lambda low, high, x: high >= x,
    "<": lambda low, high, x: low < x, "<=": lambda low, high, x: low <= x, "in": lambda low, high, x: any(low <= i <= high for i in x),
}


class ModelReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.kind, self.path, self.schema = options["kind"], options.get("path"), schema
        self.pieces = json.loads(options["pieces"]) if "pieces" in options else None
        self.piece_bytes = int(options.get("piece_bytes", PIECE_BYTES))
        self.tests = [tuple(t) for t in json.loads(options.get("where", "[]"))]
        for column, test, _ in self.tests:
            if self.kind not in KINDS or test not in TESTS or column not in KINDS[self.kind][1].names or KINDS[self.kind][1][column].shape:
                raise ValueError(f"no condition {test} on {column} of {self.kind}")

    def partitions(self) -> list[Piece]:
        if self.kind == "cameras" or self.pieces is None:
            return list(self._planned())
        ident = KINDS[self.kind][2]
        return [Piece(p["path"], p["start"], p["stop"]) for p in self.pieces if p["n"] and all(REACHES[test](p["low"], p["high"], value) for column, test, value in self.tests if column == ident)]

    def _planned(self) -> Iterator[Piece]:
        for path in json.loads(self.path) if self.path.startswith("[") else [self.path]:
            store, place = fs.FileSystem.from_uri(path)
            size = store.get_file_info(place).size
            if size is None:
                raise FileNotFoundError(path)
            if self.kind == "cameras" or size <= self.piece_bytes:
                yield Piece(path, 8, size)
                continue
            with store.open_input_file(place) as source:
                at = 8
                for stop in range(self.piece_bytes, size + self.piece_bytes, self.piece_bytes):
                    if at < min(stop, size):
                        yield Piece(path, at, min(stop, size))
                        at = _walk(source, self.kind, at, min(stop, size))[0]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition of a read that has none
            return
        arrow = to_arrow_schema(self.schema)
        store, place = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(place) as source:
            if self.kind == "cameras":
                rows = [{c: r[c] for c in arrow.names} for r in parse_cameras(source.read())]
                yield pa.RecordBatch.from_pylist(rows, arrow)
                return
            for data, begins, counts, _ in blocks(source, self.kind, partition.start, partition.stop):
                made = self._decoded(data, np.array(begins[:-1]), np.array(counts), arrow)
                if made.num_rows:
                    yield made

    def _decoded(self, data: bytes, at: np.ndarray, counts: np.ndarray, arrow: pa.Schema) -> pa.RecordBatch:
        _, _, _, items, kind = KINDS[self.kind]
        heads, keep = _heads(self.kind, data, at), np.ones(len(at), bool)
        for column, test, value in self.tests:
            keep &= TESTS[test](heads[column], value)
        heads, at, counts = heads[keep], at[keep], counts[keep]
        columns = []
        for field in arrow:
            if field.name == items:
                columns.append(self._lists(data, counts, kind, field.type))
            elif field.name == "name":
                first = IMAGE_HEAD.itemsize
                columns.append(pa.array([data[a + first : c - 1].decode() for a, c in zip(at.tolist(), counts.tolist(), strict=True)], field.type))
            elif heads.dtype[field.name].shape:
                width = heads.dtype[field.name].shape[0]
                ends = pa.array(np.arange(0, len(heads) * width + 1, width), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(heads[field.name].ravel())).cast(field.type))
            else:
                columns.append(pa.array(heads[field.name]).cast(field.type))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def _lists(self, data: bytes, counts: np.ndarray, kind: np.dtype, target: pa.DataType) -> pa.Array:
        raw = np.frombuffer(data, np.uint8)
        n = raw[counts[:, None] + np.arange(8)].view("<u8").ravel().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(counts + 8 - ends[:-1] * kind.itemsize, n) + np.arange(ends[-1]) * kind.itemsize
        flat = raw[place[:, None] + np.arange(kind.itemsize)].view(kind).ravel()
        inner = target.value_type
        struct_ = pa.StructArray.from_arrays([pa.array(flat[inner.field(i).name]).cast(inner.field(i).type) for i in range(inner.num_fields)], fields=list(inner))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct_)


class ModelSource(DataSource):
    """Options: kind (cameras, images, points), path, pieces as ``index_files`` gives them, and where, a list of conditions
    [column, one of TESTS, value]; the last two as JSON."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return CAMERA if self.options["kind"] == "cameras" else KINDS[self.options["kind"]][0]

    def reader(self, schema: StructType) -> ModelReader:
        return ModelReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    workers_import(spark)
    spark.dataSource.register(ModelSource)


def read_pieces(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, piece_bytes: int = PIECE_BYTES, where: list[tuple] = ()) -> DataFrame:
    """Records of all files of a path that meet all conditions (column, one of TESTS, value); only the named columns are decoded."""
    register(spark)
    schema = KINDS[kind][0]
    if columns is not None:
        schema = StructType([schema[c] for c in columns])
    pieces = index_files(spark, path, kind, piece_bytes)
    return spark.read.format(FORMAT).schema(schema).options(kind=kind, pieces=json.dumps(pieces), where=json.dumps(list(where))).load()
