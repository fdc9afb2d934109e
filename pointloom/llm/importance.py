"""Importance resampling of documents towards a target distribution, on hashed word features.

Features are runs of 1 to ``ngrams`` consecutive words; a bucket is a feature's CRC-32 modulo ``buckets``. A bucket's gain
is the floored log ratio of its smoothed shares in the target and in the corpus; a document's weight is the floored mean of
its features' gains. Weight plus seeded Gumbel noise is the score, and the documents of the highest scores are the sample.

CRCs are made in matrices: distinct feature bytes of equal length are rows of one uint8 matrix, whose columns are folded
in one after the other for all rows; results go back to their features by index. Lengths above ``LONGEST``, where a matrix
has hardly a row, are folded by zlib, feature by feature. Each task sums its buckets before the one small shuffle; what
reaches the driver, and goes to each task again, is one number a bucket. Ranks come from range partitions.

Defined results: a null text has no words, a document without words weight 0; a null id is '' in the noise and comes first
among ties; rows that repeat an id are drawn each for itself; an empty corpus or target counts zero in every bucket; extra
columns stay, except those that have the name of a new one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import append, materialize, new_name, workers_import
from pointloom.operators.views import global_index

#: Bytes of features that are folded at once.
CHUNK = 4 << 20
#: Features of more bytes are no matrix rows.
LONGEST = 1024


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def _word_bytes() -> np.ndarray:
    """0 for bytes outside words, else the byte in lower case; every byte of a character beyond ASCII is a word's."""
    out = np.zeros(256, np.uint8)
    for low, high, shift in ((48, 58, 0), (65, 91, 32), (97, 123, 0), (128, 256, 0)):
        out[low:high] = np.arange(low, high) + shift
    return out


CRC, LOWER = _crc_table(), _word_bytes()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = CRC[(crc ^ column) & 255] ^ crc >> 8
    return ~crc


def crc_features(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices data[start:start + length], distinct ones once."""
    out = np.empty(len(start), np.uint32)
    at = 0
    ends = np.cumsum(length)
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = length[at:stop]
        offsets = np.concatenate([[0], np.cumsum(n)])
        flat = data[np.repeat(start[at:stop] - offsets[:-1], n) + np.arange(offsets[-1])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        _, where, values = coded.dictionary.buffers()
        where = np.frombuffer(where, np.int64)[: len(coded.dictionary) + 1]
        values, size = np.frombuffer(values, np.uint8), np.diff(where)
        crc = np.empty(len(size), np.uint32)
        order = np.argsort(size, kind="stable")
        lengths, first = np.unique(size[order], return_index=True)
        for width, group in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
            if width > LONGEST:
                crc[group] = [zlib.crc32(values[where[g] : where[g + 1]]) for g in group]
            else:
                crc[group] = crc_matrix(values[where[group][:, None] + np.arange(width)])
        out[at:stop] = crc[np.asarray(coded.indices)]
        at = stop
    return out


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of some CHUNK bytes; a longer text is one by itself."""
    texts = texts.cast(pa.large_string())
    ends = np.cumsum(np.asarray(pc.binary_length(texts.fill_null(""))))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def feature_buckets(texts: pa.Array, ngrams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length, the buckets of its features, text after text, and how many each text has."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")]).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    low = LOWER[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body else np.empty(0, np.uint8)
    edges = np.unique(offsets - offsets[0])
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[edges[:-1]] = inside[edges[:-1]]
    ends[edges[1:] - 1] = inside[edges[1:] - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    # all words in a row, a space after each: a run of words is a slice of it
    spaced = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[inside]
    counts = np.diff(np.searchsorted(start, offsets - offsets[0]))
    for n in range(1, ngrams + 1):
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(size))  # words from this one to the text's end
        first = np.flatnonzero(left >= n)
        last = first + n - 1
        crc = crc_features(spaced, at[first], at[last] + size[last] - at[first])
        yield (crc % np.uint32(buckets)).astype(np.int64), np.maximum(counts - n + 1, 0)


def bucket_counts(df: DataFrame, text: str = "text", ngrams: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""
    workers_import(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                for found, _ in feature_buckets(piece, ngrams, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket, from bucket counts; ``buckets`` rows reach the driver."""
    spark = corpus.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = materialize(both.select("bucket", "s", "t"), "gains")
    whole = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    above = (F.col("t") + 1).cast("double") * F.lit(float(whole["s"] + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(whole["t"] + buckets))
    rows = both.select("bucket", F.floor(F.log(above / below) * 1000).cast("long").alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return out


def weigh(df: DataFrame, gains: np.ndarray, text: str = "text", ngrams: int = 1, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with n_words, n_features and weight."""
    buckets = len(gains)

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            words, features, sums = [], [], []
            for piece in _pieces(texts):
                n_features, total = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
                for k, (found, counts) in enumerate(feature_buckets(piece, ngrams, buckets)):
                    if k == 0:
                        words.append(counts)
                    ends = np.cumsum(counts)
                    running = np.concatenate([[0], np.cumsum(gains[found])])
                    total += running[ends] - running[ends - counts]
                    n_features += counts
                features.append(n_features)
                sums.append(total)
            words, features, sums = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, features, sums))
            return [pa.array(words), pa.array(features), pa.array(sums // np.maximum(features, 1))]

        return work

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return append(df, [text], fields, make, drop)


def gumbel(ident: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(F.log(-F.log(u)) * -1000).cast("long")


def draw(df: DataFrame, score: str, percent: int, eligible: Column, ties: list[str], rank: str = "rank") -> DataFrame:
    """df with the rank of the drawn rows, null for others: the highest ``percent`` of eligible rows' scores, floored.

    df is read three times: write it out first.
    """
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() != rank)).alias("row"), eligible.alias("may"), (-F.col(f"`{score}`")).alias("far"), *(F.col(f"`{c}`").alias(f"tie{k}") for k, c in enumerate(ties)))
    may = whole.filter("may")
    least = may.count() * percent // 100
    placed = global_index(may, ["far", *(f"tie{k}" for k in range(len(ties)))], "place")
    drawn = placed.select("row.*", F.when(F.col("place") < least, F.col("place") + 1).cast("long").alias(rank))
    return drawn.unionByName(whole.filter("NOT coalesce(may, false)").select("row.*", F.lit(None).cast("long").alias(rank)))


def resample(
    df: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    ngrams: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df with n_words, n_features, weight, score and rank; every row stays, those not drawn without a rank."""
    gains = bucket_gains(bucket_counts(df, text, ngrams, buckets), bucket_counts(target, target_text, ngrams, buckets), buckets)
    scored = weigh(df, gains, text, ngrams, drop)
    noise = new_name(scored, "_noise")
    scored = scored.withColumn(noise, gumbel(F.col(f"`{doc_id}`"), seed)).withColumn("score", F.col("weight") + F.col(noise)).drop(noise)
    scored = materialize(scored, "importance")
    return draw(scored, "score", percent, F.col("n_words") >= min_words, [doc_id, "weight", "n_features", "n_words"])
