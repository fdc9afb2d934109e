"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (1 to 3, words padded with _), in order. A document's most
frequent n-grams are compared with each profile by the out-of-place distance: the sum of rank differences, and the
largest possible one for an n-gram that the profile lacks. The nearest profile wins; its score is 1 - distance over the
largest possible distance.

An n-gram is one number, 21 bits a character, so that counting is sorting in numpy. Profiles are learned from a bounded
sample of labelled rows (about ``per_language`` for each language, chosen by hash of the id); predictions read whole
texts.

Defined results: null texts and texts without letters are 'und' with score 0, as are all texts when nothing was learned;
equal distances go to the language first in the alphabet; equal counts of n-grams are ordered by their numbers; extra
columns stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.maths import d
from pointloom.llm.common import append, materialize, workers_import

TOP = 300
#: Steps in which the share of a language's rows in the sample is set: fine enough for any number of rows.
SHARES = 1 << 52
PAD = ord("_")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a mark, 0 anything else."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the words of a text, ascending, and their counts; none when it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    kind = kinds()[codes]
    if not (kind == 1).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.r_[False, kind > 0, False]
    codes = np.where(inside, np.r_[PAD, codes, PAD], PAD)
    two = codes[:-1] << 21 | codes[1:]
    three = two[:-1] << 21 | codes[2:]
    found = np.concatenate([codes[inside], two[inside[:-1] | inside[1:]], three[inside[1:-1]]])
    found.sort()
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    return found[first], np.diff(np.r_[first, len(found)])


def top_grams(text: str, size: int = TOP) -> np.ndarray:
    """The most frequent n-grams, first the most frequent."""
    grams, counts = gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:size]]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = 2000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Profiles of all languages, from rows that are not held out. The driver gets TOP numbers for each language."""
    workers_import(docs.sparkSession)
    rows = docs.filter(~held_out(doc_id) & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    part = F.least(d(1.0), d(per_language) / F.count("*")) * SHARES  # a row for each language
    counts = materialize(rows.groupBy("lang").agg(part.cast("long").alias("part")), "languages")
    # rows without an id are told apart by their text
    chance = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(SHARES))
    sample = rows.join(counts, "lang").filter(chance < F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list] = {}
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts.setdefault(name, []).append(gram_counts(body))
            for name, found in parts.items():
                grams, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([f[1] for f in found]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    sums = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in sums.withColumn("place", place).filter(F.col("place") <= TOP).orderBy("lang", "place").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", drop: tuple[str, ...] = (), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (names: out); no shuffle."""

    def make():
        names = sorted(profiles)
        grams = np.concatenate([np.array(profiles[n], np.int64) for n in names]) if names else np.empty(0, np.int64)
        order = np.argsort(grams, kind="stable")
        # for each known n-gram in ascending order: a language that has it, and its rank there
        grams, owner = grams[order], np.repeat(np.arange(len(names)), [len(profiles[n]) for n in names])[order]
        ranks = np.concatenate([np.arange(len(profiles[n])) for n in names])[order] if names else grams

        def one(body: str | None) -> tuple[str, float]:
            top = top_grams(body) if body and names else ()
            if not len(top):
                return "und", 0.0
            first = np.searchsorted(grams, top, side="left")
            many = np.searchsorted(grams, top, side="right") - first
            place = np.repeat(np.arange(len(top)), many)
            at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            # n-grams that a profile lacks count TOP; known ones give back what they are nearer
            nearer = np.bincount(owner[at], TOP - np.abs(ranks[at] - place), len(names))
            best = int(nearer.argmax())
            return names[best], float(1 - (TOP * len(top) - nearer[best]) / (TOP * len(top)))

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [one(t.as_py()) for t in texts]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return work

    return append(docs, [text], [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())], make, drop=drop)
