"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents; the last one
returns token ids. Decisions are made on the stage's own input.

Defined results, stage by stage: columns beyond those of documents stay, whatever their names (the last stage returns its
own); an empty table stays empty; repeated rows are decided each for itself until near-duplicates leave one of them.
Documents with a null or letterless text have no language and go in the first stage; a null lang or source is a level
named '' in the mix, and pages without a source have no site whose lines could repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, common, langid, lines, mixing, queries, simhash

#: A document is rejected when its language is 'und' or its score is lower.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language; profiles are learned from the labelled ones. Without any, all go."""
    told, score = (common.new_name(docs, f"_{c}") for c in ("told", "score"))
    known = langid.predict(docs, langid.learn(docs), out=(told, score))
    return known.filter((F.col(told) != "und") & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that much of a source repeats; n_chars follows the text. Documents stay, and keep a line at least."""
    out = lines.drop_site_lines(docs, "source", "text", queries.MAX_RATIO, queries.PRIOR_PAGES)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; documents without an id come last."""
    return simhash.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights; one that is taken for several epochs has as many rows."""
    copies = common.new_name(docs, "_copies")
    out = mixing.mix(docs, queries.tree(), mixing.word_count(F.col("text")), queries.WEIGHTS, queries.SHARE, queries.MAX_EPOCHS, queries.SEED, copies=copies)
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return out.filter(F.col(copies) > 0).withColumn(copies, one).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and digests of them and of the text decoded from them."""
    out = bpe.encode_decode(docs.select("doc_id", "text"), queries.vocabulary(), drop=("text",))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Fingerprint components, learned profiles and BPE are beyond SQL; tests/llm/test_pipeline.py holds the stages and the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
