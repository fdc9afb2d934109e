"""The corpus pipeline: each stage, and the run, against a plain chain of the same five steps."""

import hashlib
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import common, langid, queries
from test_operators import brute_components, brute_fingerprint, brute_lines, library

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark, sf):
    got = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    text = got[3][1]
    got += [(900, None, "en", "src1", None), (901, "", "en", "src1", 0), (902, "12 34 !!", None, None, 8), (903, text, None, None, len(text)), (903, text, None, None, len(text)), (None, text, "en", "src2", len(text))]
    got += [(910 + k, f"{got[k][1]}\nread more on our site", got[k][2], "small", 1) for k in range(4)]
    return got


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def told(rows):
    counts: dict = {}
    for i, text, lang, *_ in rows:
        if lang is not None and text is not None and not (i is not None and __import__("zlib").crc32(str(i).encode()) % 4 == 2):
            grams, n = langid.gram_counts(text)
            counts.setdefault(lang, Counter()).update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
    ranks = {k: {g: p for p, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[: langid.TOP])} for k, c in counts.items()}
    out = []
    for r in rows:
        top = langid.top_grams(r[1]).tolist() if r[1] else []
        if top:
            far = min(sum(abs(p - k[g]) if g in k else langid.TOP for p, g in enumerate(top)) for k in ranks.values())
            if 1 - far / (langid.TOP * len(top)) >= corpus_pipeline.LEAST_SCORE:
                out.append(r)
    return out


def cut(rows):
    """Rows are numbered, since ids repeat."""
    kept = brute_lines([(k, r[3], r[1]) for k, r in enumerate(rows)], queries.MAX_RATIO, queries.PRIOR_PAGES)
    return [(r[0], t, r[2], r[3], None if t is None else len(t)) for r, (_, t) in zip(rows, kept, strict=True)]


def one_of_each(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    groups: dict = {}
    for r, root in zip(rows, brute_components(prints), strict=True):
        groups.setdefault(root, []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def mixed(rows, folder):
    """The SQL twin of op5 on these rows."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    pq.write_table(pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names), folder / "mix.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/mix.parquet')")
    copies = Counter()
    for i, lang, source, n in con.execute(queries.oracle_sql()["op5_mixing"]).fetchall():
        copies[i, lang, source] = n
    return [r for r in rows for _ in range(copies[r[0], r[2], r[3]])]


def encoded(rows):
    lib, out = library(), Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[r[0], tuple(ids), len(ids), digest(" ".join(map(str, ids))), digest(lib.decode(ids, skip_special_tokens=False))] += 1
    return out


def test_stages_and_run_equal_a_plain_chain(spark, rows, tmp_path):
    (tmp_path / "sf").mkdir()
    docs = frame(spark, rows).withColumns({"_fp": F.lit("mine"), "_boilerplate": F.lit(1), "copies": F.lit(5), "lang_pred": F.lit(3)})
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    have = [r for r in spark.read.parquet(str(tmp_path / "sf" / "documents.parquet")).collect()]
    plain = [tuple(r)[:5] for r in have]
    current = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    for name, brute in (("language_id", told), ("line_dedup", cut), ("simhash_near_dedup", one_of_each), ("mixing", lambda r: mixed(r, tmp_path))):
        out = common.materialize(stages[name](spark, current, str(tmp_path / "sf")), name)
        assert out.columns == docs.columns, name
        plain = brute(plain)
        got = out.collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(plain), name
        assert {tuple(r)[5:] for r in got} == {("mine", 1, 5, 3)}
        current = out
    want = encoded(plain)
    last = stages["bpe"](spark, current, str(tmp_path / "sf")).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == want
    run = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run) == want
    assert "read more" not in " ".join(r[1] or "" for r in plain) and re.search("[a-z]", plain[0][1])


def test_copies_on_a_small_site_leave_one_text(spark, sf, tmp_path):
    """Two exact copies on a site of 50 pages: neither is emptied, and one of them passes all filters."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    text = "\n".join(x for (x,) in docs.filter("lang = 'en'").orderBy("doc_id").select("text").limit(2).collect())
    more = spark.createDataFrame([(5000 + k, text, "en", "site-1", len(text)) for k in range(2)], COLUMNS)
    others = docs.filter("doc_id < 48").withColumn("doc_id", F.col("doc_id") + 6000).withColumn("source", F.lit("site-1"))
    docs.union(more).union(others).write.parquet(str(tmp_path / "documents.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = common.materialize(stage(spark, left, str(tmp_path)), name)
        assert {r.text for r in left.filter("doc_id in (5000, 5001)").collect()} == {text}, name
    assert [r.doc_id for r in left.filter("doc_id in (5000, 5001)").collect()] == [5000]  # mixing then weighs it like others


def test_stages_on_an_empty_table(spark, rows):
    docs = frame(spark, rows).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        assert name == "bpe" or out.columns == docs.columns
