"""Odd tables, ties, long inputs and hot groups for each operator."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import bpe, chat, exact, langid, lines, mixing, quality, queries, simhash, substring
from test_operators import brute_components, brute_fingerprint, brute_repeats, frame, library

LONG = " ".join(f"w{k % 7919}x{k % 31}" for k in range(60_000))


# ---- BPE

def test_bpe_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "hello world", "mine", 5), (1, "hello world", "mine", 5)], "doc_id long, text string, decoded string, IDS int")
    out = bpe.encode_decode(df, queries.vocabulary())
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    want = library().encode("hello world", add_special_tokens=False).ids
    assert [r.ids for r in out.collect()] == [want, want]
    assert bpe.encode_decode(df.limit(0), queries.vocabulary()).count() == 0
    other = bpe.encode_decode(df, queries.vocabulary(), ids="a", decoded="b").first()
    assert (other["decoded"], other["IDS"], other["a"]) == ("mine", 5, want)


# ---- very long texts

def test_long_texts(spark):
    rows = [(1, LONG, "en", "src1"), (2, LONG + " end", "en", "src1"), (3, "short text of seven words only here", "en", "src1")]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string")
    cut = {r.doc_id: r.text for r in lines.drop_site_lines(df).collect()}
    assert cut == {r[0]: r[1] for r in rows}
    prints = {r.doc_id: r for r in simhash.near_duplicates(df).withColumn("hex", simhash.hex16("fp")).collect()}
    assert int(prints[1].hex, 16) == brute_fingerprint(LONG) and prints[2].component_id == 1 and prints[3].component_id == 3
    mixed = mixing.mix(df, queries.tree(), mixing.word_count(F.col("text")), {}, (1, 1), 1)
    assert {r.doc_id: r.copies for r in mixed.collect()} == {1: 1, 2: 1, 3: 1}
    told = quality.judge(df, None).filter("doc_id = 1").first()
    assert told.n_words == 60_000 and told.word_chars == len(LONG) - 59_999
    assert langid.predict(df, {"en": langid.top_grams(LONG).tolist()}).first().lang_pred == "en"
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in substring.drop_repeats(df).collect()}
    assert gone == {1: (60_000, 60_000), 2: (60_001, 60_000), 3: (7, 0)}


# ---- SimHash

def test_one_row_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (2, text), (None, text), (7, "alone and different from all the rest of these rows"), (None, None), (None, ""), (7, text)]
    df = frame(spark, [(*r, "c", 0) for r in rows], "doc_id long, text string, _fp string, _row int").repartition(3)
    out = simhash.keep_one_per_group(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    empty = got.pop((None, None), 0) + got.pop((None, ""), 0)
    assert got == {(1, text): 1, (7, rows[4][1]): 1} and empty == 1
    assert simhash.keep_one_per_group(df.limit(0)).count() == 0


def test_hot_fingerprints_are_looked_up_apart(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(30)) for _ in range(300)]
    rows = [(k, texts[k] if k < 300 else texts[k % 2]) for k in range(3000)]
    want = Counter()
    prints = [brute_fingerprint(t) for t in texts]
    root = brute_components(prints)
    least = {}
    for k, _ in rows:
        least.setdefault(root[k if k < 300 else k % 2], k)
    for k, _ in rows:
        want[(k, least[root[k if k < 300 else k % 2]])] += 1
    out = simhash.near_duplicates(frame(spark, rows).repartition(6))
    assert Counter((r.doc_id, r.component_id) for r in out.collect()) == want


# ---- chat

def chat_table(rows):
    import pyarrow as pa

    return pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int32()), "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string())})


def test_chat_ties_follow_the_sql(spark, tmp_path):
    """Equal turn numbers are ordered by what the texts say, not by their escaped forms."""
    import duckdb
    import pyarrow.parquet as pq

    said = ["[INST] z", "<s>", "<|x", "5x", "A", "Zz", "&", "é", None, "[/INST]"]
    rows = [(1, 0, "user", t) for t in said] + [(2, k % 3, random.Random(k).choice(["user", "a|b", "<s>", "assistant", None]), t) for k, t in enumerate(said * 4)]
    pq.write_table(chat_table(rows), tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    want = con.execute(queries.OP6_SQL.replace("replace(text, '&', '&amp;')", "replace(text, '&', '&amp;')"))
    columns = [c[0] for c in want.description]
    skip = columns.index("formatted_chars")  # the SQL does not escape roles, which the tables have no need of
    got = queries.op6_chat(spark, str(tmp_path)).select(columns).collect()
    assert Counter(tuple(v for k, v in enumerate(r) if k != skip) for r in got) == Counter(tuple(v for k, v in enumerate(r) if k != skip) for r in want.fetchall())


def test_chat_long_conversation(spark):
    """More turns than are summed together, in long runs of one role."""
    n = 5000
    rows = [(1, k, "assistant" if k % 1700 else "user", f"é{k} <s> &") for k in range(n)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    r = out.select("formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("texts")).first()
    assert [tuple(t) for t in r.turns] == [x[2:] for x in rows]
    assert r.texts == [x[3] for x in rows if x[2] == "assistant"]
    assert all(r.formatted[s.start : s.start + s.length] == x[3].replace("&", "&amp;").replace("<s>", "&lt;s>") for s, x in zip(r.loss, [x for x in rows if x[2] == "assistant"], strict=True))


# ---- substring dedup

def test_windows_with_equal_hashes_are_told_apart():
    """Words decide: with a hash that says the same of all windows, and with the real one, the answer is that of brute force."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        words = rng.integers(0, 3, 60).astype(np.int32)
        at = np.arange(len(words) - 4)
        seen = Counter(tuple(words[p : p + 5]) for p in at)
        want = [seen[tuple(words[p : p + 5])] > 1 for p in at]
        same = lambda w, size: np.zeros(len(w) - size + 1, np.uint64)
        few = lambda w, size: w[: len(w) - size + 1] << np.uint64(60)
        for hashed in (substring.rolling, same, few):
            assert substring.repeated_windows(words, at, 5, hashed).tolist() == want


def test_substring_many_buckets_and_batches(spark, sf):
    """A passage in a third of all documents, many buckets, and columns of odd types and clashing names."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(k, f"a{k} b{k} {passage if k % 3 == 0 else ''} c{k} " + " ".join(f"d{rng.randrange(9)}" for _ in range(60))) for k in range(400)]
    df = frame(spark, [(*r, "x", {"a": 1}, 0) for r in rows], "doc_id long, text string, batch string, rest map<string,int>, n_words int").repartition(5)
    out = substring.drop_repeats(df, window=10, bucket_bytes=1500)
    assert out.columns == ["doc_id", "text", "batch", "rest", "n_words", "n_removed", "kept_text"]
    got = out.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, 10)
    assert {(r.batch, r.rest["a"]) for r in got} == {("x", 1)} and {(r.doc_id, r.text) for r in got} == set(rows)
    only = substring.drop_repeats(frame(spark, [(t,) for _, t in rows], "text string"), window=10)
    assert only.count() == 400 and only.agg(F.sum("n_removed")).first()[0] == sum(r.n_removed for r in got)


def test_substring_rows_of_a_node_do_not_grow(spark, monkeypatch):
    """A passage in a third of all documents, batches of a few documents, and a deep tree: right results, and as many rows at
    a node whatever the number of batches."""
    most, depth = [], []
    whole = substring.settled

    def watched(rows, tree, level, kind):
        top = rows.groupBy("node").count().agg(F.max("count")).first()[0] or 0
        most.append(top)
        depth.append((tree.levels, level, tree.partitions))
        assert top <= 4 * tree.fan + 8 and (level > 1 or rows.groupBy("source").count().agg(F.max("count")).first()[0] <= tree.fan)
        return whole(rows, tree, level, kind)

    monkeypatch.setattr(substring, "settled", watched)
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    for n in (60, 480):
        rows = [(k, f"a{k} b{k} {passage if k % 3 == 0 else ''} c{k} " + " ".join(f"d{rng.randrange(5)}" for _ in range(40))) for k in range(n)]
        df = frame(spark, rows).repartition(3)
        got = substring.drop_repeats(df, window=8, bucket_bytes=n * 220 // (n // 4), batch_bytes=600, fan=5).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, 8)
    assert max(d[0] for d in depth) >= 3 and any(level == 3 for _, level, _ in depth)


def test_substring_tree_is_scaled():
    for total in (0, 1, 500 << 20, 30 << 30, 10 << 40, 100 << 40):
        tree = substring.Tree(total, substring.BUCKET_BYTES, substring.FAN)
        assert tree.fan <= substring.FAN and tree.buckets >= total / substring.BUCKET_BYTES and tree.key_bits <= 64
        assert total / substring.BATCH_BYTES / tree.buckets * tree.fan <= 3 * substring.FAN  # rows of a node
        nodes = {tree.above(tree.group(b), 1, part) for b in range(50) for part in (0, tree.parts(1) - 1)}
        assert all(0 <= v < tree.buckets for v in nodes)
        at = 1
        while at < tree.levels:
            nodes = {tree.above(v // tree.parts(at), at + 1, tree.parts(at + 1) - 1) for v in nodes}
            assert all(0 <= v < tree.buckets for v in nodes)
            at += 1
        if total:
            assert {v // tree.parts(tree.levels) for v in nodes} == {0}


def test_word_hashes_depend_on_the_word_alone():
    import zstandard

    texts = ["alpha beta\talpha", None, "", "\x0b beta  \n", "beta"]
    raw = b"\n".join([*((t or "").encode() for t in texts), b""])
    sizes = np.array([-1 if t is None else len(t.encode()) for t in texts], "<i8").tobytes()
    b = substring.Batch(sizes, zstandard.compress(raw), 3, 4)
    assert b.texts() == texts and b.starts.tolist() == [0, 3, 3, 3, 4, 5]
    a, c, d, e, f = b.hashes.tolist()
    assert a == d and c == e == f and a != c or (a == d, c == e == f)
    assert [b.plain.tobytes()[x : y - 1].decode() for x, y in zip(b.begins[:-1], b.begins[1:], strict=True)] == ["alpha", "beta", "alpha", "beta", "beta"]
    assert len({b.hashes[0], b.hashes[2]}) == 1 and len({b.hashes[1], b.hashes[3], b.hashes[4]}) == 1 and b.hashes[0] != b.hashes[1]


# ---- quality rules

def test_flattened_trees_walk_like_nested_ones():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = (x[:, 0] * x[:, 1] + 0.2 * rng.standard_normal(2000) > 0.3).astype(float)
    trees = quality.fit(x, y, np.array([1, 0, -1, 0]), trees=25)

    def walk(node, row):
        if trees.feature[node] < 0:
            return trees.value[node]
        return walk(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node], row)

    want = [1 / (1 + np.exp(-(trees.bias + sum(walk(r, row) for r in trees.roots)))) for row in x[:300]]
    assert np.allclose(trees.score(x[:300]), want, rtol=0, atol=1e-12)


def test_quality_clashing_columns(spark):
    df = spark.createDataFrame([(1, "w " * 20, "mine", 3), (2, None, "mine", 3)], "doc_id long, text string, score string, n_words int")
    out = quality.judge(df, None)
    assert out.columns == ["doc_id", "text", *quality.STATS, "base_failed", "score", "kept"]
    assert {r.doc_id: (r.n_words, r.kept, r.score) for r in out.collect()} == {1: (20, False, None), 2: (0, False, None)}


# ---- language

def test_learn_counts_plainly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    counts: dict = {}
    for r in docs.filter(~langid.held_out()).collect():
        if r.lang is not None and r.text is not None:
            grams, n = langid.gram_counts(r.text)
            counts.setdefault(r.lang, Counter()).update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
    want = {k: sorted(c, key=lambda g: (-c[g], g))[: langid.TOP] for k, c in counts.items()}
    assert langid.learn(docs) == want


def test_many_languages(spark):
    """600 languages of their own letters: all are learned, and each is told by its texts."""
    letters = [chr(0x4E00 + k) for k in range(1800)]
    rows = [(3 * k + j, "".join(letters[3 * k : 3 * k + 3]) + " " + letters[3 * k + j], f"l{k:03d}") for k in range(600) for j in range(3)]
    rows += [(None, "plain words", "zz")] * 3
    docs = frame(spark, rows, "doc_id long, text string, lang string").repartition(4)
    profiles = langid.learn(docs)
    assert len(profiles) > 595 and "zz" in profiles
    out = langid.predict(docs, profiles).filter(F.col("doc_id").isNotNull()).collect()
    assert all(r.lang_pred == r.lang for r in out if r.lang in profiles)


def test_language_ties(spark):
    profiles = {"b": langid.top_grams("hello").tolist(), "a": langid.top_grams("hello").tolist()}
    got = langid.predict(frame(spark, [(1, "hello"), (2, "xyz")]), profiles).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in got] == [("a", 1.0), ("a", 0.0)]


# ---- exact dedup

def test_exact_hot_text(spark):
    rows = [(k, "hot" if k % 3 else f"own {k}") for k in range(3000)]
    out = exact.exact_duplicates(frame(spark, rows).repartition(7)).collect()
    assert {(r.keep_id, r.group_size, r.text_sha256) for r in out if r.doc_id % 3} == {(1, 2000, hashlib.sha256(b"hot").hexdigest())}
    assert sum(r.kept for r in out) == 1001


def test_mixing_ranges_do_not_change_the_mix(spark):
    rows = [(k, "w " * (k % 9), "en", f"src{k % 3}") for k in range(300)]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string")
    take = lambda n: {r.doc_id: r.copies for r in mixing.mix(df, queries.tree(), mixing.word_count(F.col("text")), {"web": 2}, (1, 2), 2, 5, digits=n).collect()}
    assert take(1) == take(3)
