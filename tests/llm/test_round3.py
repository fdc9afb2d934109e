"""Conversation repair, importance resampling and sharding against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pointloom.llm import importance, queries, repair, sharding
from test_operators import frame

BLANKS = " \t\n\v\f\r"


# ---- conversation repair

def brute_repair(rows):
    """rows of one conversation, damaged: every figure by a plain recursion over (row, state) with whole audits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    faults, seen, illegal = [], set(), 0
    for k, (_, role, text) in enumerate(rows):
        said = text.strip(BLANKS)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    fits = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {"u": 2, "a": 3}
    best = {}
    for i in range(len(rows), -1, -1):
        for state in range(4):
            found = []
            at, puts = state, []
            for n in range(4):
                if i == len(rows):
                    if at in (0, 3):
                        found.append((2 * n, "I" * n, tuple(puts)))
                else:
                    _, role, text = rows[i]
                    more = [("D", at, 3, ())]
                    if faults[i] not in ("blank", "duplicate"):
                        one = 1 if faults[i] == "truncated" else 0
                        more.append(("R", to[fits[at]], 2 + one, (repair.NAMES[fits[at]] + ":" + text,)))
                        if role[:1] == fits[at] or (role[:1] == "s" and at == 0):
                            more.append(("K", 1 if role[:1] == "s" else to[role[:1]], one, (role + ":" + text,)))
                    for letter, after, cost, line in more:
                        c, a, t = best[i + 1, after]
                        found.append((2 * n + cost + c, "I" * n + letter + a, (*puts, *line, *t)))
                puts.append(repair.NAMES[fits[at]] + ":")
                at = to[fits[at]]
            best[i, state] = min(found)
    cost, audit, lines = best[0, 0]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation(rng, n):
    texts = ["Yes.", "No", "", " \t", "What?", "a.\n ", "x y", " ", "Good!", "long " * 50 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "sage"]
    return [(rng.choice([None, k, k, k, k // 2, k * 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{k}.") for k in range(n)]


def repaired(spark, talks):
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return {r.conv_id: tuple(r)[1:] for r in repair.summaries(repair.repair(df)).collect()}


@pytest.mark.parametrize(("bits", "fan"), [(10, 1024), (2, 3), (0, 2)])
def test_repair(spark, monkeypatch, bits, fan):
    """Blocks of any size, folded in one or several levels, give the edits of the plain recursion."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(bits)
    talks = {c: conversation(rng, rng.randrange(1, 12)) for c in range(60)} | {None: conversation(rng, 30), 999: conversation(rng, 90)}
    got = repaired(spark, talks)
    assert got == {c: brute_repair(t) for c, t in talks.items()}


def test_repair_long_conversation(spark):
    talk = [(k, "user" if k % 2 else "assistant", f"turn {k}.") for k in range(5000)] + [(7, "user", "again and again.")] * 3000
    assert repaired(spark, {1: talk, 2: talk[:3]}) == {1: brute_repair(talk), 2: brute_repair(talk[:3])}


def test_least_paths_by_doubling():
    """Ranks of power-of-two lengths choose the least letters in any acyclic graph whose nodes have no letter twice."""
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randrange(2, 40)
        arcs = [(v, w, letter) for v in range(n - 1) for letter, w in enumerate(rng.sample(range(v + 1, n), min(n - 1 - v, rng.randrange(1, 4))), 1)]
        arcs.append((n - 1, n - 1, 0))
        tail, head, letter = (np.array(x) for x in zip(*arcs, strict=True))
        least = {n - 1: []}
        for v in range(n - 2, -1, -1):
            least[v] = min([c, *least[w]] for a, w, c in arcs if a == v)
        paths = repair.least_paths(tail, head, letter, np.arange(n))
        assert [[c for c in letter[p].tolist() if c] for p in paths] == [least[v] for v in range(n)]


def test_repair_empty_and_extra_columns(spark):
    schema = "conv_id long, turn long, role string, text string, pos string, key int"
    assert repair.summaries(repair.repair(spark.createDataFrame([], schema))).count() == 0
    got = repair.repair(spark.createDataFrame([(1, None, None, None, "x", 5)], schema)).collect()
    assert [(r.role, r.text, r.fault, r.edit, r.before, r.after) for r in got] == [(" ", " ", "blank", "D", "", "")]


def test_repair_query_with_nulls(spark, tmp_path):
    """The query against its SQL on rows with nulls, all turns null, and conversations that lose every row."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), t, r or None, x) for c in range(40) for t, r, x in conversation(rng, rng.randrange(1, 7))] + [(k, None, "user", None) for k in range(100, 160)]
    pq.write_table(pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]), tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    names = ["conv_id", *repair.SUMMARY[1:]]
    want = {r[0]: r for r in con.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op11_repair']})").fetchall()}
    got = {r[0]: tuple(r) for r in queries.op11_repair(spark, str(tmp_path)).select(names).collect()}
    assert got == want and None in got
    lost = [v for v in got.values() if v[7] == ""]
    assert lost and all(v[1:7] == (0,) * 6 and v[8] == hashlib.sha256(b"").hexdigest() for v in lost)


# ---- importance resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, ngrams):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent, least, ngrams, buckets):
    def tally(texts):
        out = [0] * buckets
        for t in texts:
            for f in brute_features(t, ngrams)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = tally([x[1] for x in docs]), tally(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for ident, text in docs:
        words, features = brute_features(text, ngrams)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(may[: len(may) * percent // 100])}
    return sorted(str((*r[:4], ranks.get(id(r)))) for r in out)


@pytest.mark.parametrize(("ngrams", "buckets"), [(1, 10_000), (3, 97)])
def test_importance(spark, sf, ngrams, buckets):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    text = docs[5][1]
    docs += [(1000, None), (1001, ""), (None, text), (5, text), (5, text), (1002, "one " * 50_000), (1003, "x" * 5000 + " é漢字 ÄÖ " * 30), (1004, "\x00\x7f-_`" * 40)]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, ""]
    df = frame(spark, [(*d, k, "z") for k, d in enumerate(docs)], "doc_id long, text string, row int, RANK string").repartition(4)
    out = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), 10, 20, ngrams, buckets)
    assert out.columns == ["doc_id", "text", "row", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in out.collect())
    assert got == brute_resample(docs, target, 10, 20, ngrams, buckets)


def test_crc_matrices():
    rng = random.Random(2)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 3, 8, 40, 1024, 1025, 3000]))) for _ in range(300)]
    words += words[:50]
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    assert importance.crc_features(data, np.cumsum(size) - size, size).tolist() == [zlib.crc32(w) for w in words]


def test_importance_empty(spark):
    none = frame(spark, [])
    assert importance.resample(none, none).count() == 0
    one = importance.resample(frame(spark, [(1, "a b c " * 20)]), none, percent=100).first()
    assert (one.n_features, one["rank"]) == (60, 1)


# ---- sharding

def brute_shards(rows, shards):
    """rows (hash, size): heavy groups apart, then the least capacity over the ordered groups, all in lists."""
    groups: dict = {}
    for h, size in rows:
        groups[h] = groups.get(h, 0) + size
    left, heavy = sum(groups.values()), []
    for h, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if shards - len(heavy) == 1 or size * (shards - len(heavy)) <= left:
            break
        heavy.append(h)
        left -= size
    light = sorted(g for g in groups.items() if g[0] not in heavy)

    def deal(capacity):
        out, now, load = {}, 0, 0
        for h, size in light:
            if size > capacity:
                return None
            if load + size > capacity:
                now, load = now + 1, 0
            load += size
            out[h] = now
        return out if now < shards - len(heavy) else None

    low, high = 0, left
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if deal(middle) is not None else (middle + 1, high)
    return {h: k for k, h in enumerate(heavy)} | {h: len(heavy) + k for h, k in (deal(low) or {}).items()}


@pytest.mark.parametrize(("coarse", "fine"), [(1 << 14, 1 << 6), (4, 2)])
def test_partition(monkeypatch, coarse, fine):
    """Bounds from sums over ranges end in the capacity and the cuts of a check over all groups."""
    monkeypatch.setattr(sharding, "COARSE", coarse)
    monkeypatch.setattr(sharding, "FINE", fine)
    rng = random.Random(coarse)
    for top in (1 << 62, 1 << 62, 5000, 40, 3):
        hashes = np.array(sorted({rng.randrange(top) for _ in range(rng.choice([1, 40, 2000]))}))
        sizes = np.array([rng.choice([8, rng.randrange(8, 3000), rng.randrange(8, 30000)]) for _ in hashes])
        for shards in (1, 2, 24):
            most = []

            def look(ranges, parts):
                found = sharding._parts(ranges, parts, hashes, sizes)
                most.append(len(found) / len(ranges))
                return found

            _, cuts = sharding.partition(look, shards, int(sizes.max()))
            want = brute_shards(list(zip(hashes.tolist(), sizes.tolist(), strict=True)), 1) if shards == 1 else None
            at = np.searchsorted(np.array(cuts, np.int64), hashes, "right")
            loads = np.bincount(at, sizes, minlength=shards)
            assert max(most) <= max(coarse, fine) and len(loads) == shards and (want is None or set(at) == {0})
            # no smaller capacity holds them
            load, used = 0, 1
            for size in sizes.tolist():
                load, used = (load + size, used) if load + size < loads.max() else (size, used + 1)
            assert used > shards or sizes.max() == loads.max()


def test_sharding(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    hot = "hot text " * 400
    docs += [(2000 + k, hot) for k in range(120)] + [(1, None), (None, ""), (7, docs[0][1]), (7, docs[0][1]), (5000, "é" * 9000)]
    df = frame(spark, [(*d, "x", k) for k, d in enumerate(docs)], "doc_id long, text string, hash string, SIZE int").repartition(4)
    out = sharding.shard(df, 24)
    assert out.columns == ["doc_id", "text", "hash", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.withColumn("h", sharding.text_hash(F.col("text"))).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(d) for d in docs)
    want = brute_shards([(r.h, r.size) for r in got], 24)
    slots: dict = {}
    for r in got:
        body = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "bytes", want[r.h], None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    alone = [r for r in got if r.shard == 0]
    assert len(alone) == 120 and {r.text for r in alone} == {hot}


def test_sharding_few_groups(spark):
    assert sharding.shard(frame(spark, []), 3).count() == 0
    same = sharding.shard(frame(spark, [(k, None if k % 2 else "") for k in range(9)]), 3).collect()
    assert len({r.shard for r in same}) == 1 and sorted(r.slot for r in same) == list(range(9))
    two = sharding.shard(frame(spark, [(1, "a"), (2, "b")]), 5).collect()
    assert len({r.shard for r in two}) == 2
