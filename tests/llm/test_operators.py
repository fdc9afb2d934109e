"""Each operator against a plain brute-force version, and its defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import bpe, chat, common, exact, graph, langid, lines, mixing, quality, queries, simhash, substring, warc

ODD = ["", None, " ", "\n\n", "a", "Straße ſ İ Σίσυφος ΣΑΣ", "é ﬁ  x y\u0085z", "it's we'll 12,345 <|endoftext|> x<|startoftext|>",
       "\x1c\x1d tab\tq", "日本語 テキスト 😀😀", "A" * 5000, "aé" * 3000 + " end", "x\x00y", "don't DON'T 'S", "٣٤ ² ½ Ⅷ", "ǅ ǰ ŉ"]


def docs_of(spark, sf, n=None):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows[:n]]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words(text):
    return re.findall(common.WORD, text or "")


# ---- BPE

def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, sf):
    texts = ODD + [t for _, t in docs_of(spark, sf)]
    lib = library()
    out = bpe.encode_decode(frame(spark, list(enumerate(texts))), queries.vocabulary()).collect()
    assert len(out) == len(texts)
    for r in out:
        want = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want, repr(texts[r.doc_id])[:80]
        assert r.decoded == lib.decode(want, skip_special_tokens=False)


def test_bpe_fuzz():
    lib, codec, rng = library(), bpe.Codec(queries.vocabulary()), random.Random(3)
    pools = [range(32, 127), range(0, 0x250), range(0x250, 0x3000), range(0x3000, 0xD800), range(0x1F300, 0x1F700)]
    for k in range(600):
        pool = pools[: 1 + k % 5]
        text = "".join(chr(rng.choice(rng.choice(pool))) for _ in range(rng.randint(0, 80)))
        ids = np.frombuffer(codec.encode(text)[0], np.int32).tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_are_certain():
    codec = bpe.Codec(queries.vocabulary())
    assert any(len(codec.fragments("".join(map(codec.symbols.__getitem__, w.encode())))) > 1 for w in ["xqzjvk", "日本", "!!a??"])
    for word in ["hello", "zzqxj", "ÃÂ", "thththth"]:
        symbols = [codec.vocab[c] for c in word[:-1]] + [codec.vocab[word[-1] + codec.suffix]]
        assert codec.encode_word(word) == codec.merge(symbols)


def test_bpe_small_caches_and_groups(monkeypatch):
    """Texts that are looked up together, caches that turn over within them, fragments that are merged one by one."""
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "GROUP", 40)
    lib, codec, rng = library(), bpe.Codec(queries.vocabulary()), random.Random(5)
    texts = ["", "the " * 30, "ab" * 700 + " tail", "日本語" * 90, "x" * 61 + " " + "x" * 60, " \u2028 ", "<|endoftext|>", "!!a?? <|endoftext|>don't<|endoftext|>"]
    texts += ["".join(rng.choice("abct'!,é 1日\n\x1c") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    for text, (ids, decoded) in zip(texts, codec.encode_all([*texts]), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, np.int32).tolist() == want, repr(text)
        assert decoded == lib.decode(want, skip_special_tokens=False)
    assert len(codec.words.now) <= 5 + 40 and not any(len(k) > 64 for k in codec.words.older)


# ---- line dedup

def brute_lines(rows, ratio, prior):
    total, seen = Counter(), Counter()
    for host, text in {(h, t) for _, h, t in rows if h is not None and t is not None}:
        total[host] += 1
        seen.update({(host, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    bad = {k for k, n in seen.items() if n > 1 and n > (total[k[0]] + prior) * ratio}

    def cut(host, text):
        left = [x for x in text.split("\n") if (host, x.strip(" ")) not in bad]
        return "\n".join(left) if any(x.strip(" ") for x in left) else text

    return sorted((i, None if t is None else cut(h, t)) for i, h, t in rows)


def test_line_dedup(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        body = [rng.choice(["menu", " menu ", "foot", "", f"own {i}", "rare"] if rng.random() < 0.5 else [f"x{i}"]) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice(["a", "a", "a", "b", "c", None]), "\n".join(body)))
    rows += [(900, "a", None), (901, None, "menu\nmenu"), (902, "z", "menu")]
    df = frame(spark, [(*r, 1, "k") for r in rows], "doc_id long, source string, text string, _boilerplate int, _site string")
    out = lines.drop_site_lines(df, "source", "text", 0.1, 40, removed="n")
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got == brute_lines(rows, 0.1, 40) and got != brute_lines(rows, 0.1, 300)
    assert out.columns == [*df.columns, "n"]
    assert lines.drop_site_lines(df.limit(0)).count() == 0


def test_line_dedup_large_site(spark):
    """With the ratio of the queries: a line on 3 % of a large site's pages goes, one on 0.5 % stays; a small site needs no number of pages."""
    rows = [(i, "big", "\n".join([f"own {i}", *(["foot"] if i % 100 < 3 else []), *(["said again"] if i % 200 == 7 else [])])) for i in range(2000)]
    rows += [(2000 + i, "small", f"own {i}\nfoot" if i < 4 else f"own {i}") for i in range(40)]
    rows += [(3000 + i, "four", f"foot\nown {i}") for i in range(4)] + [(4000, "one", "foot\nown")]
    out = lines.drop_site_lines(frame(spark, rows, "doc_id long, source string, text string"), "source", "text", queries.MAX_RATIO, queries.PRIOR_PAGES, removed="n")
    got = {r.doc_id: (r.text, r.n) for r in out.collect()}
    want = {i: (text, 0) if site == "one" else ("\n".join(x for x in text.split("\n") if x != "foot"), text.split("\n").count("foot")) for i, site, text in rows}
    assert got == want and sum(n for _, n in got.values()) == 68


def test_line_dedup_keeps_copied_pages(spark):
    """Copies of a page are one page, whatever the site's size, and no page loses all its lines."""
    page = "first line of a page\nsecond line of it"
    rows = [(k, "small", page) for k in range(2)] + [(10 + k, "small", f"own {k}\nfoot") for k in range(48)]
    rows += [(100 + k, "copies", page) for k in range(30)] + [(200 + k, "near", f"{page}\nend {k}") for k in range(9)] + [(300, "near", page)]
    out = lines.drop_site_lines(frame(spark, rows, "doc_id long, source string, text string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert [got[k] for k in (0, 1, *range(100, 130), 300)] == [page] * 33
    assert [got[10 + k] for k in range(48)] == [f"own {k}" for k in range(48)] and [got[200 + k] for k in range(9)] == [f"end {k}" for k in range(9)]


# ---- SimHash

def brute_fingerprint(text):
    w = re.findall(common.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, far=3):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= far:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(values))]


def test_simhash(spark, sf):
    rows = docs_of(spark, sf)
    rng, base = random.Random(5), " ".join(rows[3][1].split()[:400])
    for k in range(60):  # a chain of small edits
        w = base.split()
        w[rng.randrange(len(w))] = f"new{k}"
        base = base if k % 2 else " ".join(w)
        rows.append((5000 + k, " ".join(w)))
    rows += [(6000, None), (6001, " \n"), (6002, ""), (6003, "One"), (6004, "one"), (6005, rows[0][1]), (6005, rows[0][1])]
    rows.sort()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = Counter((rows[i][0], prints[i], rows[r][0]) for i, r in enumerate(brute_components(prints)))
    out = simhash.near_duplicates(frame(spark, rows)).withColumn("hex", simhash.hex16("fp")).collect()
    assert Counter((r.doc_id, int(r.hex, 16), r.component_id) for r in out) == want
    kept = simhash.keep_one_per_group(frame(spark, [(*r, "e") for r in rows], "doc_id long, text string, fp string"))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("spread", [1, 3, 8])
def test_trie_finds_all_links(spark, spread):
    rng = random.Random(spread)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = set(centres) | {0, 1, (1 << 64) - 1}
    for _ in range(700):
        v = rng.choice(centres)
        for _ in range(rng.randint(0, spread)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    got = {}
    member = graph.components(spark.createDataFrame(links, "a long, b long") if links else spark.createDataFrame([], "a long, b long"))
    for r in member.collect():
        got.setdefault(r.root, set()).add(r.node)
    want = {}
    for i, r in enumerate(brute_components(values)):
        want.setdefault(r, set()).add(signed[i])
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


# ---- WARC

def test_warc(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(9001, None, None), (9002, "http://x/ü y\r\nz", ""), (9003, "u", rows[0][2]), (9003, "u", rows[0][2]), (9004, "v", "é" * 400_000), (9005, "w", "WARC/1.1\r\n\r\n"), (None, "n", "only"), (None, "m", rows[1][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, content int").repartition(3)
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        top = max(known) if known else None
        kind = "revisit" if top is not None and top != i else "response"
        want[(i, len(body), warc.sha1_base32(body), kind, top if kind == "revisit" else None)] += 1
    got = Counter(tuple(r) for r in warc.round_trip(spark, df).collect())
    assert got == want
    folder = common.fresh_folder(spark, "warc-test")
    full = warc.read_archives(warc.write_archives(df, folder), payload=True).filter("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in full} == {(h or "").encode() for _, _, h in rows}
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_reader_refuses_faults():
    import io

    sink = io.BytesIO()
    good = warc.record_bytes(1, "http://a", b"payload " * 50, "response", None)
    writer = warc.ArchiveWriter(sink, [good + bytes([k]) * 100 for k in range(40)])
    for _ in range(3):
        writer.add(good)
    data = sink.getvalue()
    assert list(warc.read_archive(io.BytesIO(data))) == [good] * 3
    assert warc.parse_record(good)["payload"] == b"payload " * 50
    for broken in (data[:-3], b"\0" * 8 + data[8:], data[:4]):
        with pytest.raises((ValueError, warc.zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(broken)))
    for broken in (good[:-1], good.replace(b"payload p", b"payload q", 1), good.replace(b"WARC/1.1", b"WARC/9", 1), good.replace(b"WARC-Type:", b"WARC Type", 1)):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def foreign(kind, block, more=(), version="WARC/1.1", content="application/http; msgtype=response"):
    head = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_from_elsewhere(spark, tmp_path):
    """Records of all types, responses without digest or length, encoded or cut off, with and without a dictionary."""
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    records = [
        foreign("warcinfo", b"software: x\r\n", content="application/warc-fields"), foreign("request", b"GET / HTTP/1.1\r\n\r\n", content="application/http; msgtype=request"),
        foreign("response", body, ["WARC-Target-URI: http://a/"]), foreign("response", chunked), foreign("metadata", b"", content="text/plain", version="WARC/1.0"),
        foreign("response", b"10 20", content="text/dns"), foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 50\r\n\r\nhel", ["WARC-Truncated: length", "WARC-Payload-Digest: sha1:AAAA"]),
        foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", ["WARC-Payload-Digest: sha1:" + warc.sha1_base32(b"hello")]),
        foreign("response", body, ["WARC-Payload-Digest: sha256:" + hashlib.sha256(b"hello").hexdigest(), "WARC-Block-Digest: sha1:" + warc.sha1_base32(body)]),
    ]
    plain = warc.zstandard.ZstdCompressor().compress
    (tmp_path / "plain.warc.zst").write_bytes(b"".join(plain(r) for r in records))
    with open(tmp_path / "words.warc.zst", "wb") as sink:
        writer = warc.ArchiveWriter(sink, records * 10)
        for r in records:
            writer.add(r)
    for name in ("plain", "words"):
        found = warc.found_archives(spark, str(tmp_path / f"{name}.warc.zst"))
        got = [(r.record_type, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(found, payload=True).collect()]
        hello, dns, cut = warc.sha1_base32(b"hello"), b"10 20", b"hel"
        coded = chunked.partition(b"\r\n\r\n")[2]
        assert got == [
            ("response", 5, hello, b"hello"), ("response", len(coded), warc.sha1_base32(coded), coded), ("response", 5, warc.sha1_base32(dns), dns),
            ("response", 3, warc.sha1_base32(cut), cut), ("revisit", 0, hello, None), ("response", 5, hello, b"hello"),
        ]
        others = warc.read_archives(found, kinds=("warcinfo", "request", "metadata")).collect()
        assert [(r.record_type, r.payload_bytes, r.page_id) for r in others] == [("warcinfo", 13, None), ("request", 18, None), ("metadata", 0, None)]
    for broken in (foreign("response", body, ["WARC-Payload-Digest: sha1:" + warc.sha1_base32(b"other")]), foreign("metadata", b"x", ["WARC-Block-Digest: sha1:" + warc.sha1_base32(b"y")]), foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nhello"), foreign("response", b"hello")):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


# ---- mixing

def test_mixing_takes_the_whole_supply(spark):
    """With the share of the queries: epochs of the heavier leaves fill what the lighter ones' weights leave over."""
    rows = [(k, "a b c d", "en" if k % 2 else "es", f"s{k % 4}") for k in range(400)]
    out = mixing.mix(frame(spark, rows, "doc_id long, text string, lang string, source string"), queries.tree(), mixing.word_count(F.col("text")), queries.WEIGHTS, queries.SHARE, queries.MAX_EPOCHS, queries.SEED)
    taken = sum(r.copies for r in out.collect())
    assert 396 <= taken <= 400  # each of the four leaves may end within a document


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src15", "odd", None])) for i in range(400)]
    rows += [(7, "same id again", "en", "src1"), (None, "no id", "en", "src1"), (999, None, "de", "src2")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, room int, ident string")
    weights = {"web": 3, "reference": 1, "web/en": 2, "other": 0}
    out = mixing.mix(df, queries.tree(), mixing.word_count(F.col("text")), weights, (1, 2), 3, 11).collect()
    assert len(out) == len(rows)
    total = sum(len(words(t)) for _, t, _, _ in rows)
    spent = sum(r.copies * len(words(r.text)) for r in out)
    assert spent <= total // 2 and spent > total // 2 - 31 * 15
    assert all(r.copies == 0 or r.source in ("src1", "src2", "src15") or not words(r.text) for r in out)
    assert len({r.copies for r in out if r.doc_id == 7 and r.source == "src1" and r.lang == "en"}) == 1
    assert mixing.mix(df.limit(0), queries.tree(), mixing.word_count(F.col("text")), weights).count() == 0


def test_budget_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, s string, tokens long")
    got = {r.s: r.alloc for r in mixing.shares(leaves, ["d", "s"], {}, (800, 2010), 1).collect()}
    assert got == {"x": 10, "y": 390, "z": 400}
    got = {r.s: r.alloc for r in mixing.shares(leaves, ["d", "s"], {"a": 9}, (2000, 2010), 1).collect()}
    assert got == {"x": 10, "y": 1000, "z": 990}


# ---- chat

def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] <|end|>\n<|turn:user|>\n & &amp; &lt;| [/INST]"), (1, 1, "assistant", "a<|sep|>b"), (1, 2, "assistant", None), (1, 3, "assistant", "é😀"),
            (2, 1, "user", "late"), (2, 0, "we|>ird<|x", "first"), (2, None, None, "none"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, turns int")
    out = chat.format_conversations(df)
    out = out.select("conv_id", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("texts"))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv].texts == [r[3] or "" for r in mine if r[2] == "assistant"]
    assert got[1].formatted.count("<|turn:") == 2 and "</s>" not in got[1].formatted and "[INST]" not in got[1].formatted
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- substring dedup

def brute_repeats(rows, size):
    seen = Counter()
    split = [words(t) for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = Counter()
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


@pytest.mark.parametrize("size", [5, 35])
def test_substring(spark, sf, size):
    rng = random.Random(size)
    rows = docs_of(spark, sf)
    passage = [f"p{k}" for k in range(90)]
    for k in range(60):
        a = rng.randrange(60)
        mine = passage[a : a + rng.randint(20, 80)]
        rows.append((8000 + k, " ".join([f"q{k}.{j}" for j in range(rng.randint(0, 40))] + mine + ["\n", "tail"] * rng.randint(0, 3))))
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, " ".join(["again"] * 100)), (9004, " ".join([*"abcdefghij"] * 9)), (9005, "same " * 34 + "é"), (9005, "same " * 34 + "é")]
    df = frame(spark, [(*r, 1, "c") for r in rows], "doc_id long, text string, at int, k1 string").repartition(3)
    out = substring.drop_repeats(df, window=size)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    assert got == brute_repeats(rows, size)
    assert substring.drop_repeats(frame(spark, [])).count() == 0


# ---- exact dedup

def test_exact(spark, sf):
    rows = docs_of(spark, sf) + [(1, "x  y"), (5, "x\ty"), (0, None), (3, ""), (2, " "), (None, "x y"), (None, "alone"), (5, "x y")]
    df = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, _sha int").repartition(5)
    norm = lambda t: re.sub(common.BLANK, " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t in rows:
        mine = groups[norm(t)]
        keep = min((x for x in mine if x is not None), default=None)
        want[(i, keep, len(mine), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    for budget in (exact.BUDGET, 3000):
        out = exact.exact_duplicates(df, budget=budget)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()) == want
    assert exact.exact_duplicates(df.limit(0)).count() == 0


def test_grace_spills_and_compares_content(tmp_path):
    records = [(k % 50 % 3, f"text {k % 50}", k, 1) for k in range(2000)]  # three hash values for fifty texts
    got = sorted((t, least, n) for _, t, least, n in exact.grace(iter(records), budget=1000, folder=str(tmp_path)))
    assert got == sorted((f"text {k}", k, 40) for k in range(50))
    assert not list(tmp_path.iterdir())


# ---- quality rules

def test_quality(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(frame(spark, [(7000 + k, t) for k, t in enumerate(ODD)]))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.fit_labelled(docs, labels)
    out = quality.judge(docs, trees).collect()
    for r in out:
        w = words(r.text)
        n = len(w)
        grams = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
        covered = {j for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in (r.text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        want = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * len(covered) > 20 * n)
        assert not (r.kept and r.base_failed)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(r.kept, truth[r.doc_id]) for r in out if truth.get(r.doc_id) is not None]
    assert sum(k == bool(q) for k, q in pairs) / len(pairs) > 0.9
    away = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
    unseen = quality.judge(docs, quality.fit_labelled(docs, labels.filter(~away))).filter("not base_failed")
    unseen = [(r.kept, bool(truth[r.doc_id])) for r in unseen.filter(away).collect() if truth.get(r.doc_id) is not None]
    assert len(unseen) > 10 and sum(k == q for k, q in unseen) / len(unseen) > 0.8
    assert quality.fit_labelled(docs, labels.limit(0)) is None
    assert quality.judge(docs.limit(0), None).count() == 0


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(20 * x[:, 0]) - x[:, 1] + 0.2 * rng.standard_normal(3000) > 0).astype(float)
    trees = quality.fit(x, y, np.array([1, -1, 0]))
    grid = np.linspace(0, 1, 200)
    for _ in range(20):
        row = np.repeat(rng.random((1, 3)), 200, axis=0)
        up, down = row.copy(), row.copy()
        up[:, 0], down[:, 1] = grid, grid
        assert (np.diff(trees.score(up)) >= -1e-12).all()
        assert (np.diff(trees.score(down)) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.75


# ---- language

def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.learn(docs)
    out = langid.predict(docs, profiles).withColumn("held", langid.held_out()).collect()
    for r in out:
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in out if r.held and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    odd = langid.predict(frame(spark, list(enumerate(["", None, "123 !?", "x"])), "lang_pred long, text string"), profiles).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3
    assert langid.learn(docs.limit(0)) == {}


def test_rank_distance_brute_force(spark):
    text = "the cat and the hat, the end. Ça va--O'Neil x2y"
    counts = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"_{w}_"
        counts.update(g for n in (1, 2, 3) for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != "_")
    number = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    order = [number(g) for g in sorted(counts, key=lambda g: (-counts[g], number(g)))][: langid.TOP]
    assert langid.top_grams(text).tolist() == order
    profiles = {"a": order[::-1], "b": order[5:], "c": [number("zz")]}
    want = {k: sum(abs(i - p.index(g)) if g in p else langid.TOP for i, g in enumerate(order)) for k, p in profiles.items()}
    got = langid.predict(frame(spark, [(1, text)]), profiles).first()
    best = min(want, key=lambda k: (want[k], k))
    assert got.lang_pred == best and abs(got.score - (1 - want[best] / (langid.TOP * len(order)))) < 1e-12


# ---- components

def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 1000 + k) for k in range(1, 200)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5)]
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for i in root}


# ---- SQL twins

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want.fetchall())
