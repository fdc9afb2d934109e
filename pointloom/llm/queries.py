"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, chat, exact, importance, langid, lines, mixing, quality, repair, sharding, simhash, substring, warc


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file; they are installed with the workers, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, vocabulary(), drop=("text",))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("ids")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


#: A page's own lines stand on it and its copies; what more than a hundredth of a site's pages repeat is its template.
MAX_RATIO, PRIOR_PAGES = 0.01, 300


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = lines.drop_site_lines(docs, "source", "text", MAX_RATIO, PRIOR_PAGES, removed="n_removed")
    return out.select("doc_id", "n_removed", _sha(F.coalesce("text", F.lit(""))).alias("text_sha256"))


OP2_SQL = f"""
WITH line AS (
  SELECT row, doc_id, source, content, u.line, u.pos, trim(u.line) AS said
  FROM (SELECT row_number() OVER () AS row, doc_id, source, text, md5(text) AS content FROM documents) d,
       unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, pos)),
total AS (SELECT source, count(DISTINCT md5(text)) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.said FROM line l JOIN total t ON l.source = t.source WHERE l.said <> ''
  GROUP BY l.source, l.said, t.pages
  HAVING count(DISTINCT l.content) > 1 AND count(DISTINCT l.content) > (t.pages + {PRIOR_PAGES}) * {MAX_RATIO}::double),
found AS (
  SELECT l.*, b.said IS NOT NULL AS hit FROM line l LEFT JOIN bad b ON l.source = b.source AND l.said = b.said),
marked AS (
  SELECT *, hit AND bool_or(said <> '' AND NOT hit) OVER (PARTITION BY row) AS gone FROM found)
SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY row, doc_id
UNION ALL SELECT doc_id, 0, sha256('') FROM documents WHERE text IS NULL
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS whole FROM pages),
seen AS (SELECT *, sha1(html) AS hex, whole IS NOT NULL AND page_id IS DISTINCT FROM whole AS again FROM page)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)
                   FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN whole END AS refers_to
FROM seen
"""


#: Target weights by path of the tree; siblings that are not listed weigh 1.
WEIGHTS = {"web": 6, "reference": 3, "web/en": 5, "web/de": 2, "web/fr": 2, "web/es": 1, "reference/en": 3, "reference/de": 1, "reference/fr": 1, "reference/es": 1}
SHARE, MAX_EPOCHS, SEED = (1, 1), 3, 7


def tree() -> list[tuple[str, F.Column]]:
    """Domain (by the source's number), language, source."""
    number = F.regexp_extract(F.col("source"), r"(\d+)$", 1).try_cast("int")
    domain = F.when(number < 12, "web").when(number.isNotNull(), "reference").otherwise("other")
    return [("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))]


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mix(docs, tree(), mixing.word_count(F.col("text")), WEIGHTS, SHARE, MAX_EPOCHS, SEED)
    return out.select("doc_id", "lang", "source", "copies")


def _op5_sql() -> str:
    weight = "CASE {path} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1 END"
    levels = ["domain", "lang", "source"]
    steps = [f"grant0 AS (SELECT least((sum(tokens) * {SHARE[0]}) // {SHARE[1]}, sum(cap))::HUGEINT AS budget FROM leaf)"]
    for k in range(3):
        path, up = levels[: k + 1], levels[:k]
        cols, w = ", ".join(path), weight.format(path=" || '/' || ".join(path))
        by = f"PARTITION BY {', '.join(up)} " if up else ""
        join = f"JOIN grant{k} USING ({', '.join(up)})" if up else f"CROSS JOIN grant{k}"
        steps += [
            f"node{k} AS (SELECT {cols}, sum(cap)::HUGEINT AS c, ({w})::HUGEINT AS w FROM leaf GROUP BY {cols})",
            f"sum{k} AS (SELECT *, coalesce(sum(c) OVER ({by}ORDER BY c::double / w::double, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS p, "
            f"(sum(w) OVER ({by}ORDER BY c::double / w::double, {path[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS r FROM node{k} {join})",
            f"full{k} AS (SELECT *, c * r <= w * (budget - p) AS sat FROM sum{k})",
            f"left{k} AS (SELECT *, (budget - coalesce(sum(c) FILTER (WHERE sat) OVER ({by}), 0))::HUGEINT AS rest, (sum(w) FILTER (WHERE NOT sat) OVER ({by}))::HUGEINT AS loose FROM full{k})",
            f"grant{k + 1} AS (SELECT {cols}, CASE WHEN sat THEN c ELSE (w * rest) // loose END AS budget FROM left{k})",
        ]
    return f"""
WITH doc AS (
  SELECT doc_id, lang AS l, source AS s, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS tokens,
    CASE WHEN try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT) < 12 THEN 'web'
         WHEN try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT) IS NOT NULL THEN 'reference' ELSE 'other' END AS domain
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * {MAX_EPOCHS})::HUGEINT AS cap FROM doc GROUP BY ALL),
{", ".join(steps)},
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END::BIGINT AS epochs,
         (budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens)::BIGINT AS room
  FROM leaf JOIN grant3 USING (domain, lang, source)),
run AS (
  SELECT d.*, p.epochs, p.room,
         sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')), coalesce(doc_id::VARCHAR, '')) AS run
  FROM doc d JOIN plan p USING (domain, lang, source))
SELECT doc_id, l AS lang, s AS source, epochs + CASE WHEN run <= room THEN 1 ELSE 0 END AS copies FROM run
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    kind = dict(rows.dtypes)
    extra = spark.range(2).select(
        F.lit(-1).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    out = chat.format_conversations(rows.select("conv_id", "turn", "role", "text").union(extra))
    turns, learned = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss"))
    out = out.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learned, "").alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(said).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), _sha(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
seen AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before, lead(role) OVER w AS after,
    regexp_replace(regexp_replace(regexp_replace(replace(text, '&', '&amp;'), '<(\|)', '&lt;\1', 'g'), '<(/?s>)', '&lt;\1', 'g'), '\[(/?INST\])', '&#91;\1', 'g') AS body
  FROM turn WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE WHEN before IS DISTINCT FROM role THEN length('<|turn:|>') + 1 + length(role) ELSE 0 END
      + CASE WHEN after IS DISTINCT FROM role THEN length('<|end|>') + 1 ELSE length('<|sep|>') END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id
"""


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", _sha(F.col("kept_text")).alias("kept_sha256"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit_labelled(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees, drop=("text",)).select("doc_id", *quality.STATS, "base_failed", "kept", "score")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(docs.select("doc_id", "text"), langid.learn(docs), drop=("text",))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = repair.summaries(repair.repair(repair.damage(rows)))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", _sha(F.lit(""))).alias("repaired_sha256"))


def _op11_sql() -> str:
    """The cheapest edits from the last row back, for each state of the grammar: so many inserts, then an edit of the row."""
    step = []  # state, inserts, edit, initial it needs, state after, roles of inserts and of a new role
    for state in range(4):
        at, put = state, []
        for k in range(4):
            call = repair.CALLS[at]
            lines = "".join(f"{repair.NAMES[c]}:\\n" for c in put)
            step += [(state, k, "D", "*", at, lines, ""), (state, k, "R", "*", int(repair.NEXT[at]), lines, repair.NAMES[call])]
            step += [(state, k, "K", i, int(to[at]), lines, "") for i, to in zip("sua", repair.KEEP, strict=False) if to[at] < 4]
            at, put = int(repair.NEXT[at]), [*put, call]
    rows = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"e'{x}'" for x in r) + ")" for r in step)
    ends = ", ".join(f"({s}, {c}, '{'I' * (c // 2)}', e'{t}')" for s, c, t in ((0, 0, ""), (1, 4, "user:\\nassistant:\\n"), (2, 2, "assistant:\\n"), (3, 0, "")))
    return f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
lot AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_sql_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot
  FROM conversations, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM lot, range(2) t(again) WHERE lot <> 0 AND (again = 0 OR lot = 3)),
ranked AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^ \\t-\\r]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ \\t-\\r]*\\z') AS cut,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM ranked),
step(state, k, edit, needs, after, lines, new_role) AS (VALUES {rows}),
best(conv_id, rn, state, found) AS (
  SELECT conv_id, n + 1, state, {{'cost': cost, 'audit': audit, 'lines': lines}}
  FROM (SELECT DISTINCT conv_id, n FROM ranked), (VALUES {ends}) e(state, cost, audit, lines)
  UNION ALL
  SELECT m.conv_id, m.rn, s.state, min({{
      'cost': b.found.cost + 2 * s.k + CASE s.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN s.edit <> 'D' AND m.cut THEN 1 ELSE 0 END,
      'audit': repeat('I', s.k) || s.edit || b.found.audit,
      'lines': s.lines || CASE WHEN s.edit = 'D' THEN '' ELSE CASE s.edit WHEN 'R' THEN s.new_role ELSE m.role END || ':' || m.text || chr(10) END || b.found.lines}})
  FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.rn = b.rn - 1
    JOIN step s ON s.after = b.state AND s.needs IN ('*', m.initial) AND (s.edit = 'D' OR NOT (m.blank OR m.again))
  GROUP BY m.conv_id, m.rn, s.state),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (WHERE illegal) AS illegal
  FROM marked GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(found.cost, 0)::BIGINT AS cost, coalesce(found.audit, '') AS audit,
  sha256(coalesce(left(found.lines, greatest(length(found.lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id AND b.rn = 1 AND b.state = 0
"""


#: CRC-32 in SQL: the table of bytes as one list.
CRC_TABLE = """SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)"""


def _sql_crc(text: str) -> str:
    byte = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


#: Features, buckets, the share of documents drawn, and the least words of one that may be.
NGRAMS, BUCKETS, PERCENT, MIN_WORDS, DRAW_SEED = 1, 10_000, 10, 20, 2024


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    out = importance.resample(docs, target, PERCENT, MIN_WORDS, NGRAMS, BUCKETS, DRAW_SEED, drop=("text",))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH crc AS ({CRC_TABLE}),
said AS (
  SELECT row, doc_id, target, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{{-\x7F]+')) AS word
  FROM (SELECT row_number() OVER () AS row, doc_id, text, false AS target FROM documents
        UNION ALL SELECT NULL, NULL, text, true FROM benchmark)),
hashed AS (SELECT word, {_sql_crc("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM said), crc),
feature AS (SELECT row, target, bucket FROM said JOIN hashed USING (word)),
tally AS (SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM feature GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM tally),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + {BUCKETS}) / ((s + 1)::DOUBLE * (tt + {BUCKETS}))))::BIGINT AS gain FROM tally, total),
doc AS (
  SELECT d.row, d.doc_id, count(bucket) AS n_features, coalesce(floor(sum(gain)::DOUBLE / nullif(count(bucket), 0)), 0)::BIGINT AS weight
  FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) d LEFT JOIN feature f ON f.row = d.row AND NOT f.target LEFT JOIN gain USING (bucket)
  GROUP BY d.row, d.doc_id),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{DRAW_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM doc),
placed AS (
  SELECT *, n_features >= {MIN_WORDS} AS may, count(*) FILTER (WHERE n_features >= {MIN_WORDS}) OVER () AS many,
         row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= {PERCENT} * many // 100 THEN place END AS rank FROM placed
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 24, drop=("text",)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_bpe, op2_line_dedup, op3_simhash, op4_warc, op5_mixing, op6_chat, op7_substring, op8_exact, op9_quality, op10_langid, op11_repair, op12_importance, op13_sharding)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """Operators whose results SQL can express on whole tables in reasonable time."""
    return {"op2_line_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op5_mixing": _op5_sql(), "op6_chat": OP6_SQL, "op8_exact": OP8_SQL, "op11_repair": _op11_sql(), "op12_importance": OP12_SQL}
