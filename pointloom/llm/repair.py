"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(system? (user assistant)+)?``.

A row is blank, a duplicate of an earlier row, truncated, or sound. It is kept (cost 0), given the role that fits (2) or
deleted (3; blank and duplicate rows have to be); empty turns are inserted anywhere (2); a truncated row that stays adds 1.
Of the cheapest edits those count whose initials D, I, K, R, in order, are ASCII-least.

A cost DP runs over nodes (rows consumed, state of the grammar), from the end. The arcs of cheapest paths are then ranked by
their least audits of 1, 2, 4, ... letters: a rank of twice the length is the pair of an arc's rank and that of the arc its
pointer leads to, and the pointers double. No two arcs of a node have a letter in common, so an arc's pointer is the one
that ranks least at its head. Ranks choose the first arc, and the doubled pointers spell the path.

Rows are put in order by ranges and cut into blocks of at most ``BLOCK`` rows, so a conversation of any length is spread:
its blocks give costs from each state to each, these are folded from the end in groups of at most ``FAN`` (in levels when
there are more blocks), and the least paths' exits are folded from the start. A conversation in one block takes the same
way without a fold. Duplicates are found by the least position of each (conversation, role, text), a partial aggregate.

Defined results: null roles and texts are one space; null turns come first; rows of equal turn are in the order of role and
text; rows without a conversation id are a conversation of their own; an empty table gives no rows. The output has its own
columns: other columns of the input are not read. Texts of any length are carried, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialize, workers_import

BLOCK_BITS = 10
#: Blocks of a conversation that one group folds.
FAN = 1024
#: Cells (blocks times the rows of the longest) that are ranked at once.
CELLS = 1 << 17

# fixed values: states of the grammar are 0 start, 1 after a system turn, 2 after a user turn, 3 after an assistant turn
NEXT = np.array([2, 2, 3, 2])  # the state after the turn that fits
CALLS = "uuau"  # the initial of that turn
# the state after a kept row by its initial (s, u, a, other) and the state before; 4: it does not fit
KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
FINAL = np.array([0, 4, 2, 0])  # cost of the turns that are still to come after the last row
INSERT, REROLE, DELETE = 2, 2, 3
NAMES = {"u": "user", "a": "assistant"}
EDITS = ["pos", "fault", "edit", "new_role", "before", "after"]
LETTERS = np.array(list("-DIKR"))
NEVER = 1 << 40
# bits of a row's code above the two of its initial
BLANK, TRUNCATED, DUPLICATE = 4, 8, 16


def backward(code: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs (layer, state, end) of blocks of rows; a block of n rows has n + 1 layers. ends: (block, state, end)."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    sizes, exits = n[order], offsets[1:] + np.arange(len(n))
    cost = np.empty((len(code) + len(n), *ends.shape[1:]), np.int64)
    cost[exits] = ends
    after = ends[order]
    for j in range(1, int(n.max(initial=0)) + 1):
        active = int(np.searchsorted(-sizes, -j, "right"))
        blocks, after = order[:active], after[:active]
        c = code[offsets[blocks + 1] - j]
        stays = np.where(c & (BLANK | DUPLICATE), NEVER, c // TRUNCATED & 1)[:, None, None]
        open_ended = np.concatenate([after, np.full_like(after[:, :1], NEVER)], axis=1)
        kept = np.take_along_axis(open_ended, KEEP[c & 3][:, :, None], axis=1)
        now = np.minimum(after + DELETE, np.minimum(kept, after[:, NEXT] + REROLE) + stays)
        for _ in range(3):
            now = np.minimum(now, now[:, NEXT] + INSERT)
        after = np.minimum(now, NEVER)
        cost[exits[blocks] - j] = after
    return cost


def cheapest_arcs(code: np.ndarray, offsets: np.ndarray, cost: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tail, head, letter of the arcs of cheapest paths; nodes are 4 * layer + state. A path's end is an arc '-' to itself."""
    blocks = len(offsets) - 1
    layer = np.arange(len(code)) + np.repeat(np.arange(blocks), np.diff(offsets))
    exits = offsets[1:] + np.arange(blocks)
    state = np.arange(4)
    stays = np.where(code & (BLANK | DUPLICATE), NEVER, code // TRUNCATED & 1)[:, None]
    here, after = cost[layer], cost[layer + 1]
    keep = KEEP[code & 3]
    open_ended = np.concatenate([after, np.full_like(after[:, :1], NEVER)], axis=1)
    moves = (
        (1, after + DELETE, np.broadcast_to(state, keep.shape)),
        (3, np.take_along_axis(open_ended, keep, axis=1) + stays, keep),
        (4, after[:, NEXT] + REROLE + stays, np.broadcast_to(NEXT, keep.shape)),
    )
    tails, heads, letters = [], [], []

    def add(letter: int, tail: np.ndarray, head: np.ndarray) -> None:
        tails.append(tail)
        heads.append(head)
        letters.append(np.full(len(tail), letter))

    for letter, total, to in moves:
        r, s = np.nonzero((total == here) & (here < NEVER))
        add(letter, 4 * layer[r] + s, 4 * (layer[r] + 1) + to[r, s])
    inner = np.ones(len(cost), bool)
    inner[exits[~last]] = False
    i, s = np.nonzero(inner[:, None] & (cost[:, NEXT] + INSERT == cost) & (cost < NEVER))
    add(2, 4 * i + s, 4 * i + NEXT[s])
    ends = np.concatenate([(4 * exits[~last][:, None] + state).ravel(), (4 * exits[last][:, None] + [0, 3]).ravel()])
    add(0, ends, ends)
    return np.concatenate(tails), np.concatenate(heads), np.concatenate(letters)


def least_paths(tail: np.ndarray, head: np.ndarray, letter: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Arcs of the path with the least letters from each start node: one path a row, filled up with its end's arc.

    A start without arcs gives a row of -1.
    """
    rank = letter

    def leading(nodes: np.ndarray) -> np.ndarray:
        """The least-ranked arc of each node."""
        order = np.lexsort((rank, tail))
        at = np.searchsorted(tail[order], nodes)
        some = order[np.minimum(at, len(order) - 1)]
        return np.where(tail[some] == nodes, some, -1)

    pointer, pointers = leading(head), []
    while True:
        pointers.append(pointer)
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
        if not letter[pointer].any():
            break
        pointer = pointer[pointer]
    path = leading(start)[:, None]
    for pointer in pointers:
        path = np.concatenate([path, np.where(path < 0, -1, pointer[path])], axis=1)
    return path


def _batches(n: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of blocks of like length, at most CELLS cells at once."""
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * (int(n[order[stop]]) + 1) <= CELLS:
            stop += 1
        yield order[at:stop]
        at = stop


def _codes(entries: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pos and code of the rows of blocks, and where blocks begin. A row after no mark of its position is a duplicate."""
    offsets = np.asarray(entries.offsets) - entries.offsets[0].as_py()
    flat = entries.flatten()
    pos, code = np.asarray(flat.field("pos")), np.asarray(flat.field("code")).astype(np.int64)
    row = code >= 0
    marked = np.zeros(len(pos), bool)
    marked[1:] = (code[:-1] < 0) & (pos[1:] == pos[:-1])
    code = code + np.where(marked, 0, DUPLICATE)
    return pos[row], code[row], np.concatenate([[0], np.cumsum(row)])[offsets]


def _take(code: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of some blocks: their numbers, codes, and where the blocks begin among them."""
    n = np.diff(offsets)[which]
    begins = np.concatenate([[0], np.cumsum(n)])
    rows = np.repeat(offsets[which] - begins[:-1], n) + np.arange(begins[-1])
    return rows, code[rows], begins


def _longs(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width), pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, block, step: costs from each state before a block to each after it."""
    for batch in batches:
        _, code, offsets = _codes(batch.column("entries"))
        ends = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (batch.num_rows, 4, 4))
        cost = backward(code, offsets, ends)[offsets[:-1] + np.arange(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), _longs(cost.reshape(-1, 16))], ["key", "block", "step"])


def _solved(batch: pa.RecordBatch, code: np.ndarray, offsets: np.ndarray, starts: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """Blocks of like length, their rows, where each begins among them, arcs, and least paths from each block's start state."""
    ends = _matrix(batch.column("ends"), 4)
    last = np.asarray(batch.column("last").cast(pa.int8())).astype(bool)
    for which in _batches(np.diff(offsets)):
        rows, some, begins = _take(code, offsets, which)
        cost = backward(some, begins, ends[which][:, :, None])[:, :, 0]
        tail, head, letter = cheapest_arcs(some, begins, cost, last[which])
        start = 4 * (begins[:-1] + np.arange(len(which))) + starts(which)
        yield which, rows, begins, tail, head, letter, least_paths(tail, head, letter, start)


def block_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, block, step: the state after a block for each state before it, along the least path; -1 without any."""
    for batch in batches:
        _, code, offsets = _codes(batch.column("entries"))
        step = np.full((batch.num_rows, 4), -1, np.int64)
        for state in range(4):
            for which, _, _, _, head, _, path in _solved(batch, code, offsets, lambda w, s=state: np.full(len(w), s)):
                step[which, state] = np.where(path[:, -1] < 0, -1, head[path[:, -1]] % 4)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), _longs(step)], ["key", "block", "step"])


def block_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, fault, edit, new_role, before, after of each row: its letter, its role when that changes, initials of inserted turns."""
    roles = np.array([NAMES[c] for c in CALLS] + [None], object)
    faults = np.array([None, "blank", "duplicate", "truncated"], object)
    for batch in batches:
        pos, code, offsets = _codes(batch.column("entries"))
        entry = np.asarray(batch.column("entry")).astype(np.int64)
        for _, rows, begins, tail, _, letter, path in _solved(batch, code, offsets, lambda w: entry[w]):
            on = letter[path] > 0
            block, arc = np.nonzero(on)[0], path[on]
            node, kind = tail[arc], letter[arc]
            row = node // 4 - block
            edit, new = np.zeros(len(rows), np.int64), np.full(len(rows), 4)
            real = kind != 2
            edit[row[real]] = kind[real]
            moved = kind == 4
            new[row[moved]] = node[moved] % 4
            before, after = np.full(len(rows), "", object), np.full(len(rows), "", object)
            for r, b, state in zip(row[~real].tolist(), block[~real].tolist(), (node[~real] % 4).tolist(), strict=True):
                if r < begins[b + 1]:
                    before[r] += CALLS[state]
                else:
                    after[r - 1] += CALLS[state]
            c = code[rows]
            fault = np.where(c & BLANK, 1, np.where(c & DUPLICATE, 2, np.where(c & TRUNCATED, 3, 0)))
            said = (faults[fault], LETTERS[edit], roles[new], before, after)
            yield pa.RecordBatch.from_arrays([pa.array(pos[rows]), *(pa.array(x.tolist(), pa.string()) for x in said)], EDITS)


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The costs, or the map, of one stretch after another."""
    if len(first) == 4:
        return np.where(first < 0, -1, second[first])
    return np.minimum((first.reshape(4, 4, 1) + second.reshape(1, 4, 4)).min(axis=1), NEVER).ravel()


def _carry(step: np.ndarray, carry: np.ndarray) -> np.ndarray:
    if len(step) == 4:
        return np.array([step[carry[0]]])
    return np.minimum((step.reshape(4, 4) + carry).min(axis=1), NEVER)


def folded(steps: DataFrame, seed: list[int], reverse: bool) -> DataFrame:
    """key, block, carry: what reaches each block from the end (reverse) or the start of its conversation."""
    most = steps.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    up = (F.col("block") / FAN).cast("long") if most > FAN else F.lit(0).cast("long")
    rows = steps.withColumn("up", up)
    if most > FAN:

        def whole(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("block")
            out = group["step"].iloc[0]
            for step in group["step"].iloc[1:]:
                out = _then(out, step)
            return pd.DataFrame({"key": [group["key"].iloc[0]], "block": [group["up"].iloc[0]], "step": [out.tolist()]})

        upper = materialize(rows.groupBy("key", "up").applyInPandas(whole, "key string, block long, step array<long>"), "repair-upper")
        carried = folded(upper, seed, reverse).select("key", F.col("block").alias("up"), F.col("carry").alias("seed"))
        rows = rows.join(carried, ["key", "up"])
    else:
        rows = rows.withColumn("seed", F.array(*(F.lit(x).cast("long") for x in seed)))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ascending=not reverse)
        carry, out = group["seed"].iloc[0], []
        for step in group["step"]:
            out.append(carry.tolist())
            carry = _carry(step, carry)
        return pd.DataFrame({"key": group["key"], "block": group["block"], "carry": out})

    return materialize(rows.groupBy("key", "up").applyInPandas(fold, "key string, block long, carry array<long>"), "repair-fold")


def _row_code(role: Column, text: Column) -> Column:
    initial = F.substring(role, 1, 1)
    of = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    cut = ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return of + F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(0)


def in_order(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """key, conv_id, turn, role, text, pos: rows written in order, pos dense over all of them. A shuffle by ranges."""
    ident = F.col(f"`{conv_id}`")
    space = [F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    key = F.when(ident.isNull(), "").otherwise(F.concat(F.lit("="), ident.cast("string")))
    rows = df.select(key.alias("key"), ident.alias("conv_id"), F.col(f"`{turn}`").alias("turn"), *space, F.monotonically_increasing_id().alias("each"))
    order = ["key", "turn", "role", "text", "each"]  # equal rows can be dealt to several ranges
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("each")
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright(F.col("at"), 33)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())  # a row a range
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, start long")
    dense = rows.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part")
    return dense.select("key", "conv_id", "turn", "role", "text", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("pos"))


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row with its place and edit: key, conv_id, turn, role, text, pos, fault, edit, new_role, before, after.

    fault: blank, duplicate, truncated or null. edit: D, K or R. before, after: initials of turns inserted next to the row
    (after: of a conversation's last row only).
    """
    spark = df.sparkSession
    workers_import(spark)
    rows = in_order(df, conv_id, turn, role, text)
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    light = materialize(rows.select("key", "pos", _row_code(F.col("role"), F.col("text")).alias("code"), said.alias("said")), "repair-codes")
    first = light.groupBy("key", "said").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(-1).alias("code"))  # a mark
    block = F.shiftright("pos", BLOCK_BITS)
    blocks = light.select("key", "pos", "code").union(first).groupBy("key", block.alias("block"))
    blocks = materialize(blocks.agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("entries")), "repair-blocks")
    spans = blocks.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high")
    spans = materialize(spans.select("key", "high"), "repair-spans")
    split = materialize(blocks.join(spans, "key").withColumn("last", F.col("block") == F.col("high")).drop("high"), "repair-split")
    costs = materialize(split.mapInArrow(block_costs, "key string, block long, step array<long>"), "repair-costs")
    ends = folded(costs, FINAL.tolist(), True).withColumnRenamed("carry", "ends")
    exits = split.join(ends, ["key", "block"]).mapInArrow(block_exits, "key string, block long, step array<long>")
    entries = folded(materialize(exits, "repair-exits"), [0], False)
    told = ends.join(entries, ["key", "block"]).join(split.select("key", "block", "last"), ["key", "block"])
    told = materialize(told.select("key", "block", "ends", F.col("carry")[0].alias("entry"), "last"), "repair-told")
    final = F.array(*(F.lit(int(x)).cast("long") for x in FINAL))
    known = blocks.join(told, ["key", "block"], "left").select(
        "entries", F.coalesce("ends", final).alias("ends"), F.coalesce("entry", F.lit(0)).cast("long").alias("entry"), F.coalesce("last", F.lit(True)).alias("last")
    )
    edits = known.mapInArrow(block_edits, "pos long, fault string, edit string, new_role string, before string, after string")
    return rows.join(materialize(edits, "repair-edits"), "pos").select("key", "conv_id", "turn", "role", "text", *EDITS)


class _Summary:
    """What summaries takes from one conversation's rows, in order."""

    def __init__(self, ident):
        self.ident, self.turns, self.low, self.high, self.turn = ident, 0, None, None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.cost, self.initial, self.audit, self.text, self.lines = 0, 0, None, [], hashlib.sha256(), 0

    def say(self, role: str, text: str) -> None:
        self.text.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1

    def add(self, turn, role, text, fault, edit, new_role, before, after) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        for c in before:
            self.say(NAMES[c], "")
        if edit != "D":
            self.say(new_role or role, text)
        for c in after:
            self.say(NAMES[c], "")
        self.audit.append("I" * len(before) + edit + "I" * len(after))
        self.cost += INSERT * (len(before) + len(after)) + (DELETE if edit == "D" else REROLE * (edit == "R") + (fault == "truncated"))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.ident, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.text.hexdigest()


SUMMARY = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def summaries(rows: DataFrame) -> DataFrame:
    """A row a conversation: counts of faults, illegal neighbours, cost, audit, and the digest of the repaired text.

    A digest is made in sequence: a conversation's rows pass through one task as a stream, and none is held.
    """
    kind = dict(rows.dtypes)["conv_id"]
    names = ["turn", "role", "text", "fault", "edit", "new_role", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, done, ident_type = None, None, [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [ident_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], SUMMARY)

        for got in batches:
            ident_type = got.column("conv_id").type
            for k, ident, *row in zip(*(got.column(c).to_pylist() for c in ("key", "conv_id", *names)), strict=True):
                if k != key:
                    if now:
                        done.append(now.row())
                    now, key = _Summary(ident), k
                now.add(*row)
                if len(done) >= 1024:
                    yield batch()
                    done = []
        if now:
            done.append(now.row())
            yield batch()

    ordered = rows.select("key", "pos", "conv_id", *names).repartition("key").sortWithinPartitions("key", "pos").drop("pos")
    return ordered.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text with a seeded fault in a quarter of the rows; nulls read as one space."""
    name = F.concat_ws(":", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv_id, turn)))
    rows = df.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("lot"),
    ).filter("lot <> 0")
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("time")
