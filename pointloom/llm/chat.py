"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role, text). Adjacent turns of one role become one
message by array functions; a separator keeps their boundaries, so the turns can be read back:

    <|turn:ROLE|>\\n TEXT [<|sep|> TEXT ...] <|end|>\\n

Control strings inside texts are escaped reversibly, after sorting: & as &amp;, and the first character of <|, <s>, </s>,
[INST] and [/INST] as &lt; or &#91;. Roles also escape |. The loss mask is a list of (start, length) in code points of the
formatted string, one for each assistant text, without the marks around it.

Time grows with the number of turns: a turn is compared with its neighbour by index, messages are slices, and running sums
of lengths are taken in blocks, so that no step copies what came before it.

Defined results: null texts and roles are empty; null turn numbers come first; equal turn numbers are ordered by role,
then text; repeated rows are turns of their own; a null conv_id is one conversation. The string of one conversation is
one output value and is built in one task, whatever number of rows it has; no other rows meet there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP, END = "<|sep|>", "<|end|>\n"
#: Turns whose lengths are summed, or whose texts are cut out of the formatted string, together.
BLOCK = 256


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    out = F.regexp_replace(out, r"<(?=\||/?s>)", "&lt;")
    return F.regexp_replace(out, r"\[(?=/?INST\])", "&#91;")


def unescape(text: Column) -> Column:
    for mark, plain in (("&lt;", "<"), ("&#91;", "["), ("&#124;", "|"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def let(value: Column, body) -> Column:
    """body of a value that is computed once: the optimizer would copy an expression into a lambda that uses its column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """items in runs of BLOCK."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK)), lambda first: F.slice(items, first, F.lit(BLOCK)))


def _sums(lengths: Column, start: Column) -> Column:
    """start plus the sum of all lengths before each one."""
    none = F.struct(start.alias("at"), F.array().cast("array<long>").alias("all"))
    return F.aggregate(lengths, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]


def _starts(lengths: Column) -> Column:
    """The sum of all lengths before each one: within blocks, after sums over blocks."""
    zero = F.lit(0).cast("long")

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, n: acc + n))
        return F.flatten(F.zip_with(blocks, _sums(totals, zero), _sums))

    return let(_blocks(lengths), whole)


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|turn:"), role, F.lit("|>\n"))


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start, length)."""
    plain = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text)}
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), plain[role].alias("role"), plain[text].alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    places = lambda x: F.sequence(F.lit(0), F.size(x) - 1)

    def marked(turns: Column) -> Column:
        """Turns with escaped strings, and whether each begins and ends a message."""
        other = lambda t, i: F.coalesce(F.get(turns, i)["role"] != t["role"], F.lit(True))
        name = lambda t: F.replace(escape(t["role"]), F.lit("|"), F.lit("&#124;"))
        one = lambda t, i: F.struct(_head(name(t)).alias("head"), escape(t["text"]).alias("text"), other(t, i - 1).alias("opens"), other(t, i + 1).alias("closes"), (t["role"] == learn).alias("learn"))
        return F.transform(turns, one)

    def messages(x: Column) -> Column:
        """x: turns, texts, and the places where messages begin. Each message is a slice of the texts, joined."""

        def message(first: Column, k: Column) -> Column:
            end = F.coalesce(F.get(x["first"], k + 1), F.size(x["turns"]))
            return F.concat(F.get(x["turns"], first)["head"], F.array_join(F.slice(x["texts"], first + 1, end - first), SEP), F.lit(END))

        return F.array_join(F.transform(x["first"], message), "")

    def sizes(t: Column) -> Column:
        before = F.when(t["opens"], F.length(t["head"])).otherwise(0)
        after = F.when(t["closes"], len(END)).otherwise(len(SEP))
        return F.struct(before.cast("long").alias("before"), F.length(t["text"]).cast("long").alias("size"), (before + F.length(t["text"]) + after).cast("long").alias("whole"), t["learn"].alias("learn"))

    def spans(x: Column) -> Column:
        """x: sizes and starts of turns."""
        said = F.filter(places(x["sizes"]), lambda i: F.get(x["sizes"], i)["learn"])
        return F.transform(said, lambda i: F.struct((F.get(x["starts"], i) + F.get(x["sizes"], i)["before"]).alias("start"), F.get(x["sizes"], i)["size"].alias("length")))

    def both(turns: Column) -> Column:
        first = F.filter(places(turns), lambda i: F.get(turns, i)["opens"])
        text = let(F.struct(turns.alias("turns"), F.transform(turns, lambda t: t["text"]).alias("texts"), first.alias("first")), messages)
        loss = let(F.transform(turns, sizes), lambda z: let(F.struct(z.alias("sizes"), _starts(F.transform(z, lambda s: s["whole"])).alias("starts")), spans))
        return F.struct(text.alias("formatted"), loss.alias("loss"))

    out = turns.select("conv_id", let(F.col("turns"), lambda t: let(marked(t), both)).alias("out"))
    return out.select("conv_id", "out.formatted", "out.loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as array of (role, text)."""
    messages = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda m: m != "")

    def turns(m: Column) -> Column:
        head = F.substring_index(m, "|>\n", 1)
        role = unescape(F.substr(head, F.lit(len("<|turn:") + 1)))
        body = F.substr(m, F.length(head) + 4)
        return F.transform(F.split(body, r"<\|sep\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(messages, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped. A block of them is cut out first, then each text from that."""

    def texts(p: Column) -> Column:
        return F.transform(p["spans"], lambda s: unescape(F.substr(p["text"], (s["start"] - p["start"] + 1).cast("int"), s["length"].cast("int"))))

    def whole(x: Column) -> Column:
        def part(spans: Column) -> Column:
            start, last = F.get(spans, F.lit(0))["start"], F.get(spans, F.size(spans) - 1)
            return F.struct(spans.alias("spans"), start.alias("start"), F.substr(x["formatted"], (start + 1).cast("int"), (last["start"] + last["length"] - start).cast("int")).alias("text"))

        return F.flatten(F.transform(F.filter(_blocks(x["loss"]), lambda b: F.size(b) > 0), lambda b: let(part(b), texts)))

    return let(F.struct(formatted.alias("formatted"), loss.alias("loss")), whole)
