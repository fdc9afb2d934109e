"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source). At each node it is shared among the children by weight.
A child never gets more than its subtree can give (its tokens times ``max_epochs``); what it cannot use goes to its
siblings, and only what the whole subtree cannot use is left to its parent's siblings. All shares are whole numbers:
floors, so at most one token a child is lost at each level.

A leaf's share buys whole epochs and a token-prefix of one more: its documents in the order of a seeded digest of
(seed, epoch, doc_id), as long as the running sum of tokens fits. The prefix is found through sums over ranges of the
digest (16 ** ``digits`` of them a leaf) and a window within the one range where the share ends, so no task orders a leaf.

Defined results: null levels are nodes named ''; documents without tokens take nothing and are in the prefix when what
precedes them fits; null ids are ordered as ''; rows of equal id are in or out together; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import WORD, materialize, new_name

BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def shares(leaves: DataFrame, levels: list[str], weights: dict[str, int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves (levels, tokens) with alloc, the tokens each leaf is to give. weights: by path 'a/b/c'; 1 unless given."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else None
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(BIG))
    grant = leaves.agg(F.sum(F.col("tokens").cast(BIG)).alias("t"), F.sum("cap").alias("c"))
    grant = grant.select(F.least(F.expr(f"(t * {share[0]}) div {share[1]}").cast(BIG), F.col("c")).alias("budget"))
    parents: list[str] = []
    for k in range(len(levels)):
        path = levels[: k + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").cast(BIG).alias("c"))
        weight = F.lit(1)
        if table is not None:
            name = F.concat_ws("/", *path)
            weight = F.when(F.map_contains_key(table, name), F.try_element_at(table, name)).otherwise(F.lit(1))
        nodes = nodes.withColumn("w", weight.cast(BIG))
        nodes = nodes.join(grant, parents) if parents else nodes.crossJoin(F.broadcast(grant))  # grant: one row
        ratio = F.when(F.col("w") > 0, F.col("c").cast("double") / F.col("w").cast("double"))
        ordered = Window.partitionBy(*(parents or [F.lit(0)])).orderBy(ratio.asc_nulls_last(), F.col(path[-1]))
        whole = Window.partitionBy(*(parents or [F.lit(0)]))
        before = F.coalesce(F.sum("c").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(BIG)
        rest = F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing)).cast(BIG)
        nodes = nodes.withColumn("p", before).withColumn("r", rest)
        full = (F.col("w") > 0) & (F.col("c") * F.col("r") <= F.col("w") * (F.col("budget") - F.col("p")))
        nodes = nodes.withColumn("full", full)
        taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(whole), F.lit(0)).cast(BIG)
        loose = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole).cast(BIG)
        nodes = nodes.withColumn("left_over", (F.col("budget") - taken).cast(BIG)).withColumn("loose", loose)
        part = F.expr(f"cast((w * left_over) div loose as {BIG})")
        grant = nodes.select(*path, F.when(F.col("full"), F.col("c")).when(F.col("w") <= 0, F.lit(0).cast(BIG)).otherwise(part).cast(BIG).alias("budget"))
        parents = path
    return leaves.join(grant, levels).select(*levels, "tokens", F.col("budget").cast("long").alias("alloc"))


def mix(
    df: DataFrame,
    levels: list[tuple[str, Column]],
    tokens: Column,
    weights: dict[str, int],
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 4,
    seed: int = 0,
    doc_id: str = "doc_id",
    copies: str = "copies",
    digits: int = 3,
) -> DataFrame:
    """df with the number of copies of each row in the mix, 0 for rows left out. share: budget over all tokens."""
    names = [new_name(df, f"_level{k}_{n}") for k, (n, _) in enumerate(levels)]
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for (_, c), n in zip(levels, names, strict=True)]
    rows = materialize(df.select(*named, ident.alias("ident"), tokens.cast("long").alias("tokens")), "mixing")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    plan = shares(leaves, names, weights, share, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("room", F.col("alloc") - F.col("epochs") * F.col("tokens"))
    plan = materialize(plan.select(*names, "epochs", "room"), "mixing-plan")

    def key(i: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), i).cast("binary"))

    keyed = rows.join(plan, names).withColumn("key", key(F.col("ident"))).withColumn("range", F.substring("key", 1, digits))
    sums = keyed.groupBy(*names, "range").agg(F.sum("tokens").alias("t"), F.first("room").alias("room"))
    upto = F.sum("t").over(Window.partitionBy(*names).orderBy("range"))
    ends = sums.withColumn("upto", upto).filter((F.col("upto") - F.col("t") <= F.col("room")) & (F.col("upto") > F.col("room")))
    ends = materialize(ends.select(*names, "range", (F.col("room") - F.col("upto") + F.col("t")).alias("here")), "mixing-ends")
    inside = keyed.join(ends, [*names, "range"])
    running = F.sum("tokens").over(Window.partitionBy(*names).orderBy("key", "ident"))
    last = inside.withColumn("run", running).filter("run <= here").groupBy(*names).agg(F.max(F.struct("key", "ident")).alias("last"))
    cut = plan.join(ends.select(*names, "range"), names, "left").join(last, names, "left")
    cut = materialize(cut.select(*names, "epochs", "range", "last"), "mixing-cut")
    wide = df.withColumns(dict(zip(names, [F.coalesce(c.cast("string"), F.lit("")) for _, c in levels], strict=True)))
    cut = cut.select(*names, *(F.col(c).alias(new_name(df, f"_{c}")) for c in ("epochs", "range", "last")))
    got = {c: new_name(df, f"_{c}") for c in ("epochs", "range", "last")}

    def col(c: str) -> Column:
        return F.col(got[c])

    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), col("epochs").cast("string"), ident).cast("binary"))
    mine = F.struct(digest.alias("key"), ident.alias("ident"))
    here = F.substring(digest, 1, digits)
    chosen = col("range").isNull() | (here < col("range")) | F.coalesce((here == col("range")) & (mine <= col("last")), F.lit(False))
    return wide.join(cut, names).select(*(F.col(f"`{c}`") for c in df.columns if c != copies), (col("epochs") + chosen.cast("long")).alias(copies))
