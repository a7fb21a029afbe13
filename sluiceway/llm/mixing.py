"""Mixing sources to target weights over a tree such as domain - language - source.

A token budget flows down the tree by weight. What a node cannot supply goes to its siblings first
and only the rest of a whole saturated branch to the siblings of its ancestors. Every leaf then
gives a prefix, in tokens, of its seeded epochs: each epoch is one seeded order of its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import WORD, quoted, text_of
from sluiceway.sources import lineage_cut

ROWS_PER_BIN = 4096
STEPS = 64  # levels between two tried in one step of the search
RANK_BINS = 1024


@dataclass(frozen=True)
class Mix:
    """``levels``: columns from the root down. ``weights``: per level, weight by value.

    A level without weights shares equally; a value that is not listed has weight ``other``. The
    budget is a number of tokens or, if that is None, ``share`` of all tokens at hand. A leaf
    supplies at most ``max_epochs`` times its tokens.
    """

    levels: tuple[str, ...]
    weights: tuple[dict[str | None, float] | None, ...]
    share: float = 0.8
    tokens: int | None = None
    other: float = 0.05
    max_epochs: int = 1
    seed: int = 42

    def weight(self, level: int, value: Column) -> Column:
        """The weight of a value, over the largest of its level."""
        table = self.weights[level]
        if table is None:
            return F.lit(1.0)
        top = max(*table.values(), self.other, 0.0) or 1.0
        out = F.lit(self.other / top)
        for name, weight in table.items():
            out = F.when(value.eqNullSafe(F.lit(name)), weight / top).otherwise(out)
        return out


def node_path(columns: list[Column]) -> Column:
    """One string for the values on the way to a node, different for different ways and never null."""
    ends = [F.when(c.isNull(), "-").otherwise(F.concat(F.char_length(c).cast("string"), F.lit(":"), c))
            for c in columns]
    return F.concat(F.lit("/"), *ends)


def fill(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, budget): every parent's budget split by weight among its nodes, in whole tokens.

    ``nodes`` has ``up``, ``node``, ``cap`` and ``weight`` (0 to 1), ``parents`` has ``node`` and
    ``budget``. Nobody gets more than its cap; the rest goes on to the others. Nodes of weight zero
    share evenly what the others cannot take. At a water level L a node holds ``floor(L * weight)``
    or its cap. The largest L that the budget covers is searched for all parents at once, a few bits
    a step, by sums that combine in the map tasks; what is left then goes, one token each, to nodes
    that level L + 1 would raise. So neither the number of parents nor that of a parent's nodes
    matters to a task.
    """
    late = F.col("weight") <= 0
    nodes = nodes.select(F.concat("up", F.when(late, "0").otherwise("+")).alias("group"), "up", "node",
                         "cap", F.when(late, 1.0).otherwise(F.col("weight")).alias("weight"),
                         late.alias("late"))
    supply = nodes.groupBy("up").agg(
        F.sum("cap").alias("all"),
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("cap"))), F.lit(0)).alias("early"))
    first = F.least("budget", "early")
    then = F.least("budget", "all") - first
    state = (
        parents.withColumnRenamed("node", "up").join(supply, "up")
        .select(F.explode(F.array(
            F.struct(F.concat("up", F.lit("+")).alias("group"), first.alias("budget")),
            F.struct(F.concat("up", F.lit("0")).alias("group"), then.alias("budget")))).alias("g"))
        .select("g.*", F.lit(0).cast("long").alias("level"))
    )
    state = lineage_cut(state)
    top = nodes.agg(F.max(F.ceil(F.col("cap") / F.col("weight")))).first()[0] or 0

    def held(level: Column) -> Column:
        return F.least("cap", F.floor(level * F.col("weight")))

    width = 1
    while width * STEPS <= top:
        width *= STEPS
    while width:
        tried = (
            nodes.join(state, "group")
            .select("*", F.explode(F.sequence(*[F.lit(k).cast("long") for k in (1, STEPS - 1)])).alias("k"))
            .groupBy("group", "budget", "level", "k")
            .agg(F.sum(held(F.col("level") + F.col("k") * width)).alias("s"))
        )
        state = lineage_cut(tried.groupBy("group", "budget", "level").agg(
            F.count_if(F.col("s") <= F.col("budget")).alias("k"))
            .select("group", "budget", (F.col("level") + F.col("k") * width).alias("level")))
        width //= STEPS
    got = nodes.join(state, "group").select(
        "group", "node", "budget", held(F.col("level")).alias("got"),
        (held(F.col("level") + 1) - held(F.col("level"))).alias("raise"),
        F.pmod(F.crc32("node"), F.lit(RANK_BINS)).alias("bin"))
    # The order among those to be raised: hash bins, then paths. A window sees bins or one bin.
    bins = got.groupBy("group", "bin").agg(F.sum("got").alias("g"), F.sum("raise").alias("r"))
    in_group = Window.partitionBy("group")
    earlier = in_group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("group", "bin", F.sum("g").over(in_group).alias("taken"),
                       F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("before"))
    in_bin = Window.partitionBy("group", "bin").orderBy("node").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("raise").over(in_bin) + F.col("before")
    spare = F.col("budget") - F.col("taken") - (upto - F.col("raise"))
    more = F.greatest(F.lit(0), F.least(F.col("raise"), spare))
    return got.join(bins, ["group", "bin"]).select("node", (F.col("got") + more).alias("budget"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(node, budget): tokens to take from every leaf. ``leaves`` has the levels as ``_level0``,
    ``_level1`` ... and the tokens ``t`` at hand in each."""
    names = [F.col(f"_level{i}") for i in range(len(mix.levels))]
    have = leaves.select(*names, (F.col("t") * mix.max_epochs).alias("cap"))
    goal = F.floor(F.sum("t") * F.lit(float(mix.share))) if mix.tokens is None else F.lit(mix.tokens)
    out = leaves.agg(F.least(goal.cast("long"), F.sum("t") * mix.max_epochs).alias("budget")).select(
        F.lit("/").alias("node"), "budget")
    for level in range(len(names)):
        nodes = have.groupBy(node_path(names[:level]).alias("up"),
                             node_path(names[: level + 1]).alias("node"),
                             mix.weight(level, names[level]).alias("weight"))
        out = lineage_cut(fill(lineage_cut(nodes.agg(F.sum("cap").alias("cap"))), out))
    return out


def _order_key(id_col: Column, epoch: Column, seed: int) -> Column:
    """A non-negative long, uniform, the same for every row with this id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, id_col), 1)


def mix_sources(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text",
                level_columns: dict[str, Column] | None = None) -> DataFrame:
    """The chosen documents, once for each epoch they are taken in, with ``mix_epoch``.

    ``level_columns`` gives expressions for levels that are no columns. A null is a branch of its
    own. Tokens are words; a document without words costs nothing and comes with its epoch's prefix.
    A leaf never exceeds its budget. Rows with one id are taken together, also those without one.
    The place where a leaf's prefix ends is found from narrow rows; every row then compares itself
    with the place of its leaf, so texts stay where they are while Spark finds the table of leaves
    small enough to broadcast. Within a leaf only sums of hash bins are ordered, and only the one bin
    with the end is sorted, in which the rows of an id count as one.
    """
    given = level_columns or {}
    names = [f"_level{i}" for i in range(len(mix.levels))]
    own = [given.get(c, quoted(c) if c in docs.columns else F.lit(None)).cast("string")
           for c in mix.levels]
    leaf = node_path(own).alias("_leaf")
    who = quoted(id_col).alias("_id")
    whole_row = F.struct(*[quoted(c) for c in docs.columns if c != "mix_epoch"]).alias("_doc")
    keyed = docs.select(whole_row, leaf, who)
    tokens = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_tokens")
    rows = lineage_cut(docs.select(*[c.alias(n) for c, n in zip(own, names, strict=True)], leaf, who,
                                   tokens))
    leaves = lineage_cut(rows.groupBy("_leaf", *names).agg(
        F.sum("_tokens").alias("t"), F.count("*").alias("n")))
    full = F.col("t") > 0
    planned = lineage_cut(leaves.join(budgets(leaves, mix), F.col("_leaf") == F.col("node")).select(
        "_leaf",
        F.when(full, F.expr("budget div t")).otherwise(mix.max_epochs).cast("long").alias("_whole"),
        F.when(full, F.expr("budget % t")).otherwise(0).cast("long").alias("_rest"),
        F.greatest(F.lit(1), F.expr(f"n div {ROWS_PER_BIN}")).cast("long").alias("_bins"),
    ))

    def with_bin(df: DataFrame) -> DataFrame:
        key = _order_key(F.col("_id"), F.col("_whole"), mix.seed)
        top = F.shiftrightunsigned("_key", 32)  # 31 bits
        return df.withColumn("_key", key).withColumn(
            "_bin", F.shiftrightunsigned(top * F.col("_bins"), 31)
        )

    binned = with_bin(rows.select("_leaf", "_id", "_tokens").join(planned.filter("_rest > 0"), "_leaf"))
    by_leaf = Window.partitionBy("_leaf")
    bins = (
        binned.groupBy("_leaf", "_bin", "_rest").agg(F.sum("_tokens").alias("t"))
        .withColumn("_upto", F.sum("t").over(by_leaf.orderBy("_bin")))
        .filter("_upto > _rest")
        .groupBy("_leaf").agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("t")).alias("b")))
                              .alias("e"))
        .select("_leaf", F.col("e._bin").alias("_cut"), F.col("e.b").alias("_before"))
    )
    bins = lineage_cut(bins)
    last = (
        binned.join(bins, "_leaf").filter("_bin = _cut")
        .groupBy("_leaf", "_key", "_id", "_before", "_rest").agg(F.sum("_tokens").alias("_tokens"))
        .withColumn("_upto", F.sum("_tokens").over(by_leaf.orderBy("_key", "_id")))
        .filter("_before + _upto <= _rest")
        .groupBy("_leaf").agg(F.max(F.struct("_key", "_id")).alias("_last"))
    )
    ends = lineage_cut(planned.join(bins, "_leaf", "left").join(last, "_leaf", "left"))
    out = with_bin(keyed.join(ends, "_leaf"))
    inside = (F.col("_rest") > 0) & (
        (F.col("_bin") < F.col("_cut"))
        | ((F.col("_bin") == F.col("_cut")) & (F.struct("_key", "_id") <= F.col("_last")))
    )
    epochs = F.when(F.coalesce(inside, F.lit(False)), F.col("_whole") + 1).otherwise(F.col("_whole"))
    taken = out.withColumn("_epochs", epochs).filter("_epochs > 0")
    return taken.select(
        "_doc.*",
        F.explode(F.sequence(F.lit(0), (F.col("_epochs") - 1).cast("int"))).alias("mix_epoch"),
    )
