"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source. The token budget goes down the tree in proportion to
the weights; a node can take no more than its subtree holds times ``epochs``, and what it cannot
take goes to its siblings by weight, and only what all of them cannot take is left to the level
above. Each leaf then spends its budget: whole epochs first, then the prefix of one more epoch, in
an order drawn from seed, epoch and id. A row belongs to the prefix if the tokens before it are
fewer than the rest of the budget.

No leaf is sorted as a whole: tokens are counted per leaf and cell of the order's hash (4096
cells), which shows the cell where the prefix ends, and only the rows of that cell are ranked.

Defined cases: null domain, language, source and text are empty; tokens are runs of anything but
ASCII white space; rows without tokens are taken with the prefix they stand in; a leaf without
tokens or with weight 0 gives nothing; rows of one id in one leaf are taken or left together
where the prefix ends; an empty table gives an empty result. Columns of the input may have any name
that does not begin with two underscores.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentmill.llm.common import attach, empty_if_null, materialized

LEVELS = ("domain", "lang", "source")
_LEAF = [f"__{x}" for x in LEVELS]
CELL_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers by level and name; names not listed weigh 1. ``share`` is the
    budget in hundredths of the tokens there are, unless ``budget`` gives it in tokens."""
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    share: int = 100
    budget: int | None = None
    epochs: int = 2
    seed: int = 7


def count_tokens(text: Column) -> Column:
    return F.regexp_count(empty_if_null(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _weight(level: str, mix: Mix) -> Column:
    own = mix.weights.get(level, {})
    out = F.lit(1)
    for name, weight in own.items():
        out = F.when(F.col(f"__{level}") == name, F.lit(int(weight))).otherwise(out)
    return out.cast("decimal(9,0)")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given`` to children that have weight, cap and amount (their parent's budget): in
    proportion to weight, at most cap, and in whole tokens that add up to the amount or the caps.
    Children are taken from the soonest full to the last: one is full if its cap is no more than
    its share of what those before it have left."""
    order = W.partitionBy(*parent).orderBy("__full_at", name)
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    upto, whole = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*parent)
    big = "decimal(20,0)"
    ranked = (children.filter("weight > 0").withColumn("__full_at", F.expr("(cap * 1000) div weight"))
              .withColumn("__spent", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(big))
              .withColumn("__w", F.sum("weight").over(after).cast("decimal(14,0)"))
              .withColumn("__full", F.expr("cap * __w <= weight * (amount - __spent)")))
    open_weight = F.when(F.col("__full"), F.lit(0)).otherwise(F.col("weight")).cast("decimal(9,0)")
    rest = (ranked.withColumn("__rest", (F.col("amount") - F.sum(F.when(F.col("__full"), F.col("cap"))
                                                                   .otherwise(F.lit(0))).over(whole)).cast(big))
            .withColumn("__ow", open_weight)
            .withColumn("__sum", F.sum("__ow").over(whole).cast("decimal(14,0)"))
            .withColumn("__cum", F.sum("__ow").over(upto).cast("decimal(14,0)")))
    part = F.expr("(__rest * __cum) div __sum - (__rest * (__cum - __ow)) div __sum")
    return (rest.withColumn("given", F.when(F.col("__full"), F.col("cap")).otherwise(part).cast(big))
            .drop("__full_at", "__spent", "__w", "__full", "__rest", "__ow", "__sum", "__cum"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (level columns, __tokens, __rows) with their budget ``given``. The tree has as many
    lines as there are sources, whatever the number of rows."""
    big = "decimal(20,0)"
    # what no budget can reach must not raise the caps above it
    closed = reduce(or_, [_weight(name, mix) <= 0 for name in LEVELS])
    caps = leaves.withColumn("cap", F.when(closed, 0).otherwise(F.col("__tokens") * mix.epochs).cast(big))
    total = F.sum("__tokens").cast(big)
    wanted = F.lit(mix.budget).cast(big) if mix.budget is not None else F.floor(total * mix.share / 100)
    amount = caps.agg(F.least(wanted.cast(big), F.sum("cap").cast(big)).alias("amount"))
    level = caps.select(*_LEAF, "cap")
    given: DataFrame | None = None
    for depth, name in enumerate(LEVELS):
        path = _LEAF[:depth + 1]
        nodes = level.groupBy(*path).agg(F.sum("cap").cast(big).alias("cap"))
        if given is None:
            children = nodes.withColumn("__top", F.lit(0)).join(
                amount.withColumn("__top", F.lit(0)), "__top")
        else:
            children = nodes.join(given, path[:-1])
        parent = path[:-1] or ["__top"]
        out = share_out(children.withColumn("weight", _weight(name, mix)), parent, path[-1])
        given = materialized(out.select(*path, F.col("given").alias("amount")))
    return leaves.join(given.withColumnRenamed("amount", "given"), _LEAF)


def _tagged(df: DataFrame, domain: Column, lang: str, source: str) -> DataFrame:
    for name, value in zip(_LEAF, (domain, F.col(lang), F.col(source)), strict=True):
        df = df.withColumn(name, empty_if_null(value))
    return df.withColumn("__leaf", F.to_json(F.array(*_LEAF)))


def _drawn(df: DataFrame, id_col: str, mix: Mix) -> DataFrame:
    """The place of a row in the order of its leaf's last, partial epoch."""
    h = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("__epochs").cast("string"),
                          F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return df.withColumn("__h", h).withColumn("__cell", F.substring("__h", 1, CELL_DIGITS))


def mix_sources(df: DataFrame, domain: Column, mix: Mix, id_col: str = "doc_id", lang: str = "lang",
                source: str = "source", text_col: str = "text") -> DataFrame:
    """The chosen rows of ``df`` with their columns and __epoch (from 0), once per epoch they are
    taken in, and __tokens. Rows of leaves with a thousandth of all rows or more do not move."""
    tagged = _tagged(df, domain, lang, source)
    narrow = materialized(tagged.select(id_col, "__leaf", *_LEAF, count_tokens(F.col(text_col)).alias("__tokens")))
    leaves = materialized(narrow.groupBy("__leaf", *_LEAF).agg(F.sum("__tokens").alias("__tokens"),
                                                               F.count("*").alias("__rows")))
    total = narrow.count()
    budgets = (leaf_budgets(leaves, mix).filter("__tokens > 0")
               .select("__leaf", "__rows", F.expr("CAST(given AS BIGINT) div __tokens").alias("__epochs"),
                       F.expr("CAST(given AS BIGINT) % __tokens").alias("__rest")))
    budgets = materialized(budgets)
    ranked = materialized(_drawn(attach(narrow.select(id_col, "__leaf", "__tokens"), budgets, "__leaf", "__rows",
                                        total).filter("__rest > 0"), id_col, mix)
                          .select(id_col, "__leaf", "__epochs", "__rest", "__h", "__cell", "__tokens"))
    cells = ranked.groupBy("__leaf", "__rest", "__cell").agg(F.sum("__tokens").alias("t"))
    upto = F.sum("t").over(W.partitionBy("__leaf").orderBy("__cell"))
    ends = (cells.withColumn("upto", upto).filter("upto >= __rest AND upto - t < __rest")
            .select(F.col("__leaf"), F.col("__cell").alias("__end"), (F.col("upto") - F.col("t")).alias("__before")))
    facts = materialized(budgets.join(ends, "__leaf", "left"))
    # the rows of the cells where prefixes end, in order
    last = attach(ranked.select(id_col, "__leaf", "__h", "__cell", "__tokens"), facts, "__leaf", "__rows",
                  total).filter("__cell = __end")
    order = W.partitionBy("__leaf").orderBy("__h", id_col).rowsBetween(W.unboundedPreceding, -1)
    within = last.withColumn("b", F.col("__before") + F.coalesce(F.sum("__tokens").over(order), F.lit(0)))
    border = materialized(within.filter("b < __rest").select(
        F.col("__leaf").alias("__b_leaf"), F.col(id_col).alias("__b_id")).distinct())
    rows = tagged.drop(*_LEAF).withColumn("__tokens", count_tokens(F.col(text_col)))
    placed = _drawn(attach(rows, facts, "__leaf", "__rows", total), id_col, mix)
    out = [*df.columns, "__epoch", "__tokens"]
    whole = (placed.filter("__epochs > 0")
             .withColumn("__epoch", F.explode(F.sequence(F.lit(0), (F.col("__epochs") - 1).cast("int")))))
    prefix = placed.withColumn("__epoch", F.col("__epochs").cast("int"))
    inner = prefix.filter("__cell < __end")
    same = (F.col("__leaf") == F.col("__b_leaf")) & F.col(id_col).eqNullSafe(F.col("__b_id"))
    edge = prefix.filter("__cell = __end").join(border, same, "left_semi")
    return whole.select(*out).unionByName(inner.select(*out)).unionByName(edge.select(*out))
