"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Weights live on a tree, domain - language - source. The token budget goes down
the tree: at every node it is shared among the children by weight, but no child
gets more than its leaves can supply (their tokens times the allowed epochs).
What a child cannot take goes to its siblings, by weight, until they are full
too; only what a whole subtree cannot supply reaches the ancestors' other
children. Each leaf then reads its documents in epochs: whole passes first, and
then the prefix of one more pass in an order seeded by epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, word_count

SLICES = 3          # hex digits of the order key that split a leaf: 4096 parts


def share(children: DataFrame, parent: list[str], budget: str, order: list[str]) -> DataFrame:
    """Share each parent's ``budget`` among its children: adds ``granted``.

    Children have ``weight`` and ``capacity`` (whole numbers). With the children
    in order of capacity per weight, those that fill up come first, and the rest
    share what is left in proportion. Fractions of a token go to the first
    children, in order, that have room.
    """
    by = Window.partitionBy(*parent)
    ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight"))
    queue = by.orderBy(ratio.asc_nulls_last(), *order)
    before = queue.rowsBetween(Window.unboundedPreceding, -1)
    c = (children.withColumn("budget_here", F.least(F.col(budget), F.sum(F.when(F.col("weight") > 0, F.col("capacity"))
                                                                         .otherwise(0)).over(by)))
         .withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
         .withColumn("w_all", F.sum("weight").over(by)))
    big = lambda x: F.col(x).cast("decimal(19,0)")
    left = F.col("budget_here") - F.col("c_before")
    full = (F.col("weight") > 0) & (big("capacity") * (F.col("w_all") - F.col("w_before")) <= left.cast("decimal(19,0)") * F.col("weight"))
    c = c.withColumn("full", full)
    # those that fill up are a head of the queue
    c = (c.withColumn("c_full", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(by))
         .withColumn("w_rest", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(by)))
    part = F.expr("cast((cast(budget_here - c_full as decimal(19,0)) * weight) div w_rest as bigint)")
    c = c.withColumn("floor_share", F.when(F.col("full"), F.col("capacity")).when(F.col("weight") > 0, part).otherwise(F.lit(0)))
    spare = F.col("budget_here") - F.sum("floor_share").over(by)
    c = c.withColumn("spare", spare).withColumn("open", ((F.col("weight") > 0) & (F.col("floor_share") < F.col("capacity"))).cast("int"))
    nth = F.sum("open").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("granted", F.col("floor_share") + F.when((F.col("open") == 1) & (nth <= F.col("spare")), 1).otherwise(0))
    return c.drop("budget_here", "w_before", "c_before", "w_all", "full", "c_full", "w_rest", "floor_share", "spare", "open")


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: dict[tuple, int], default_weight: int = 1) -> DataFrame:
    """Budgets of the leaves ``(domain, lang, source, tokens)``: adds ``granted``.

    ``weights`` maps ``(domain,)``, ``(domain, lang)`` or ``(domain, lang,
    source)``, where None matches any value, to whole-number weights. The more
    specific entry of a level wins; nodes it does not name get ``default_weight``.
    """
    def weight(columns: list[str]) -> Column:
        out = F.lit(default_weight)
        named = [(k, w) for k, w in weights.items() if len(k) == len(columns)]
        for key, w in sorted(named, key=lambda e: sum(x is not None for x in e[0])):
            hit = F.lit(True)
            for name, value in zip(columns, key):
                if value is not None:
                    hit = hit & (F.col(name) == value)
            out = F.when(hit, F.lit(w)).otherwise(out)
        return out.cast("long")

    levels = [["domain"], ["domain", "lang"], ["domain", "lang", "source"]]
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    granted = None
    for depth, columns in enumerate(levels):
        nodes = leaves.groupBy(*columns).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(columns))
        if depth == 0:
            nodes = share(nodes.withColumn("root", F.lit(0)).withColumn("given", F.lit(budget).cast("long")), ["root"], "given", columns).drop("root", "given")
        else:
            nodes = share(nodes.join(granted.withColumnRenamed("granted", "given"), columns[:-1]), columns[:-1], "given", columns).drop("given")
        granted = nodes.select(*columns, "granted")
    return leaves.drop("capacity").join(granted, levels[-1])


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: 32 hex digits, the same everywhere."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")))


def mix(docs: DataFrame, domain: str, weights: dict[tuple, int], budget_permille: int = 600, max_epochs: int = 2,
        seed: int = 17) -> DataFrame:
    """The documents of a mixture: ``(doc_id, domain, lang, source, epoch, n_tokens, take_tokens)``.

    ``docs`` needs ``doc_id``, ``text``, ``lang`` and ``source``; ``domain`` is
    a SQL expression over these; other columns are ignored. Tokens are words. The
    budget is ``budget_permille`` thousandths of all tokens. A document is there
    once for each pass of its leaf; in the last, partial pass those whose
    preceding tokens are fewer than the leaf's remainder, and ``take_tokens`` is
    how many of its tokens fit. Null lang, source and domain are leaves of their
    own (``und``, ``unknown``, ``unknown``). Documents without tokens are never
    drawn; repeated rows count each; rows of a null doc_id are left out, having
    no place in the order. An empty table gives an empty result.
    """
    leaf = ["domain", "lang", "source"]
    slim = docs.select("doc_id", F.coalesce(F.expr(domain), F.lit("unknown")).alias("domain"), F.coalesce("lang", F.lit("und")).alias("lang"),
                       F.coalesce("source", F.lit("unknown")).alias("source"), word_count(F.col("text")).alias("n_tokens"))
    slim = stored(slim.where("doc_id is not null and n_tokens > 0"), "mix-tokens")
    leaves = slim.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = stored(leaf_budgets(leaves, total * budget_permille // 1000, max_epochs, weights)
                     .withColumn("passes", F.expr("granted div tokens").cast("int")).withColumn("rest", F.col("granted") % F.col("tokens")), "mix-budgets")

    rows = slim.join(budgets.select(*leaf, "passes", "rest"), leaf)
    whole = (rows.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("passes"))))
             .withColumn("take_tokens", F.col("n_tokens")))
    # The partial pass: running totals within a slice of the order, after the
    # totals of the slices before it, so that no leaf is one task's work.
    part = rows.where("rest > 0").withColumn("epoch", F.col("passes") + 1)
    part = part.withColumn("key", order_key(seed, F.col("epoch"), F.col("doc_id"))).withColumn("slice", F.substring("key", 1, SLICES))
    slices = part.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    earlier = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*leaf, "slice", F.coalesce(F.sum("slice_tokens").over(earlier), F.lit(0)).alias("slice_start"))
    inside = Window.partitionBy(*leaf, "slice").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    part = (part.join(slices, [*leaf, "slice"])
            .withColumn("start", F.col("slice_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .where("start < rest").withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("start"))))
    columns = ["doc_id", *leaf, "epoch", "n_tokens", "take_tokens"]
    return whole.select(*columns).unionByName(part.select(*columns))
