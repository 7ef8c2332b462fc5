"""Connected components of an edge list, in a number of rounds that grows with
the logarithm of the diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import by_shuffle, cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", large: bool = False) -> DataFrame:
    """``(vertex, component)`` for every end of an edge; component = least vertex reachable.

    Vertices may be of any type with an order. Each round hooks every vertex
    and its parent to the least grandparent among its neighbours and then
    halves the paths; it stops when no parent changes, however long that
    takes. Rows with a null end are ignored; a self-loop makes its vertex a
    component of its own; no edges, no rows. Each round is one written table
    in the shared checkpoint folder, so lineage stays short. ``large``: its joins
    shuffle, however small the files of a round look.
    """
    side = by_shuffle if large else (lambda df: df)
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull())
    both = F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v")),
                   F.struct(a.alias("u"), a.alias("v")), F.struct(b.alias("u"), b.alias("v")))
    e = cut_lineage(e.select(F.inline(both)).distinct(), "edges")
    f = e.groupBy("u").agg(F.min("v").alias("p"))
    step = 0
    while True:
        f = cut_lineage(f, f"round-{step}")
        if step and f.where("moved").isEmpty():
            return f.select(F.col("u").alias("vertex"), F.col("p").alias("component"))
        step += 1
        up = f.select(F.col("u").alias("p"), F.col("p").alias("g"))
        fg = f.select("u", "p").join(side(up), "p")                      # u, its parent, its grandparent
        near = (e.join(side(fg.select(F.col("u").alias("v"), "g")), "v")
                .groupBy("u").agg(F.min("g").alias("g")).join(side(f.select("u", "p")), "u"))
        offers = near.select(F.inline(F.array(F.struct(F.col("u"), F.col("g").alias("new")),
                                              F.struct(F.col("p").alias("u"), F.col("g").alias("new")))))
        offers = offers.unionByName(fg.select("u", F.col("g").alias("new")))
        best = offers.groupBy("u").agg(F.min("new").alias("new"))
        f = (f.select("u", "p").join(side(best), "u")
             .select("u", F.least("p", "new").alias("p"), (F.col("new") < F.col("p")).alias("moved")))
