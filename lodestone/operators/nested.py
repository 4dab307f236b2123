"""Document trees: preorder numbering, ancestors, descendants, root counts, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.terms import without
from lodestone.session import materialise


def flatten(nodes: DataFrame) -> DataFrame:
    """Rows with ``path array<bigint>`` (ordinals or keys from the root on) numbered in preorder, parents first.

    Adds doc_num, parent and root_num. Arrays compare element by element, prefix first: order by path is preorder.
    Roots are shifted by the sizes of the trees before, in buckets, so only single trees are ever sorted whole.
    """
    n = nodes.withColumn("_root", F.element_at("path", 1)).withColumn("_bucket", F.floor(F.col("_root") / 1024).cast("long"))
    sizes = n.groupBy("_bucket", "_root").agg(F.count("*").alias("_size"))
    totals = sizes.groupBy("_bucket").agg(F.sum("_size").alias("_total"))
    lots = totals.select("_bucket", F.coalesce(F.sum("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lot"))
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_bucket").orderBy("_root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.withColumn("_inside", inside).join(lots, "_bucket").select("_root", (F.col("_lot") + F.col("_inside")).alias("root_num"))
    tree = Window.partitionBy("_root").orderBy("path")
    placed = n.withColumn("_own", F.row_number().over(tree) - 1).join(shifts, "_root").withColumn("doc_num", F.col("root_num") + F.col("_own"))
    up = placed.select("_root", F.col("path").alias("_up"), F.col("doc_num").alias("parent"))
    parent_path = F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1))
    return placed.withColumn("_up", parent_path).join(up, ["_root", "_up"], "left").drop("_root", "_up", "_bucket", "_own")


def ancestors_by_path(nodes: DataFrame) -> DataFrame:
    """(doc_num, depth, ancestor) of flattened nodes, the document itself at depth 0: one join on path prefixes."""
    up = F.explode(F.sequence(F.lit(0), F.size("path") - 1))
    asked = nodes.select("doc_num", "path", up.alias("depth")).select("doc_num", "depth", F.slice("path", F.lit(1), F.size("path") - F.col("depth")).alias("path"))
    return asked.join(nodes.select("path", F.col("doc_num").alias("ancestor")), "path").select("doc_num", "depth", "ancestor")


def ancestors(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_num, depth, ancestor) from (child, parent) edges alone; a document without edges has only itself.

    One join a level; levels that add nothing end the loop."""
    step = docs.select("doc_num", F.lit(0).alias("depth"), F.col("doc_num").alias("ancestor"))
    out = step
    while True:
        step = materialise(step.join(edges, F.col("ancestor") == F.col("child")).select("doc_num", (F.col("depth") + 1).alias("depth"), F.col("parent").alias("ancestor")))
        if step.isEmpty():
            return out
        out = out.union(step)


def roots(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_num, root_num) recomputed from edges: the ancestor of the greatest depth."""
    return ancestors(docs, edges).groupBy("doc_num").agg(F.max_by("ancestor", "depth").alias("root_num"))


def descendants(nodes: DataFrame, of: list[int] | None = None) -> DataFrame:
    """(root_num, doc_num) of documents below roots."""
    below = nodes.filter("parent is not null").select("root_num", "doc_num")
    return below if of is None else below.filter(F.col("root_num").isin(of))


def root_ranges(nodes: DataFrame) -> DataFrame:
    """Each root with the contiguous range of its descendants in preorder: (root_num, first, last)."""
    return nodes.groupBy("root_num").agg((F.min("doc_num") + 1).alias("first"), F.max("doc_num").alias("last"))


def root_count(nodes: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Roots that are left; nested documents among the deleted don't matter."""
    return without(nodes.filter("parent is null"), deleted).agg(F.count("*").alias("n"))


def cascade(nodes: DataFrame, drops: DataFrame) -> DataFrame:
    """Dropped documents and, for the roots among them, all that lies below."""
    below = nodes.join(drops.select(F.col("doc_num").alias("root_num")).distinct(), "root_num", "left_semi").select("doc_num")
    return below.union(drops.select("doc_num")).distinct()
