"""Connected components of a graph of links, by hooking to the least neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """Rows (node, label): the least node that links lead to.  No links, no rows.

    Every round hooks each node to its least neighbour, follows the hooks to their
    ends (paths halve each time) and goes on with the links between different ends,
    so that a link meets its ends once and only what parts components is carried on.
    Each step is written to the shared folder.  known: labels of earlier links, which
    stay as they are; the links join their components.  No new links: ``known`` itself.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    links, labels = written(_between(links, known), "links"), known
    while links.limit(1).count():
        hooks = _hooked(links)
        rest = written(_between(links, hooks), "links")
        forget(links)
        if labels is None:
            moved = hooks
        else:
            moved = written(_moved(labels, hooks), "labels")
            forget(hooks, None if labels is known else labels)
        links, labels = rest, moved
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    forget(links)
    return labels


def _between(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The links (a, b), a < b, between the labels of their ends; an end without a label is its own."""
    if labels is not None:
        for end in ("a", "b"):
            links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
        links = links.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hooked(links: DataFrame) -> DataFrame:
    """(node, label) of each end of a link: where the hooks to least neighbours lead."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    hooks = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "hooks")
    while True:
        far = hooks.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = written(hooks.join(far, F.col("label") == F.col("at")).select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("changed")), "hooks")
        forget(hooks)
        hooks = moved.select("node", "label")
        hooks._written_to = moved._written_to
        if not moved.filter("changed").limit(1).count():
            return hooks


def _moved(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """Labels as the hooks between them say, and the nodes that had none."""
    to = hooks.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(hooks.join(labels.select("node"), "node", "left_anti"))
