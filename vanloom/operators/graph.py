"""Connected components by contraction with pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanloom.session import cut

#: Lineage is cut each round; more rounds than this for a graph means a bug, not a large graph.
MAX_ROUNDS = 60
#: Up to so many links left, one task finishes the work; more are contracted by another round.
SMALL = 500_000


def _settled(links: DataFrame) -> DataFrame:
    """``from_, to_`` of at most SMALL links: the smallest node of each node's component, by union-find in one task."""
    kind = dict(links.dtypes)["lo"]

    def run(batches):
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        of = None
        for b in batches:
            of = b.schema.field(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, of), pa.array([top(n) for n in nodes], of)], names=["from_", "to_"])

    return links.select("lo", "hi").coalesce(1).mapInArrow(run, f"from_ {kind}, to_ {kind}")


def components(nodes: DataFrame, edges: DataFrame, *, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node; ``root`` is the smallest node of its component.

    Each round hooks every node to the smallest of its neighbours, resolves the resulting chains by
    pointer jumping, and contracts the edges to the new roots, so the edge set shrinks each
    round. Nodes without edges are their own root; null nodes and edges with a null end are ignored.
    """
    labels = cut(nodes.where(F.col(node).isNotNull()).select(node).distinct().withColumn("root", F.col(node)))
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    for _ in range(MAX_ROUNDS):
        links = cut(links)
        left = links.count()
        if not left:
            return labels
        if left <= SMALL:
            hook = _settled(links)
            return cut(labels.join(hook, labels["root"] == hook["from_"], "left").select(node, F.coalesce("to_", "root").alias("root")))
        both = links.unionByName(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        hook = both.groupBy(F.col("lo").alias("from_")).agg(F.min("hi").alias("near"))
        hook = cut(hook.select("from_", F.least("from_", "near").alias("to_")))
        # Pointer jumping until no pointer moves: to(from) := to(to(from)). The distance covered doubles each time.
        while True:
            up = hook.select(F.col("from_").alias("to_"), F.col("to_").alias("top"))
            nxt = cut(hook.join(up, "to_").select("from_", F.col("top").alias("to_"), (F.col("top") != F.col("to_")).alias("moved")))
            done = nxt.where("moved").isEmpty()
            hook = nxt.drop("moved")
            if done:
                break
        labels = labels.join(hook, labels["root"] == hook["from_"], "left").select(node, F.coalesce("to_", "root").alias("root"))
        labels = cut(labels)
        lo = hook.select(F.col("from_").alias("lo"), F.col("to_").alias("lo2"))
        hi = hook.select(F.col("from_").alias("hi"), F.col("to_").alias("hi2"))
        links = both.join(lo, "lo").join(hi, "hi").where("lo2 <> hi2")
        links = links.select(F.least("lo2", "hi2").alias("lo"), F.greatest("lo2", "hi2").alias("hi")).distinct()
    raise RuntimeError("components did not converge")
