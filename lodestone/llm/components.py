"""Connected components of an edge table by alternating large-star and small-star rounds.

Before each round every task contracts its own edges, ``CHUNK`` at a time, to one for
each vertex, to the least of its component there. So a vertex has at most one edge
to a smaller one for each chunk, edges that say the same are few, and a round
needs one shuffle for each star. Edges meet at their vertices; a hub, a vertex with
more edges than a share 1 / HUBS of all (so there are few of them), has its least neighbour found on the map side, and
its edges stay where they are. Only a flag and the hubs reach the driver. An empty table has no components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, drop_stored, local_rows, stored

#: A vertex is a hub over FEW edges and a share 1 / HUBS of all.
HUBS, FEW = 1 << 14, 1 << 9
#: Edges that a task contracts at a time.
CHUNK = 1 << 20


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of n items to the least of its component in the graph of pairs (a, b), where it isn't that itself."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label < np.arange(n))
    return moved, label[moved]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v the lesser, with the same components: those that span each chunk's."""

    def contract(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield star(held)
                held = []
        if held:
            yield star(held)

    def star(held):
        t = pa.Table.from_batches(held)
        u, v = (t.column(c).to_numpy() for c in ("u", "v"))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        moved, least = spanning(len(names), at[: len(u)], at[len(u) :])
        return pa.RecordBatch.from_arrays([pa.array(names[x], t.schema.field("u").type) for x in (moved, least)], names=["u", "v"])

    pairs = edges.select("u", "v")
    return pairs.transform(arrow, contract, pairs.schema)


def _state(edges: DataFrame, n: int) -> tuple[bool, DataFrame | None]:
    """Whether edges remain that aren't from a vertex to the one least of its component, and u, m: the hubs and their least neighbours, at most 2 * HUBS rows."""
    ends = edges.select("u", F.col("v").alias("down"), F.lit(None).cast(edges.schema["v"].dataType).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast(edges.schema["v"].dataType).alias("down"), F.col("u").alias("up")))
    of = ends.groupBy("u").agg(F.count("*").alias("n"), F.min("down").alias("m"), F.max("down").alias("other"), F.count("up").alias("ups"))
    open_ = F.max((F.col("m") < F.col("other")) | (F.col("m").isNotNull() & (F.col("ups") > 0)))
    hubs = F.collect_list(F.when(F.col("n") > max(FEW, n // HUBS), F.struct("u", F.coalesce("m", "u").alias("m"))))
    r = of.agg(open_.alias("open"), hubs.alias("hubs")).first()
    schema = edges.select("u", F.col("v").alias("m")).schema
    return bool(r.open), local_rows(edges.sparkSession, [(x.u, x.m) for x in r.hubs], schema) if r.hubs else None


def _large_star(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Every vertex's larger neighbours point at its least neighbour, or at itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = lambda x: x.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = F.least("u", F.min("v").over(Window.partitionBy("u")))
    if hubs is None:
        return larger(both.withColumn("m", least))
    marked = both.join(F.broadcast(hubs), "u", "left")
    return larger(marked.where("m is null").withColumn("m", least)).unionByName(larger(marked.where("m is not null")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge's larger end points at the least of its smaller neighbours, and so do these."""
    least = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of one orderable type -> (node, component), the least node reachable; isolated nodes aren't listed."""
    edges = stored(_contracted(edges), "edges")
    while n := edges.count():
        moving, hubs = _state(edges, n)
        if not moving:
            break
        moved = stored(_small_star(_large_star(edges, hubs)), "edges")
        drop_stored(edges)
        edges = stored(_contracted(moved), "edges")
        drop_stored(moved)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
