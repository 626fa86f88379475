"""Connected components of an edge table by hooking and contraction.

Every round each vertex hooks to its smallest neighbour, pointers are jumped, and edges are rewritten between
the roots; a round at least halves the vertices that still have edges. All of it is joins and aggregations with
partial sums, so that a vertex with very many edges never meets one task; each round is written out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tidy

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@tidy
def _forest(batches):
    """Keep a spanning forest of each batch of edges: fewer rows, the same components."""
    for b in batches:
        if not b.num_rows:
            continue
        names, ids = np.unique(np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()]), return_inverse=True)
        parent = list(range(len(names)))

        def find(x, parent=parent):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        n = b.num_rows
        for x, y in zip(ids[:n].tolist(), ids[n:].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = np.array([find(x) for x in range(len(names))])
        own = roots != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[roots[own]]), pa.array(names[own])], schema=_EDGES)


def connected_components(spark: SparkSession, edges: DataFrame, work: Scratch, tag: str = "cc") -> DataFrame:
    """(v, root) for every vertex that has an edge; root is the smallest vertex of its component.

    edges: two bigint columns a, b; repeated edges and loops are allowed; an empty table gives an empty result."""
    edges = work.write(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), f"{tag}-e0")
    maps, k = [], 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.least("a", F.min("b")).alias("p"))
        hook = work.write(hook, f"{tag}-h{k}")
        for j in range(2):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            hook = work.write(hook.join(up, "p").select("v", F.col("q").alias("p")), f"{tag}-h{k}-{j}")
        maps.append(hook)
        to_a, to_b = (hook.select(F.col("v").alias(c), F.col("p").alias(f"{c}2")) for c in "ab")
        new = edges.join(to_a, "a").join(to_b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = work.write(new.where("a <> b").distinct(), f"{tag}-e{k + 1}")
        k += 1
    if not maps:
        return spark.createDataFrame([], "v long, root long")
    total = maps[0].select("v", F.col("p").alias("root"))
    for m in maps[1:]:
        total = total.join(m.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
    return work.write(total, f"{tag}-roots")
