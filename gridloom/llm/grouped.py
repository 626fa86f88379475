"""Links inside groups of any size, found by tasks that each hold a bounded part of one group.

A group is cut into blocks of bounded weight. First every block is linked in itself, together with a few anchors:
members of the group that all its blocks see, so that what is alike in different blocks comes together. Then the
components that this gave are looked at: members outside the largest component of their group are the only ones
that a link could still bring elsewhere. They meet every block of their group, again in parts of bounded weight.
So no link is lost, no task holds a group, and where copies of one thing make a group large its blocks are read
once and not compared with each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, tidy, whole_groups
from .components import connected_components

#: Members of a large group that all its blocks see.
ANCHORS = 64
#: Ways in which the rows of one group are dealt to meet what is known of the group.
SALTS = 16

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@tidy
def _link(batches, local):
    """Rows (g, b, c, id, payload..) sorted by the first four. Out: (root, id) for members that local(payload columns) gives another root."""
    for t, starts in whole_groups(batches, 3):
        ids, ends = t.column(3).to_numpy(), np.append(starts[1:], t.num_rows)
        a, b = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s > 1:
                root = local([t.column(k).slice(s, e - s) for k in range(4, t.num_columns)])
                own = np.flatnonzero(root != np.arange(e - s))
                a.append(ids[s + root[own]])
                b.append(ids[s + own])
        if a:
            yield batch(_EDGES, np.concatenate(a), np.concatenate(b))


def _dealt(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right (a row a group) on g, dealt by identifiers too, so that a large group does not meet in one task."""
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"], how).drop("salt")


def group_links(spark: SparkSession, members: DataFrame, payload: Callable[[DataFrame], DataFrame], local: Callable, limit: int, work: Scratch, tag: str) -> DataFrame:
    """(a, b): links among the members of each group, enough of them to connect what links connect.

    members: g, id, w (bigint; weight); payload joins the columns that local reads to rows with an id; local gives for
    each of its rows the first row that links reach from it, and loses none. limit: the weight of a block.

    Cases: an id may be in several groups; members repeated in a group change nothing; an empty table gives no link."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = members.select("g", "id", "w")

    def linked(rows, name):
        rows = payload(rows.select("g", "b", "c", "id"))
        rest = [c for c in rows.columns if c not in ("g", "b", "c", "id")]
        rows = rows.select("g", "b", "c", "id", *rest).repartition(parts, "g", "b", "c").sortWithinPartitions("g", "b", "c", "id")
        return work.write(rows.mapInArrow(partial(_link, local=local), "a long, b long"), f"{tag}-{name}")

    sizes = work.write(members.groupBy("g").agg(F.sum("w").alias("total")).where(F.col("total") > limit).select("g", F.ceil(F.col("total") / limit).cast("int").alias("blocks")), f"{tag}-large")
    zero = F.lit(0).alias("c")
    if sizes.isEmpty():
        return linked(members.select("g", F.lit(0).alias("b"), zero, "id"), "links")
    place = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).cast("int")
    placed = work.write(_dealt(members, sizes, "left").select("g", "id", "w", "blocks", F.coalesce(place, F.lit(0)).alias("b")), f"{tag}-placed")
    large = placed.where("blocks is not null")
    first = large.select("g", "id", "blocks", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("id"), "id")).alias("n")).where(F.col("n") <= ANCHORS)
    seen = first.select("g", F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"), zero, "id")
    links = linked(placed.select("g", "b", zero, "id").union(seen), "links")
    roots = connected_components(spark, links, work, f"{tag}-cc")
    whole = large.join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id"))
    whole = work.write(whole.select("g", "id", "w", "blocks", "b", "comp"), f"{tag}-whole")
    main = whole.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max(F.struct("n", "comp")).alias("m")).select("g", F.col("m.comp").alias("main"))
    main = work.write(main, f"{tag}-main")
    minor = work.write(_dealt(whole, main).where("comp <> main").select("g", "id", "w", "blocks"), f"{tag}-minor")
    if minor.isEmpty():
        return links
    chunks = work.write(minor.groupBy("g").agg(F.ceil(F.sum("w") / limit).cast("int").alias("chunks")), f"{tag}-chunks")
    asked = _dealt(minor, chunks).select("g", F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"), F.expr("cast(pmod(xxhash64(7, id), chunks) as int)").alias("c"), "id")
    there = _dealt(whole, chunks).select("g", "b", F.explode(F.expr("sequence(0, chunks - 1)")).alias("c"), "id")
    return links.union(linked(asked.union(there), "links-minor"))
