"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws ``-ln(u) / weight`` from a
hash of the row's key and the child's name, and the smallest draw wins, so a child is chosen in
proportion to its weight. A child whose weight is unchanged keeps its draws: after a change of
weights a row leaves a subtree only for a subtree whose weight grew (or leaves one that shrank).
All draws are column expressions; placing rows needs no shuffle.

Defined cases: null keys hash as null and all go one way; equal keys go the same way; weights must
be positive; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_SHARDS, REGIONS, RACKS = 40, 2, 4
SIZE_EXTRA = 16
# Rows that one numbering task is meant to hold.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard with its number and weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree_for(shards: int, base: int = BASE_SHARDS, regions: int = REGIONS, racks: int = RACKS) -> Node:
    """The tree of ``shards`` equal shards.

    The first ``base`` shards fill ``regions`` x ``racks`` evenly; each later one is a region of its
    own. The only weight that one more shard changes is then its own, so it takes rows only into
    itself.
    """
    if shards < 1:
        raise ValueError("a tree needs a shard")
    inner = min(shards, base)
    leaves = [Node(f"shard{i}", shard=i) for i in range(inner)]
    # Shards before ``base`` are dealt one by one as well when fewer than base are asked for.
    if shards < base:
        return Node("root", tuple(Node(f"region-{x.name}", (Node(f"rack-{x.name}", (x,)),)) for x in leaves))
    per_rack = math.ceil(inner / (regions * racks))
    built = []
    for r in range(regions):
        rows = []
        for k in range(racks):
            start = (r * racks + k) * per_rack
            if own := leaves[start : start + per_rack]:
                rows.append(Node(f"rack{r}.{k}", tuple(own)))
        if rows:
            built.append(Node(f"region{r}", tuple(rows)))
    for i in range(inner, shards):
        built.append(Node(f"region-shard{i}", (Node(f"rack-shard{i}", (Node(f"shard{i}", shard=i),)),)))
    return Node("root", tuple(built))


def reweighted(node: Node, shard: int, weight: float) -> Node:
    """The tree with another weight for one shard."""
    if node.shard == shard:
        return replace(node, own_weight=weight)
    return replace(node, children=tuple(reweighted(c, shard, weight) for c in node.children))


def shard_of(keys: Sequence[str], tree: Node, seed: int = 17) -> Column:
    """The shard of a row as a column expression."""

    def draw(node: Node) -> Column:
        if node.weight <= 0:
            raise ValueError(f"weight of {node.name} must be positive")
        bits = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(node.name), F.lit(seed)), 11)
        return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(node.weight))

    def descend(node: Node) -> Column:
        if node.shard is not None:
            return F.lit(node.shard)
        if len(node.children) == 1:
            return descend(node.children[0])
        won = F.least(*[F.struct(draw(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)])["i"]
        if all(c.shard is not None for c in node.children):
            return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), won + 1)
        return F.transform(
            F.array(won),
            lambda w: reduce(
                lambda rest, x: F.when(w == x[0], descend(x[1])).otherwise(rest),
                list(enumerate(node.children))[-2::-1],
                descend(node.children[-1]),
            ),
        )[0]

    return descend(tree).cast("int")


def number_in_shards(rows: DataFrame, by: Sequence[str], total: int) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each ``shard``.

    Equal rows are counted first, so a row repeated without end is one row here. Hash buckets of a
    shard are numbered apart and shifted by the rows in the buckets before them; no task holds a
    whole shard.
    """
    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c in by], F.lit(3)), F.lit(buckets)))
    sums = counted.groupBy("shard", "_b").agg(F.sum("_n").alias("_in"))
    earlier = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0))).drop("_in")
    own = Window.partitionBy("shard", "_b").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.join(before, ["shard", "_b"]).withColumn("_end", F.sum("_n").over(own) + F.col("_before"))
    slots = placed.withColumn("slot", F.explode(F.sequence(F.col("_end") - F.col("_n"), F.col("_end") - 1)))
    return slots.select(*rows.columns, "slot")


def place(df: DataFrame, keys: Sequence[str], tree: Node, seed: int = 17, into: str = "shard") -> DataFrame:
    """``df`` with the shard of every row."""
    return df.withColumn(into, shard_of(keys, tree, seed))


def document_slots(documents: DataFrame, shards: int = BASE_SHARDS) -> DataFrame:
    """Size, checksum, shard, slot and the shard with one more, for every document."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + SIZE_EXTRA).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = place(rows, ["doc_id"], tree_for(shards))
    slots = number_in_shards(rows, ["doc_id", "size", "text_crc32"], documents.count())
    return place(slots, ["doc_id"], tree_for(shards + 1), into="grown_shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
