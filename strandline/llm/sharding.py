"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard.  At each node every child makes a
hash draw from the row's id and the child's own name, an exponential one divided by the child's
weight; the least draw wins, so a child is chosen in proportion to its weight.  Draws depend on
nothing else: changing a weight moves rows only into or out of that child, and so only within
subtrees whose weights changed.  A tree that grows by one shard gets it as a region of its own,
which takes rows into that shard and moves no row between others.  So how many shards a tree was first
built for is part of it: ``base``, which stays when it grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored

BASE_SHARDS, SHARDS_A_RACK, RACKS_A_REGION = 8, 2, 2


@dataclass(frozen=True)
class Node:
    """A shard (no children) or an inner node, whose weight is that of its children together."""

    name: str
    shard: int | None = None
    own_weight: float = 1.0
    children: Sequence[Node] = field(default_factory=tuple)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def topology(shards: int, weights: Sequence[float] | None = None, base: int = BASE_SHARDS) -> Node:
    """The tree for so many shards: the first ``base`` in regions of racks, each further one in a region of its own."""
    leaves = [Node(f"shard{k}", k, weights[k] if weights else 1.0) for k in range(shards)]
    regions, size = [], SHARDS_A_RACK * RACKS_A_REGION
    for start in range(0, min(base, shards), size):
        part = leaves[start : min(start + size, base, shards)]
        racks = [Node(f"rack{(start + k) // SHARDS_A_RACK}", children=tuple(part[k : k + SHARDS_A_RACK])) for k in range(0, len(part), SHARDS_A_RACK)]
        regions.append(Node(f"region{start // size}", children=tuple(racks)))
    regions += [Node(f"region-of-{x.name}", children=(Node(f"rack-of-{x.name}", children=(x,)),)) for x in leaves[base:]]
    return Node("root", children=tuple(regions))


def unit(doc_id: Column, name: str) -> Column:
    """A number between 0 and 1, both excluded, from an id and a name; null ids count as the text 'null'."""
    digest = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(name)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def descend(doc_id: Column, node: Node) -> Column:
    """The shard in which a row's way down from ``node`` ends."""
    if node.shard is not None:
        return F.lit(node.shard)
    open_to = [c for c in node.children if c.weight > 0]
    if len(open_to) == 1:
        return descend(doc_id, open_to[0])
    draws = [F.struct((-F.log(unit(doc_id, c.name)) / F.lit(float(c.weight))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(open_to)]

    def down(won: Column) -> Column:
        to = F.when(won == 0, descend(doc_id, open_to[0]))
        for k, c in enumerate(open_to[1:], 1):
            to = to.when(won == k, descend(doc_id, c))
        return to

    return let(F.least(*draws)["k"], down)


def shard(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None, base: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard for every row of ``docs``.

    The law is that of a key: id and number of shards decide, and ``grown_shard`` (one shard more) differs
    from ``shard`` only in rows of the new one.  ``base`` is the number of shards that the tree was first
    built for, by default all up to 8; give it when a tree has grown from fewer.

    ``slot`` counts from 0 without gaps within a shard, in the order of a hash of the id, then id, size and
    crc32: hash ranges of a shard are numbered each by itself and then moved by the rows before them, so a
    shard is never sorted by one task.  Null texts have no bytes; rows without an id share one way down.
    Repeated rows stay and get slots of their own.  Other columns of ``docs`` are ignored.
    """
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    base = min(shards, BASE_SHARDS) if base is None else base
    grown = topology(shards + 1, [*weights, 1.0] if weights else None, base)
    placed = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            descend(doc_id, topology(shards, weights, base)).alias("shard"),
            descend(doc_id, grown).alias("grown_shard"),
            unit(doc_id, "slot").alias("at"),
        ),
        "shards",
    )
    ranges = min(1 << 16, 1 + placed.count() // 20_000)
    placed = placed.withColumn("range", F.floor(F.col("at") * ranges).cast("int"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "range").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = Window.partitionBy("shard", "range").orderBy("at", "doc_id", "size", "text_crc32")
    out = placed.join(sizes, ["shard", "range"]).withColumn("slot", F.col("first") + F.row_number().over(own) - 1)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
