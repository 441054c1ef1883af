"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child makes a
weighted hash draw for the row, -ln(u) / weight with u hashed from key and
child, and the least draw wins.  A child whose weight grows can only win rows,
and rows move only within the subtrees whose weights change.

A tree for n shards has full regions of the base layout; shards beyond it come
in regions of their own, so that each added shard takes rows only into itself.
Draws use md5, which every SQL engine has, so a placement can be recomputed
anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, partitions

#: Shards of a rack and racks of a region in the base layout.
RACK, REGION = 4, 2


@dataclass(frozen=True)
class Node:
    """A region, a rack or (with ``shard`` set) a leaf; an inner node weighs as much as its children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def layout(base: int, shards: int, weights: dict[int, float] | None = None) -> Node:
    """The tree of shards 0 to ``shards`` - 1: the first ``base`` in racks and regions, each later one in a region of its own."""
    if not 0 < base <= shards:
        raise ValueError("a tree needs a base of one shard or more, and no fewer shards than that")
    leaf = [Node(f"s{i}", shard=i, own=(weights or {}).get(i, 1.0)) for i in range(shards)]
    racks = [Node(f"k{a}", tuple(leaf[a : min(a + RACK, base)])) for a in range(0, base, RACK)]
    regions = [Node(f"r{a}", tuple(racks[a : a + REGION])) for a in range(0, len(racks), REGION)]
    late = [Node(f"rs{i}", (Node(f"ks{i}", (leaf[i],)),)) for i in range(base, shards)]
    return Node("root", (*regions, *late))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """A child's draw: exponentially distributed with the child's weight as rate."""
    digits = F.substring(F.md5(F.concat(name, F.lit(":"), key).cast("binary")), 1, 13)
    even = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(even) / weight


def winner(key: Column, root: Node) -> Column:
    """The shard that a key reaches from a node; of equal draws the first child wins.

    Each level is one table of its inner nodes' children, and each step one
    expression over the children of the node reached, so the plan grows with
    the tree's depth, not with its nodes.  A shard that lies above the lowest
    level stands still from there on.
    """
    level, at = [root], F.lit(0)
    while any(n.children for n in level):
        below: list[Node] = []
        table = []
        for node in level:
            kids = node.children or (node,)
            table.append(F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(c.weight).alias("weight"), F.lit(len(below) + i).alias("i")) for i, c in enumerate(kids))))
            below += kids
        kids = F.get(F.array(*table), at)
        at = F.array_min(F.transform(kids, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("d"), c["i"].alias("i"))))["i"]
        level = below
    return F.get(F.array(*(F.lit(n.shard) for n in level)), at)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each group in the given order, by counts of range pieces.

    A group may hold any share of the rows: the rows are cut into ranges of the
    order once, pieces (range, group) are numbered apart, and only the pieces'
    counts are summed along a group.
    """
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("__piece", F.spark_partition_id())
    ranged = cut(ranged)
    counts = ranged.groupBy(group, "__piece").count()
    along = Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__piece", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__piece", group).orderBy(*order)
    placed = ranged.withColumn("__at", F.row_number().over(within))
    return placed.join(starts, [group, "__piece"]).withColumn("slot", F.col("__start") + F.col("__at") - 1).drop("__piece", "__at", "__start")


def sharded(docs: DataFrame, shards: int = 40, grown: int = 41, base: int = 40) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row.

    The key decides (law ``key``): rows with one doc_id share a shard, all rows
    without one too.  ``size`` is the text's UTF-8 bytes (null: none) plus 16,
    ``text_crc32`` of a null text that of the empty one.  Slots follow
    (doc_id, text_crc32, size) within a shard; equal rows get slots of their
    own in any order.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        winner(key, layout(base, shards)).alias("shard"),
        winner(key, layout(base, grown)).alias("grown_shard"),
    )
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
