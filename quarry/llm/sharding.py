"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards, each with a weight; an inner node weighs what its children
weigh. A key descends from the root: at each node every child draws -ln(u) / weight with u in (0, 1) from
md5(key / child's name), and the least draw wins, so a child is taken with probability weight / sum. A changed
weight changes only its own draw: keys move only into or out of that child, and a subtree whose weights
stay as they were keeps its keys where they were inside it. A shard added as a region of its own
takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import small, written


@dataclass(frozen=True)
class Node:
    """A region, rack or (without children) shard."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int = 8, racks: int = 2, per_rack: int = 2) -> Node:
    """Shards 0.. in racks of per_rack shards and regions of `racks` racks."""
    leaves = [Node(f"s{i}", shard=i) for i in range(shards)]
    rows = [Node(f"k{i // per_rack}", tuple(leaves[i : i + per_rack])) for i in range(0, shards, per_rack)]
    return Node("root", tuple(Node(f"r{i // racks}", tuple(rows[i : i + racks])) for i in range(0, len(rows), racks)))


def grown(root: Node, shard: int) -> Node:
    """root with one more shard, in a region and rack of its own."""
    return Node(root.name, (*root.children, Node(f"r+{shard}", (Node(f"k+{shard}", (Node(f"s{shard}", shard=shard),)),))))


def unit(text: Column) -> Column:
    """A number in (0, 1) from the first 12 hexadecimal digits of md5."""
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def placed(key: Column, node: Node) -> Column:
    """The shard that key (a string) reaches below node."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return placed(key, node.children[0])
    draws = [F.struct((-F.ln(unit(F.concat_ws("/", key, F.lit(c.name)))) / F.lit(c.weight)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]
    took = F.least(*draws)["i"]
    # the winner is bound once (a lambda's variable), not worked out again for each branch
    branch = lambda w: F.coalesce(*[F.when(w == i, placed(key, c)) for i, c in enumerate(node.children)])
    return F.transform(F.array(took), branch)[0]


#: Copies of a row whose slots are made at once.
RUN = 65_536


def shard(docs: DataFrame, root: Node | None = None, more: int | None = None, rows_per_bucket: int = 8_192) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the tree decide. size: UTF-8 bytes and 1 (null text: 1; its crc is
    that of no bytes). grown_shard: the shard after grown(). slot counts a shard's rows from 0 in the order of a hash of
    (doc_id, text_crc32, size); equal rows get one slot each. A null doc_id is the key of an empty string. Repeated
    ids go to one shard; an empty table gives an empty table; other columns are ignored.
    """
    root = root or tree()
    leaves = _leaves(root)
    more = max(leaves) + 1 if more is None else more
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key"))
    # one row for each distinct digest, so copies of a row meet in no task as rows
    groups = written(base.groupBy("doc_id", "size", "text_crc32", "_key").agg(F.count("*").alias("_n")), "digests")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    buckets = max(1, -(-total // rows_per_bucket))
    spot = unit(F.concat_ws("/", "_key", F.col("text_crc32").cast("string"), F.col("size").cast("string"), F.lit("slot")))
    put = groups.select("*", placed(F.col("_key"), root).alias("shard"), placed(F.col("_key"), grown(root, more)).alias("grown_shard"), spot.alias("_spot"))
    put = put.withColumn("_bucket", F.floor(F.col("_spot") * buckets))
    # the buckets split a shard's hash range evenly: rows of a bucket are few whatever the table's size
    sums = put.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
    before = sums.select("shard", "_bucket", (F.sum("_rows").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("_rows")).alias("_base"))
    order = W.partitionBy("shard", "_bucket").orderBy("_spot", "_key", "text_crc32", "size")
    ranked = put.withColumn("_in", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    ranked = ranked.join(small(before, buckets * len(leaves), 200_000), ["shard", "_bucket"])
    # copies of one row come out in runs of bounded length, not from one array
    first, n = F.col("_base") + F.col("_in"), F.col("_n")
    runs = ranked.select("doc_id", "size", "text_crc32", "shard", "grown_shard", first.alias("_first"), (first + n - 1).alias("_last"), F.explode(F.sequence(F.lit(0), F.expr(f"CAST((_n - 1) div {RUN} AS INT)"))).alias("_run"))
    begin = F.col("_first") + F.col("_run").cast("long") * RUN
    return runs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(begin, F.least(begin + (RUN - 1), F.col("_last")))).alias("slot"), "grown_shard")


def _leaves(node: Node) -> list[int]:
    return [s for c in node.children for s in _leaves(c)] if node.children else [node.shard]


__all__ = ["Node", "grown", "placed", "shard", "tree", "unit"]
