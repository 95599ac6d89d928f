"""Sharding by best-fit-decreasing bin packing of indivisible groups (operator 4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import documents, ranked, settle
from .packing import pack

SHARDS = 24
#: Blocks of groups per shard at most, which bounds what the driver packs, whatever the input: 2 * SHARDS * BLOCKS rows.
BLOCKS = 1024


class Gaps:
    """A balanced search tree (treap) of the bins' free capacities: finds the tightest bin that still takes a size."""

    def __init__(self) -> None:
        self.root: list | None = None  # [free, bin, priority, left, right]
        self.state = 88172645463325252

    def _priority(self) -> int:
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.state = x
        return x

    def _split(self, node, key):
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if (node[0], node[1]) < key:
            node[4], right = self._split(node[4], key)
            return node, right
        left, node[3] = self._split(node[3], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[2] > b[2]:
            a[4] = self._merge(a[4], b)
            return a
        b[3] = self._merge(a, b[3])
        return b

    def add(self, free: int, which: int) -> None:
        left, right = self._split(self.root, (free, which))
        self.root = self._merge(self._merge(left, [free, which, self._priority(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least free capacity of at least `size`; ties by its number."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        parent, node = None, right
        while node[3] is not None:
            parent, node = node, node[3]
        if parent is None:
            right = node[4]
        else:
            parent[3] = node[4]
        self.root = self._merge(left, right)
        return node[0], node[1]


def best_fit(sizes: list[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each size; sizes fall. Opens a bin only if no open one takes the size; None if `bins` do not do."""
    gaps, out, opened = Gaps(), [], 0
    for s in sizes:
        found = gaps.take(s)
        if found is None:
            if bins is not None and opened == bins or s > capacity:
                return None
            found, opened = (capacity, opened), opened + 1
        out.append(found[1])
        gaps.add(found[0] - s, found[1])
    return out


def match(sizes: np.ndarray, free: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of falling sizes by best fit into bins of this free space, then into new ones, for packing.pack()."""
    gaps, opened = Gaps(), len(free)
    for which, gap in enumerate(free.tolist()):
        gaps.add(gap, which)
    at, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        found = gaps.take(s)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        at[i], offset[i] = found[1], capacity - found[0]
        gaps.add(found[0] - s, found[1])
    return at, offset


def _by_capacity(groups: DataFrame, capacity: int) -> DataFrame:
    """(group, shard) in shards of a fixed capacity, whose number grows with the data: rounds of tasks, as in packing."""
    big = ranked(groups.where(F.col("total") > capacity), F.col("total").desc(), F.col("group")).select("group", F.col("pos").alias("shard"))
    small = groups.where(F.col("total") <= capacity).select("group", F.col("total").alias("length"))
    placed = settle(pack(small, capacity, fit=match).select("group", "sequence_id"))
    numbers = ranked(placed.select("sequence_id").distinct(), F.col("sequence_id")).select("sequence_id", (F.col("pos") + big.count()).alias("shard"))
    return big.unionByName(placed.join(settle(numbers), "sequence_id").select("group", "shard"))


def near_equal(sizes: list[int], bins: int) -> list[int]:
    """Best fit of falling sizes into `bins` bins under the least capacity, to one part in 4096, that does.

    A size above the fair share of what is left gets a bin of its own, so that it does not raise the others' capacity.
    """
    alone, rest = 0, sum(sizes)
    while alone < len(sizes) and alone < bins - 1 and sizes[alone] * (bins - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    tail, left = sizes[alone:], bins - alone
    if not tail:
        return list(range(alone))
    low = max(-(-rest // left), tail[0])
    step = max(1, low // 4096)
    k, best = 1, best_fit(tail, low, left)
    if best is None:
        while (best := best_fit(tail, low + k * step, left)) is None:
            k *= 2
        bad = k // 2
        while k - bad > 1:
            mid = (k + bad) // 2
            if (got := best_fit(tail, low + mid * step, left)) is None:
                bad = mid
            else:
                k, best = mid, got
    return [*range(alone), *(alone + b for b in best)]


def shard(rows: DataFrame, shards: int | None = SHARDS, blocks: int = BLOCKS, capacity: int | None = None) -> DataFrame:
    """Adds `shard` and `slot` (gapless from 0 in its shard) to rows of doc_id, size (long) and group (any type).

    Rows of one group stay together. With `shards`, their sizes are made as near equal as groups allow; with `capacity`
    instead, as few shards of that capacity as best-fit-decreasing finds (a larger group gets a shard of its own): their
    number grows with the data, so groups are range-sorted and dealt to tasks that pack them, in rounds.
    With `shards` groups, sorted by falling size, are cut where the running sum passes a multiple of a block (1/`blocks` of
    a shard), so large groups stay alone and small ones, far below a shard, travel in blocks: the driver packs at most
    2 * shards * blocks blocks. Both find the tightest shard through a tree of free capacities.
    Null groups are one group; null sizes count 0; equal rows are rows of their own; other columns stay. An empty table
    gives no rows.
    """
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    groups = rows.groupBy("group").agg(F.sum("size").alias("total"))
    if not shards:
        return _placed(rows, settle(_by_capacity(settle(groups), capacity).select(F.col("group").alias("g"), F.col("shard").cast("int"))), few=False)
    order = ranked(groups, F.col("total").desc(), F.col("group"), weight="total")
    whole = groups.agg(F.sum("total")).first()[0] or 0
    unit = max(1, whole // (shards * blocks))
    # A run of small groups starts in one unit; all but the first group of a unit are smaller than a unit.
    order = settle(order.select("group", "total", F.expr(f"before div {unit}").alias("block")))
    items = sorted(((r.total, r.block) for r in order.groupBy("block").agg(F.sum("total").alias("total")).collect()), key=lambda x: (-x[0], x[1]))
    sizes = [s for s, _ in items]
    bins = near_equal(sizes, shards)
    placed = rows.sparkSession.createDataFrame(
        [(b, x) for (_, b), x in zip(items, bins, strict=True)],
        T.StructType([T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType())]),
    )
    return _placed(rows, settle(order.join(F.broadcast(placed), "block").select(F.col("group").alias("g"), "shard")))


def _placed(rows: DataFrame, where: DataFrame, few: bool = True) -> DataFrame:
    """The rows with the shard of their group (where: g, shard) and their slot in it."""
    out = rows.join(where, rows["group"].eqNullSafe(where["g"])).drop("g", "group")
    out = ranked(out, F.col("shard"), F.col("doc_id"), F.col("size"))
    firsts = out.groupBy("shard").agg(F.min("pos").alias("first"))
    return out.join(F.broadcast(firsts) if few else firsts, "shard").withColumn("slot", F.col("pos") - F.col("first")).drop("pos", "first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`. A null text has no bytes (its CRC is that of none) and groups with other null texts."""
    body = F.encode(F.col("text"), "UTF-8")
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit(b""))).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("group"),
    )
    return shard(settle(rows)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
