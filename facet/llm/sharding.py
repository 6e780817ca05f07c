"""Sharding by minimax contiguous partition.

Documents with equal texts (by SHA-256; a null text counts as empty) form atomic groups, ordered
by that hash.  The smallest shard capacity for which the ordered groups fit, whole and in order,
into the given number of shards is found by binary search with a greedy check, and the groups are
cut under it, each cut moved back from where the shard is full towards its equal share as far as
the later shards have room.

The order is a table of prefix sums that never leaves the cluster.  The search sees it through a
bounded set of known prefix sums: with the gaps between them it brackets the capacity from both
sides, and each round one pass over the table fetches at most ``points`` more prefix sums from
just those gaps that the two bounds still disagree on, until the bounds meet.  The result is exact.

Defined results: texts of any length count whole, ids may be null and may repeat; an empty table gives an empty result; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, durable, salted

_BUCKETS = 4096  # of the order: their totals are summed up in one task
OVERHEAD = 16


class _Search:
    """Known prefix sums (``ends``), and for each whether unknown ones lie between it and the one before."""

    def __init__(self, total: int, shards: int, least: int):
        self.total, self.shards, self.least = total, shards, least
        self.ends, self.vague = [0, total], [False, True]

    def cut(self, x: int, hopeful: bool) -> int:
        """The last place not beyond x where a cut is surely possible, or (hopeful) may be possible."""
        i = bisect_right(self.ends, x) - 1
        return min(x, self.ends[i + 1] - 1) if hopeful and i + 1 < len(self.ends) and self.vague[i + 1] else self.ends[i]

    def cuts(self, capacity: int, hopeful: bool) -> list[int] | None:
        found, at = [], 0
        for _ in range(self.shards):
            to = self.cut(at + capacity, hopeful)
            found.append(to)
            if to >= self.total:
                return found
            if to == at:
                return None
            at = to
        return None

    def capacity(self, hopeful: bool) -> int:
        low, high = max(self.least, -(-self.total // self.shards)), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, hopeful) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def level(self, capacity: int) -> list[int]:
        """Cuts that keep to the capacity, each as near to its equal share as that allows."""
        cuts = self.cuts(capacity, False)
        last = len(cuts)
        least = [self.total] * last  # the rest fits into the shards after this one only from here on
        for k in range(last - 2, -1, -1):
            least[k] = self.ends[bisect_left(self.ends, least[k + 1] - capacity)]
        at = 0
        for k in range(last - 1):
            share = (k + 1) * self.total // last
            i = bisect_right(self.ends, share)
            near = min(self.ends[max(0, i - 1) : i + 1], key=lambda e: abs(e - share))
            at = cuts[k] = min(max(near, least[k], at), self.cut(at + capacity, False))
        return cuts

    def gaps(self, low: int, high: int) -> list[tuple[int, int]]:
        """Vague gaps, as (start, end) without the ends, that the cuts for capacities low to high may fall into."""
        a, z = 0, 0
        spans = []
        for _ in range(self.shards):
            a, z = self.cut(a + low, False), self.cut(z + high, True)
            spans.append((a, z))
        found = set()
        for a, z in spans:
            i = bisect_right(self.ends, a)
            while i < len(self.ends) and self.ends[i - 1] <= z:
                if self.vague[i]:
                    found.add((self.ends[i - 1], self.ends[i]))
                i += 1
        merged: list[tuple[int, int]] = []
        for a, z in sorted(found):
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], z)
            else:
                merged.append((a, z))
        return merged

    def learn(self, gaps: list[tuple[int, int]], rows: list[tuple[int, int, int]]) -> None:
        """rows: (least end, largest end, number of ends) of each cell; together they hold all ends inside the gaps."""
        at = dict(zip(self.ends, self.vague))
        known = self.ends
        for a, z in gaps:
            for e in known[bisect_right(known, a) : bisect_right(known, z)]:
                at[e] = False
        for low, high, n in rows:
            inside = set(known[bisect_left(known, low) : bisect_right(known, high)]) | {low, high}
            for e in inside:  # a cell may hold ends that were known before; what is unknown may lie between any two
                at[e] = n > len(inside) and e != low
        pairs = sorted(at.items())
        self.ends, self.vague = [p[0] for p in pairs], [p[1] for p in pairs]


def minimax_cuts(prefix: DataFrame, total: int, shards: int, least: int, points: int = 65536) -> tuple[int, list[int]]:
    """(capacity, where each shard ends) over the column ``end`` of prefix sums."""
    search = _Search(total, shards, least)
    gaps = [(0, total)]
    while True:
        length = sum(z - a for a, z in gaps)
        cell, base = F.lit(None).cast("long"), 0
        inside = F.lit(False)
        for a, z in gaps:
            cells = max(1, points * (z - a) // length)
            width = -(-(z - a) // cells)
            here = (F.col("end") > a) & (F.col("end") < z)
            cell = F.when(here, F.lit(base) + F.floor((F.col("end") - a) / width)).otherwise(cell)
            inside, base = inside | here, base + cells + 1
        rows = prefix.where(inside).groupBy(cell.alias("c")).agg(F.min("end").alias("a"), F.max("end").alias("z"), F.count(F.lit(1)).alias("n")).collect()
        search.learn(gaps, [(r["a"], r["z"], r["n"]) for r in rows])
        low, high = search.capacity(True), search.capacity(False)
        gaps = search.gaps(low, high)
        if low == high or not gaps:
            return high, search.level(high)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", points: int = 65536) -> DataFrame:
    """id_col, size, text_crc32, shard, slot, capacity: slots are gapless from 0 in each shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("g"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("crc"),
    )
    rows = durable(salted(rows, [F.col("id")], SALTS))
    parts = rows.groupBy("g", "_salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    groups = groups.withColumn("b", F.shiftright(F.conv(F.hex(F.substring("g", 1, 2)), 16, 10).cast("int"), 4))  # in the order of g
    totals = groups.groupBy("b").agg(F.sum("n").alias("bn"), F.sum("bytes").alias("bb"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over _BUCKETS rows at most
    totals = totals.select("b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bb").over(before), F.lit(0)).alias("b0"))
    inner = Window.partitionBy("b").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    prefix = groups.join(F.broadcast(totals), "b").select(
        "g", "bytes", (F.col("b0") + F.sum("bytes").over(inner)).alias("end"), (F.col("n0") + F.sum("n").over(inner) - F.col("n")).alias("row0"),
    )
    prefix = durable(prefix)
    total, least = prefix.agg(F.max("end"), F.max("bytes")).first()
    capacity, cuts = (0, []) if total is None else minimax_cuts(prefix, total, shards, least, points)
    at = F.lit(0)
    for c in cuts[:-1]:
        at = at + (F.col("end") > c).cast("int")
    placed = prefix.select("g", "row0", at.alias("shard"))
    starts = placed.groupBy("shard").agg(F.min("row0").alias("start"))  # a row a shard
    placed = placed.join(F.broadcast(starts), "shard").select("g", "shard", (F.col("row0") - F.col("start")).alias("first"))
    ahead = Window.partitionBy("g").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "_salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")).join(placed, "g")
    own = Window.partitionBy("g", "_salt").orderBy("id")
    return rows.join(parts, ["g", "_salt"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("first") + F.col("ahead") + F.row_number().over(own) - 1).cast("long").alias("slot"), F.lit(capacity).cast("long").alias("capacity"),
    )
