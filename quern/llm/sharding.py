"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups are rows of equal text, in the order of a hash of that text; a group
never parts. The smallest capacity under which contiguous runs of groups fill
the given number of shards is found by binary search, each capacity checked
greedily. Cuts then stand as near to equal sizes as that capacity allows.

The search needs group sizes in order, which grow with the input, but only near
the cuts. So it runs over cells: ranges of the hash with their total sizes, 4,096
at first. A capacity found feasible when cells may not be cut, and one found
infeasible even when they may, bound the answer; every cell in which a cut could
then stand and that holds more than one group is split into 256 by one more
aggregation, until both bounds meet. The driver holds a bounded number of cells;
all passes but the first read a narrow table without the text.

Slots number the rows of a shard from 0: rows are dealt to buckets by a hash of
id and group, numbered within a bucket, and moved by the counts of the buckets
before. Hot groups spread over all buckets.

Edge cases: a null text is a group of its own, of no bytes, apart from empty
texts; every row counts one byte besides its text; unlike texts whose hashes
agree share a group; a shard may stay empty where there are fewer groups than
shards; rows that repeat an id keep slots of their own; an empty table gives an
empty table; further columns are ignored unless carried.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import pick

SHARDS = 16
#: Bits of the hash that make the first cells, and by which a cell is split.
FIRST_BITS, MORE_BITS = 12, 8
#: Rows of a shard and bucket that are numbered together, about, in a large table; buckets at least.
SLOT_ROWS, SLOT_BUCKETS = 65_536, 64


@dataclass(frozen=True)
class Cell:
    """Rows whose hash begins with ``bits`` bits of ``value``; one group only if ``first == last``."""

    bits: int
    value: int
    size: int
    first: int
    last: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


class Line:
    """Cells in order with the bytes before each."""

    def __init__(self, cells: list[Cell]) -> None:
        self.cells = sorted(cells, key=lambda c: c.first)
        self.before = list(accumulate((c.size for c in self.cells), initial=0))
        self.total = self.before[-1]

    def furthest(self, start: int, capacity: int, divide: bool) -> int:
        """How far a shard that starts at byte ``start`` can reach; cells of several groups count as cut anywhere if ``divide``."""
        end = start + capacity
        if end >= self.total:
            return self.total
        i = bisect_right(self.before, end) - 1
        return end if divide and not self.cells[i].atomic else max(start, self.before[i])

    def cuts(self, capacity: int, shards: int, divide: bool) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = self.furthest(at, capacity, divide)
            out.append(at)
        return out

    def smallest(self, shards: int, divide: bool) -> int:
        """Binary search for the least capacity with which ``shards`` greedy steps reach the end."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, divide)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def doubtful(self, shards: int, low: int, high: int) -> list[Cell]:
        """Cells of several groups in which a greedy cut could stand for a capacity from ``low`` to ``high``."""
        if large := [c for c in self.cells if not c.atomic and 8 * c.size > low]:
            return large
        found: dict[Cell, None] = {}
        for a, b in zip(self.cuts(low, shards, False), self.cuts(high, shards, True), strict=True):
            i, j = bisect_right(self.before, a) - 1, bisect_left(self.before, b)
            found |= dict.fromkeys(c for c in self.cells[max(0, i) : j] if not c.atomic)
        return list(found)

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """The last hash of each shard but the final one: cuts nearest to equal sizes with which ``capacity`` still does."""
        at, out = 0, []
        for left in range(shards - 1, 0, -1):
            ideal = at + (self.total - at) / (left + 1)
            most = bisect_right(self.before, at + capacity) - 1
            low, high = bisect_left(self.before, at), most
            while low < high:  # the first boundary from which the shards left can still reach the end
                mid = (low + high) // 2
                if self._reaches(self.before[mid], capacity, left):
                    high = mid
                else:
                    low = mid + 1
            low = min(max(low, bisect_right(self.before, at)), most)  # no empty shard while groups are left
            i = min(max(bisect_left(self.before, ideal), low), most)
            if i > low and ideal - self.before[i - 1] < self.before[i] - ideal:
                i -= 1
            at = self.before[i]
            out.append(self.cells[i - 1].last if i else -(1 << 63) - 1)
        return out

    def _reaches(self, at: int, capacity: int, shards: int) -> bool:
        for _ in range(shards):
            at = self.furthest(at, capacity, False)
        return at >= self.total


def _cells(rows: DataFrame, bits: int) -> list[Cell]:
    found = rows.groupBy(F.shiftright("key", 64 - bits).alias("value")).agg(F.sum("size"), F.min("key"), F.max("key"))
    return [Cell(bits, *r) for r in found.collect()]


def capacity_and_cuts(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity for ``rows`` of key and size, and the last key of each shard but the final one."""
    line = Line(_cells(rows, FIRST_BITS))
    while True:
        low, high = line.smallest(shards, True), line.smallest(shards, False)
        if low == high:
            return high, line.even_cuts(high, shards)
        split = set(line.doubtful(shards, low, high))
        cells = [c for c in line.cells if c not in split]
        for bits in {c.bits for c in split}:
            values = [c.value for c in split if c.bits == bits]
            part = rows.where(F.shiftright("key", 64 - bits).isin(values))
            cells += _cells(part, min(64, bits + MORE_BITS))
        line = Line(cells)


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """Each row's id, ``size`` in bytes, ``shard`` and ``slot``, and what ``carry`` makes of its id and text."""
    docs = pick(df, id_col, text_col)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    rows = materialize(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.xxhash64(text_col).alias("key"), *[c.alias(f"carry_{n}") for n, c in (carry or {}).items()]), "sizes")
    _, cuts = capacity_and_cuts(rows, shards)
    number = sum(((F.col("key") > F.lit(c)).cast("int") if c >= -(1 << 63) else F.lit(1) for c in cuts), F.lit(0))
    buckets = max(SLOT_BUCKETS, -(-rows.count() // (shards * SLOT_ROWS)))
    dealt = rows.withColumn("shard", number).withColumn("bucket", F.pmod(F.xxhash64("id", "key"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select("shard", "bucket", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "key"))
    out = dealt.withColumn("nth", nth).join(moved, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), *[F.col(f"carry_{n}").alias(n) for n in (carry or {})])
