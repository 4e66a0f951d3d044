"""Minimax contiguous partition of documents into shards of near equal bytes.

Equal texts form an atomic group. Groups are ordered by a 64-bit hash of their
text (equal hashes are one group, so a collision only makes a group larger),
and 16 consecutive runs of groups become the shards. The capacity is the least
for which a greedy fill needs no more shards than there are; it is found by
binary search.

The group sizes stay distributed. The driver holds sums over ranges of the hash
space; a greedy fill on sums gives each cut an interval of ranges, only those
are split further, and the search goes on until the intervals hold single
groups. Each level is one aggregation that returns at most SPLIT sums for each
of the few open ranges.

Null and empty texts have size 1 and are two groups; rows that repeat are kept.
An empty table gives no rows. All columns but id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hashed, stored

SPLIT_BITS = 10  # a range is split into 2**10 parts
SLOT_ROWS = 50_000  # rows that one window of the numbering holds, about


def feasible_cuts(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Greedy check: the starts of the runs that fill shards up to a capacity, None if too many are needed."""
    starts, load = [0], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if load + size > capacity:
            if len(starts) == shards:
                return None
            starts.append(i)
            load = 0
        load += size
    return starts


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity of ordered atomic sizes, by binary search, and its cuts."""
    low, high = max([*sizes, -(-sum(sizes) // shards)], default=0), max(sum(sizes), 0)
    while low < high:
        mid = (low + high) // 2
        if feasible_cuts(sizes, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low, feasible_cuts(sizes, shards, low) or [0]


class Ranges:
    """Sums of group sizes over disjoint ranges of the hash space, refined where the search needs it.

    A range is (prefix, bits): the keys whose top bits are the prefix. It is
    atomic if it holds one key. ``split`` returns {(prefix, bits): rows of
    (child, size, smallest key, largest key)}.
    """

    def __init__(self, split):
        self.split = split
        self.parts = self._children([(0, 0)])[(0, 0)]

    def _children(self, parents):
        found = self.split(parents)
        out = {}
        for prefix, bits in parents:
            step = min(SPLIT_BITS, 64 - bits)
            out[(prefix, bits)] = [((prefix << step | child, bits + step), size, lo, hi) for child, size, lo, hi in sorted(found.get((prefix, bits), []))]
        return out

    def cuts(self, shards: int) -> list[int]:
        """The first keys of the second and later shards of the smallest feasible capacity."""
        while True:
            sizes = [p[1] for p in self.parts]
            if not sizes:
                return []
            whole = sum(sizes)
            atomic = [p[1] for p in self.parts if p[2] == p[3]]
            low, high = max([-(-whole // shards), *atomic]), whole
            # least capacity that a fill may have if ranges could be cut anywhere, and one that surely suffices
            sure, _ = minimax_cuts(sizes, shards)
            high = min(high, sure)
            while low < high:
                mid = (low + high) // 2
                if self._fill(shards, mid) is None:
                    low = mid + 1
                else:
                    high = mid
            capacity = low
            fill = self._fill(shards, capacity)
            crossed = sorted({i for i, exact in fill if not exact})
            if not crossed:
                return [self.parts[i][2] for i, _ in fill]
            wide = crossed
            new = self._children([self.parts[i][0] for i in wide])
            for i in reversed(wide):
                self.parts[i : i + 1] = new[self.parts[i][0]]

    def _fill(self, shards: int, capacity: int):
        """A fill that may end a shard inside a range of several groups: (range, whether it starts the shard) for each later shard."""
        prefix = [0]
        for p in self.parts:
            prefix.append(prefix[-1] + p[1])
        at, cuts, whole = 0, [], prefix[-1]
        while at + capacity < whole:
            if len(cuts) == shards - 1:
                return None
            end = at + capacity
            i = bisect_right(prefix, end) - 1  # the range that the shard's end falls into
            if prefix[i] == end or self.parts[i][2] == self.parts[i][3]:
                if prefix[i] <= at:
                    return None
                cuts.append((i, True))
                at = prefix[i]
            else:
                cuts.append((i, False))
                at = end
        return cuts


def shard_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Cuts of a frame (key long, size long), whose keys count as unsigned."""
    ordered = groups.select(F.expr("key ^ -9223372036854775808").alias("k"), "size")  # signed order is the unsigned one

    def split(parents):
        found: dict = {}
        if parents == [(0, 0)]:
            rows = ordered
        else:
            inside = None
            for prefix, bits in parents:
                lo = (prefix << (64 - bits)) - (1 << 63)
                test = F.col("k").between(lo, lo + (1 << (64 - bits)) - 1)
                inside = test if inside is None else inside | test
            rows = ordered.filter(inside)
        bits = [b for _, b in parents]
        unsigned = F.expr("k ^ -9223372036854775808")
        part, child = F.lit(None).cast("int"), F.lit(None).cast("int")
        for n, (prefix, b) in enumerate(parents):
            lo = (prefix << (64 - b)) - (1 << 63)
            test = F.col("k").between(lo, lo + (1 << (64 - b)) - 1)
            step = min(SPLIT_BITS, 64 - b)
            part = F.when(test, n).otherwise(part)
            child = F.when(test, F.shiftrightunsigned(unsigned, 64 - b - step).bitwiseAND((1 << step) - 1).cast("int")).otherwise(child)
        assert len(bits) == len(parents)
        got = rows.groupBy(part.alias("part"), child.alias("child")).agg(F.sum("size").alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        for r in got.collect():  # at most 2**SPLIT_BITS rows for each of at most shards - 1 ranges
            found.setdefault(parents[r["part"]], []).append((r["child"], r["size"], r["lo"], r["hi"]))
        return found

    return Ranges(split).cuts(shards)


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    rows = stored(
        df.select(
            F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long").alias("text_crc32"), hashed(text_col).alias("key"),
        ), "shard-sizes",
    )
    cuts = shard_cuts(rows.select("key", "size"), shards)
    k = F.expr("key ^ -9223372036854775808")
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (k >= cut).cast("int")
    n = rows.count()
    cells = max(1, -(-n // (shards * SLOT_ROWS)))
    # slots: rows are numbered inside cells of bounded size, dealt by id so that a group of copies does not meet in one
    placed = rows.select("id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(cells)).alias("cell"))
    counts = {(r["shard"], r["cell"]): r["n"] for r in placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).collect()} if cells * shards <= 1 << 16 else None
    if counts is not None:
        before, at = [], {}
        for (s, c), m in sorted(counts.items()):
            before.append((s, c, at.get(s, 0)))
            at[s] = at.get(s, 0) + m
        offsets = df.sparkSession.createDataFrame(before or [(0, 0, 0)], "shard int, cell long, first long")
    else:
        offsets = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
        offsets = offsets.selectExpr("shard", "cell", "sum(n) over (partition by shard order by cell) - n as first")
    numbered = placed.selectExpr("*", "row_number() over (partition by shard, cell order by id, size, text_crc32) - 1 as nth")
    offsets = F.broadcast(offsets) if counts is not None else offsets
    return numbered.join(offsets, ["shard", "cell"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def shard_files(df: DataFrame, assigned: DataFrame, id_col: str, path: str) -> None:
    """Write the rows as one folder for each shard, in files of slot order; df's rows are found by a unique id."""
    both = df.join(assigned.select(F.col(id_col), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), id_col)
    both.repartition(max(1, -(-both.count() // SLOT_ROWS)), "_shard", F.floor(F.col("_slot") / SLOT_ROWS)).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
