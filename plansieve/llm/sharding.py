"""Minimax contiguous partition of documents into shards.

Groups of equal texts are atomic. Ordered by the smallest row key in each, then by the text's
digest, they are cut into contiguous runs such that the largest run is as small as possible:
binary search over the capacity, each capacity checked greedily, then cut there. Groups that
exceed an even share of what is left (fewer than `shards`) come first in the order and fill
shards of their own, so that one giant group does not set the capacity of all other shards.

The groups themselves never reach the driver. It sees sums over nested ranges of their numbers
in the order (at most `fan` times the open ranges at once): the search over range borders
brackets the best capacity, the bracket says in which ranges the cuts of any capacity within it
can fall, and only those are split further, until a range holds one group.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansieve.llm.common import cut
from plansieve.storage import row_numbers


def greedy(prefix: list[int], shards: int, cap: int) -> list[int] | None:
    """Indices (into prefix) where each run ends when runs are filled up to cap; None if too many."""
    ends, at, n = [], 0, len(prefix) - 1
    while at < n:
        if len(ends) == shards:
            return None
        to = bisect_right(prefix, prefix[at] + cap, at) - 1
        if to == at:
            return None
        ends.append(to)
        at = to
    return ends


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity that fits ordered sizes into the shards, and the run ends."""
    prefix = [0, *accumulate(sizes)]
    low, high = max(max(sizes, default=0), -(-prefix[-1] // shards)), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(prefix, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy(prefix, shards, low) or []


def find_cuts(groups: DataFrame, key: str, size: str, shards: int, budget: int = 65536) -> list[int]:
    """Last key of each run but the final one. `groups` has one row for each group.

    At most about `budget` sums come to the driver in one step; each step splits the open
    ranges, so a handful of steps reach single groups at any number of rows.
    """
    lo, hi, total, top = groups.agg(F.min(key), F.max(key), F.sum(size), F.max(size)).first()
    if lo is None:
        return []
    total, top = int(total), int(top)
    least = max(top, -(-total // shards))
    ranges = [(lo, hi, total)]  # first and last key, sum of sizes: disjoint, ascending
    while True:
        sizes = [r[2] for r in ranges]
        prefix = [0, *accumulate(sizes)]
        # range borders are possible cuts, so the best capacity over borders is an upper bound ...
        most, ends = minimax(sizes, shards)
        # ... and run k of any capacity in between ends at a border that `least` reaches, or after it,
        # and no later than k times the upper bound
        wide, first = set(), 0
        for k in range(1, shards + 1):
            first = bisect_right(prefix, prefix[first] + least) - 1
            last = bisect_right(prefix, k * most) - 1
            wide.update(i for i in range(first, min(last + 1, len(ranges))) if ranges[i][0] < ranges[i][1])
        if not wide:
            return [ranges[e - 1][1] for e in ends[:-1]]
        parts = _split(groups, key, size, [ranges[i] for i in sorted(wide)], max(2, budget // len(wide)))
        ranges = sorted([r for i, r in enumerate(ranges) if i not in wide] + parts)


def _split(groups: DataFrame, key: str, size: str, ranges: list[tuple[int, int, int]], fan: int) -> list:
    """Sums over `fan` parts of each range."""
    rows = [(i, lo, hi, -(-(hi - lo + 1) // fan)) for i, (lo, hi, _) in enumerate(ranges)]
    # the cell of a key, as wide as the widest range, tells by an equi-join in which range it falls
    cell = max(hi - lo + 1 for _, lo, hi, _ in rows)
    cells = [(c, *r) for r in rows for c in range(r[1] // cell, r[2] // cell + 1)]
    side = groups.sparkSession.createDataFrame(cells, "_c long, _r long, _lo long, _hi long, _w long")
    k = F.col(key)
    found = (
        groups.withColumn("_c", F.expr(f"({key} - pmod({key}, {cell}L)) div {cell}L"))
        .join(F.broadcast(side), "_c")  # at most two cells for each of fewer than `budget` ranges
        .where(k.between(F.col("_lo"), F.col("_hi")))
        .groupBy("_r", F.floor((k - F.col("_lo")) / F.col("_w")).alias("_b"))
        .agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(size).alias("s"))
    )
    return [(r["lo"], r["hi"], int(r["s"])) for r in found.collect()]


def giants(groups: DataFrame, order: str, size: str, shards: int) -> list[int]:
    """Numbers of the groups, largest first, that fill a shard of their own: each holds an even share of what it and smaller ones leave to the shards left, or more."""
    total = groups.agg(F.sum(size)).first()[0]
    out: list[int] = []
    for at, s in groups.select(order, size).orderBy(F.desc(size), order).limit(shards - 1).collect():
        if s * (shards - len(out)) < total:
            break
        out.append(at)
        total -= s
    return out


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots_per_bin: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; equal texts share a shard.

    size: UTF-8 bytes plus 1 (null text: 1, equal to no empty text but to other null texts).
    Groups are ordered by their smallest id, null first, and by digest, so groups whose ids are
    shared or null are told apart. slot numbers the rows of a shard from 0 without gaps, in an
    order fixed by the rows. A group of a third of all rows is one unit by definition; nothing
    gathers it: group sums are combined before the shuffle, the join back is a plain equi-join
    that may split hot keys, and slots are counted per (shard, bin of id) and then offset.
    """
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("_text"),
        )
    )
    first = F.when(F.count_if(F.col("doc_id").isNull()) == 0, F.min(F.col("doc_id").cast("long")))
    groups = rows.groupBy("_text").agg(first.alias("_first"), F.sum("size").alias("_size"))
    groups = cut(row_numbers(groups, ["_first", "_text"], "_at"))
    alone = giants(groups, "_at", "_size", shards) if shards > 1 else []
    rest = groups.where(~F.col("_at").isin(alone)) if alone else groups
    cuts = find_cuts(rest, "_at", "_size", shards - len(alone))
    at = sum((F.when(F.col("_at") > c, 1).otherwise(0) for c in cuts), F.lit(len(alone)))
    for i, g in enumerate(alone):
        at = F.when(F.col("_at") == g, i).otherwise(at)
    placed = rows.join(groups.select("_text", at.cast("int").alias("shard")), "_text")
    return number(placed.select("doc_id", "size", "text_crc32", "shard"), slots_per_bin)


def number(rows: DataFrame, per_bin: int) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, without sorting a whole shard in one task."""
    rows = cut(rows)
    bins = max(1, -(-rows.count() // per_bin))
    binned = rows.withColumn("_bin", F.when(F.lit(bins) > 1, F.pmod(F.xxhash64("doc_id"), F.lit(bins))).otherwise(0))
    starts = (
        binned.groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "_bin", F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("shard", "_bin").orderBy("doc_id", "text_crc32", "size")
    return (
        binned.join(starts, ["shard", "_bin"])
        .withColumn("slot", (F.col("_start") + F.row_number().over(within) - 1).cast("long"))
        .drop("_bin", "_start")
    )


def report(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
