"""Benchmark decontamination by spaced seeds.

A fixed mask looks at some positions of a window of tokens and ignores the others, so a
substituted token breaks only the seeds that look at it. Seeds of documents and of
benchmark items are joined by hash; each hit fixes an alignment of the two token
sequences, and an alignment counts if some window of WINDOW aligned positions (the whole
item if that is shorter) agrees in at least SHARE of them, rounded up.

Items of each length have masks of their own, such that whichever positions may be
substituted, one mask fits between them: every alignment that counts is found, of items of
any length from one token on. Items of three tokens or fewer must agree wholly.

Tokens are words without characters other than letters and digits, lower-cased. Null items,
and items without a token, match nothing.
Built-in functions only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import SPACE_BYTES, SPACE_PATTERN, cut, pack, unpack

WINDOW, SHARE = 13, 0.75
#: length of an item (WINDOW stands for all longer ones) -> masks; found by exhaustive search, see the tests
MASKS: dict[int, tuple[tuple[int, ...], ...]] = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2), (0, 1, 3), (0, 2, 3)),
    5: ((0, 1, 2), (0, 1, 3)),
    6: ((0, 1, 2),),
    7: ((0, 1, 2),),
    **dict.fromkeys(range(8, 13), ((0, 2, 3, 4), (0, 3, 5, 6), (0, 1, 2, 5))),
    WINDOW: ((0, 2, 3, 4), (0, 3, 5, 6)),
}
#: largest number of benchmark seeds to broadcast (about 100 MB as a hash table); beyond it the join shuffles,
#: with the places of a hot seed's documents dealt over SEED_PARTS tasks
BROADCAST_SEEDS, SEED_PARTS = 1_000_000, 16
#: item tokens that one row of the verification holds, but for a single longer item
VERIFY_TOKENS = 20_000


def tokens(text: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), F.lit(SPACE_BYTES))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, SPACE_PATTERN, -1))


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def needed(n: int) -> int:
    """Tokens that must agree in the best window of an item of n."""
    return ceil(min(n, WINDOW) * SHARE)


def _seed_rows(df: DataFrame, h: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """df's columns but h, and pos, seed: one row for each mask at each position of h where it fits."""
    keep = [c for c in df.columns if c != h]
    col, n = F.col(h), F.size(h)

    def seeds(i: Column) -> Column:
        # the offsets are part of the hash, so only equal masks meet
        return F.struct(i.alias("pos"), *[F.xxhash64(F.lit(",".join(map(str, m))), *[F.get(col, i + o) for o in m]).alias(f"s{k}") for k, m in enumerate(masks)])

    windows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), seeds))
    spread = df.withColumn("_n", n).select(*keep, "_n", F.inline(windows))
    # where a mask runs over the end its seed is not used
    each = F.explode(F.array(*[F.struct((F.col("pos") + m[-1] < F.col("_n")).alias("fits"), F.col(f"s{k}").alias("seed")) for k, m in enumerate(masks)]))
    return spread.select(*keep, "pos", each.alias("e")).where("e.fits").select(*keep, "pos", F.col("e.seed").alias("seed"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, item, shift, and the smallest id: alignments of docs(key, id, h) with items(item, h), h not empty."""
    length = F.least(F.size("h"), F.lit(WINDOW)).alias("n")
    lengths = [r["n"] for r in items.select(length).distinct().collect()]  # WINDOW rows at most
    by_masks: dict[tuple, list[int]] = {}
    for n in lengths:
        by_masks.setdefault(MASKS[n], []).append(n)
    used = sorted({m for masks in by_masks for m in masks}) or [MASKS[WINDOW][0]]
    theirs = None
    for masks, some in by_masks.items():
        rows = _seed_rows(items.where(F.least(F.size("h"), F.lit(WINDOW)).isin(some)), "h", list(masks))
        theirs = rows if theirs is None else theirs.unionByName(rows)
    if theirs is None:
        theirs = _seed_rows(items, "h", used)
    theirs = cut(theirs.withColumnRenamed("pos", "item_pos").distinct())
    ours = _seed_rows(docs, "h", used)
    if theirs.count() <= BROADCAST_SEEDS:
        both = ours.join(F.broadcast(theirs), "seed")
    else:
        parts = F.explode(F.array(*map(F.lit, range(SEED_PARTS)))).alias("part")
        both = ours.withColumn("part", F.col("pos") % SEED_PARTS).join(theirs.select("*", parts), ["seed", "part"])
    return both.groupBy("key", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.min("id").alias("id"))


def _agreement(h: Column, item: Column, shift: Column, window: int) -> Column:
    """Most agreeing positions in any window of the alignment."""
    same = F.transform(item, lambda v, j: F.coalesce(((shift + j) >= 0) & (F.get(h, F.greatest(shift + j, F.lit(0))) == v), F.lit(False)).cast("int"))
    last = F.greatest(F.size(item) - window, F.lit(0))

    def inside(s: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), last), lambda j: sum((F.coalesce(F.get(s, j + k), F.lit(0)) for k in range(window)), F.lit(0)))
        return F.array_max(sums)

    return F.transform(F.array(same), inside)[0]


def key_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, item_id, agreed: a row for each distinct text and item whose passage it holds.

    key is key_of(text), so copies are verified once (at their smallest id; null ids count as -1).
    Items go by their tokens, so equal items are verified once and ids may be null or repeated.
    Alignments of a text are verified in rows of about VERIFY_TOKENS item tokens, however many it has.
    """
    listed = cut(benchmark.select("item_id", hashed(F.col("text")).alias("h")).where(F.size("h") > 0).withColumn("item", F.xxhash64("h")))
    items = cut(listed.groupBy("item").agg(F.first("h").alias("h"), F.collect_set(F.struct("item_id")).alias("ids")))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    texts = docs.select(key_of(F.col("text")).alias("key"), id_.alias("id"), F.col("text"))
    found = cut(hits(texts.select("key", "id", hashed(F.col("text")).alias("h")), items.select("item", "h")))
    # one row stands for the copies of a text; with its id in the key the copies don't meet in one task
    whole = found.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    longest = items.agg(F.max(F.size("h"))).first()[0] or 1
    part = F.pmod(F.xxhash64("item", "shift"), F.ceil(F.col("n") * longest / VERIFY_TOKENS))
    wanted = (
        found.select("key", "item", "shift").join(whole, "key").withColumn("part", part).join(items.select("item", "h"), "item")
        .groupBy("key", "id", "part").agg(F.collect_list(F.struct("item", "shift", "h")).alias("found"))
    )
    near = texts.join(wanted, ["key", "id"])

    def judged(h: Column, x: Column) -> Column:
        need = F.ceil(F.least(F.size(x["h"]), F.lit(WINDOW)) * SHARE)
        return F.struct(x["item"].alias("item"), _agreement(h, x["h"], x["shift"], WINDOW).alias("agreed"), need.alias("need"))

    # h is bound once a text; as a plain column it could be put into the lambda and be made anew for each position
    tried = F.transform(F.array(hashed(F.col("text"))), lambda h: F.transform("found", lambda x: judged(h, x)))[0]
    good = F.transform(F.filter(tried, lambda x: x["agreed"] >= x["need"]), lambda x: F.struct(x["item"], x["agreed"]))
    sure = cut(near.select("key", F.explode(good).alias("x")).groupBy("key", "x.item").agg(F.max("x.agreed").alias("agreed")))
    return sure.join(items.select("item", F.explode("ids").alias("i")), "item").select("key", "i.item_id", "agreed")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, agreed: a row for each document and item whose passage it holds."""
    pairs = overlaps(docs, benchmark).groupBy("key", "item_id").agg(F.max("agreed").alias("agreed"))
    return docs.select("doc_id", key_of(F.col("text")).alias("key")).join(pairs, "key").select("doc_id", "item_id", "agreed")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any verified overlap."""
    bad = overlaps(docs, benchmark).select("key").distinct()
    return unpack(pack(docs, key=key_of(F.col("text"))).join(bad, "key", "left_anti"))
