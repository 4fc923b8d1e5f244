"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8
or more. Equal texts are one class and are joined once. The steps:

1. Each distinct text gets HASHES MinHash values. BANDS bands of ROWS values give candidate
   buckets; a pair at the threshold shares none of them with probability (1 - 0.8^4)^32,
   about 5e-8.
2. In a bucket, signatures are compared STEP values at a time. After n values with m equal
   the similarity has a Beta(1 + m, 1 + n - m) posterior; a pair is dropped as soon as its
   probability of reaching the threshold is under TOLERANCE. A pair is looked at in the
   first band only that it shares, so no pair is looked at twice.
3. Texts with a surviving pair are fetched once for each bucket in which they have one, and
   their shingle sets decide exactly.

No pair becomes a row: a bucket yields counts of links by text and a spanning forest of its
links. A bucket is split into blocks of bounded shingle weight, each pair of blocks being a
task's unit, so that a huge bucket spreads out; every pair is still looked at. Classes of
linked texts come from alternating large-star and small-star steps over the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import cut, pack, ship, unpack

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 32, 4, 16, 1e-9
HASHES = BANDS * ROWS
#: shingles (each counting once, a text at least MIN_WEIGHT) in a block of a bucket
BLOCK_WEIGHT, MIN_WEIGHT = 50_000, 100
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(raw: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; shorter texts with a word have one, of all their words."""
    words = raw.split() if raw else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(SHINGLE, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = _mix(out + h[k : n - width + 1 + k])
    return np.unique(out)


def signature(sh: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a non-empty set."""
    low = (sh >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        part = (low[i : i + 512, None] ^ _XOR) * _MUL
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x85EBCA77)
        np.minimum(best, part.min(axis=0), out=best)
    return best


def beta_tail(m: int, n: int, t: float) -> float:
    """P(S >= t) for S ~ Beta(1 + m, 1 + n - m), which is P(Bin(n + 1, t) <= m)."""
    return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, matches needed among the first n values to stay a candidate)."""
    return [(n, next(m for m in range(n + 1) if beta_tail(m, n, threshold) >= tolerance)) for n in range(STEP, HASHES + 1, STEP)]


def candidate_pairs(sigs: np.ndarray, band: int, side: np.ndarray | None, needed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Index pairs of a bucket of one band that survive. side: if given, only pairs across its two values."""
    n = len(sigs)
    out: list[tuple[int, int]] = []
    bands = sigs.reshape(n, BANDS, ROWS)
    for i in range(n - 1):
        js = np.arange(i + 1, n)
        if side is not None:
            js = js[side[js] != side[i]]
        # only pairs that share this band, whatever hash brought them here, and no earlier one
        js = js[(bands[js, band] == bands[i, band]).all(axis=1)]
        if band and len(js):
            js = js[~(bands[js, :band] == bands[i, :band]).all(axis=2).any(axis=1)]
        same = np.zeros(len(js), np.int32)
        for upto, least in needed:
            if not len(js):
                break
            same = same + (sigs[js, upto - STEP : upto] == sigs[i, upto - STEP : upto]).sum(axis=1)
            stay = same >= least
            js, same = js[stay], same[stay]
        out += [(i, int(j)) for j in js]
    return out


def jaccard_at_least(a: np.ndarray, b: np.ndarray, t: float = THRESHOLD) -> bool:
    if min(len(a), len(b)) < t * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= t * (len(a) + len(b) - both) - 1e-9


def _by_unit(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of sorted batches, grouped by their first `keys` columns: (key, rows); one row a text, named by the next column."""
    key, rows = None, {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, list(rows.values())
                key, rows = row[:keys], {}
            rows[row[keys]] = row[keys:]
    if rows:
        yield key, list(rows.values())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sigs, sizes = [], []
            for raw in part.column(0).to_pylist():
                sh = shingles(raw)
                sizes.append(len(sh))
                sigs.append(signature(sh).tobytes() if len(sh) else b"")
            yield pa.record_batch(
                {"doc_id": part.column(1), "key": part.column(2), "weight": pa.array(sizes, pa.int64()), "sig": pa.array(sigs, pa.binary())}
            )


def band_buckets(sigs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands' values; the low five bits are the band itself."""
    s = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    h = _mix(_mix(s[:, :, 0] << np.uint64(32) | s[:, :, 1]) + (s[:, :, 2] << np.uint64(32) | s[:, :, 3]))
    return (h & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            yield pa.record_batch({"short": pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), "bucket": pa.array(band_buckets(sigs).ravel())})


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, key, block, sig) of texts that have a surviving pair in the unit."""
    needed = least_matches()
    out: list[list] = [[], [], [], [], [], []]
    for (bucket, i, j), rows in _by_unit(batches, 3):
        sigs = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(len(rows), HASHES)
        side = np.array([r[1] for r in rows]) if i != j else None
        alive = sorted({x for pair in candidate_pairs(sigs, bucket & (BANDS - 1), side, needed) for x in pair})
        for x in alive:
            for column, v in zip(out, (bucket, i, j, *rows[x]), strict=True):
                column.append(v)
        if len(out[0]) > 20_000:
            yield _pruned(out)
            out = [[], [], [], [], [], []]
    yield _pruned(out)


def _pruned(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    return pa.record_batch({k: pa.array(x, t) for k, x, t in zip(("bucket", "i", "j", "key", "block", "sig"), out, kinds, strict=True)})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, links, parent): exact links of a text in a unit, and a tree edge to another text if it has one."""
    needed = least_matches()
    out: list[list] = [[], [], []]
    for (bucket, i, j), rows in _by_unit(batches, 3):
        sets = [shingles(r[3]) for r in rows]
        sigs = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(len(rows), HASHES)
        side = np.array([r[1] for r in rows]) if i != j else None
        links, parent = [0] * len(rows), list(range(len(rows)))

        def root(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in candidate_pairs(sigs, bucket & (BANDS - 1), side, needed):
            if jaccard_at_least(sets[a], sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
        for x, n in enumerate(links):
            if n:
                for column, v in zip(out, (rows[x][0], n, rows[root(x)][0]), strict=True):
                    column.append(v)
        if len(out[0]) > 20_000:
            yield _verified(out)
            out = [[], [], []]
    yield _verified(out)


def _verified(out: list[list]) -> pa.RecordBatch:
    return pa.record_batch({"key": pa.array(out[0], pa.binary()), "links": pa.array(out[1], pa.int64()), "parent": pa.array(out[2], pa.binary())})


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """key, root: the smallest key of each connected component of edges(a, b).

    Alternating large-star and small-star; each is two aggregations over the edges, whose
    number never grows, and O(log^2) rounds suffice. A large-star step joins each node with
    its neighbourhood's smallest key instead of gathering neighbours. The smallest keys are
    written first, so that both sides of the join are plain shuffles and a hub's edges, all
    of one key, can be split.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: every larger neighbour v of u points to u's minimum
        star = both.join(low, "u")
        large = star.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(star.where("m < u").select(F.col("m").alias("a"), F.col("u").alias("b")))
        large = cut(large.where("a <> b").distinct())
        # small star: every smaller neighbour of u, and u, point to u's minimum (edges lead from b to smaller a)
        low = cut(large.groupBy("b").agg(F.min("a").alias("m")))
        star = large.join(low, "b")
        small = star.select(F.col("m").alias("a"), F.col("a").alias("b")).union(star.select(F.col("m").alias("a"), "b"))
        small = cut(small.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        # done when every edge hangs on a root: no b is an a, and no b has two a's
        open_ = small.select(F.col("a").alias("k")).distinct().join(small.select(F.col("b").alias("k")), "k", "left_semi")
        e = small
        if open_.isEmpty() and small.groupBy("b").count().where("count > 1").isEmpty():
            return e.select(F.col("b").alias("key"), F.col("a").alias("root"))
    raise RuntimeError("components did not settle")


def key_of(text: Column) -> Column:
    """128 bits of a digest stand for a text; null is the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of each row, and (key, class_id, text_id, n_copies, n_links) of each distinct text.

    No side of the joins here has a bound on its size, so none is left to be broadcast.
    """
    ship()
    key, raw = key_of(F.col("text")), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kinds = "doc_id long, key binary, weight long, sig binary"
    rows = cut(docs.select(raw.alias("raw"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key")).mapInArrow(_sketch, kinds))
    texts = cut(
        rows.groupBy("key").agg(
            F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.first("weight").alias("weight"), F.first("sig").alias("sig")
        )
    )
    # every text has BANDS rows here, so they carry a short hash of its key; where two keys share
    # one, both texts come back with it and their signatures tell them apart
    short = texts.withColumn("short", F.xxhash64("key"))
    member = short.where("weight > 0").select("short", "sig").mapInArrow(_bands, "short long, bucket long")
    full = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = cut(
        member.join(full.hint("merge"), "bucket")
        .join(short.select("short", "key", F.greatest("weight", F.lit(MIN_WEIGHT)).alias("weight")).hint("merge"), "short").select("bucket", "key", "weight")
    )
    blocks = met.groupBy("bucket").agg(F.ceil(F.sum("weight") / BLOCK_WEIGHT).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    unit = ["bucket", "i", "j"]
    placed = (
        met.join(blocks.hint("merge"), "bucket").withColumn("block", block).select("key", "bucket", "block", F.explode(others).alias("other"))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block")
    )
    with_sig = placed.join(texts.select("key", "sig").hint("merge"), "key").select(*unit, "key", "block", "sig")
    alive = cut(_units(with_sig, unit).mapInArrow(_prune, "bucket long, i int, j int, key binary, block int, sig binary"))
    # texts stream past a hash table of keys and are not sorted; they are fetched at their smallest id: with the id in the join's key, copies don't meet in one task
    wanted = alive.select("key").distinct().join(texts.select("key", F.coalesce("text_id", F.lit(-1)).alias("id")).hint("merge"), "key")
    needed = docs.select(key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), raw.alias("raw"))
    needed = needed.join(wanted.hint("shuffle_hash"), ["key", "id"]).groupBy("key", "id").agg(F.first("raw").alias("raw")).select("key", "raw")
    with_text = alive.join(needed.hint("merge"), "key").select(*unit, "key", "block", "sig", "raw")
    found = cut(_units(with_text, unit).mapInArrow(_verify, "key binary, links long, parent binary"))

    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("parent").alias("b")))
    named = texts.select("key", "text_id", "n_copies").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = cut(named)
    # ids can be null or shared by texts, so one text stands for the class by its key as well
    first = F.struct(F.col("text_id").isNull(), "text_id", "key")
    heads = named.groupBy("root").agg(F.min("text_id").alias("class_id"), F.min_by("key", first).alias("head"))
    return rows.select("doc_id", "key"), cut(
        named.join(heads, "root").select(
            "key", "class_id", "text_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("key") == F.col("head")).alias("is_head")
        )
    )


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, text_id, n_copies, n_links for each row of docs(doc_id, text).

    text_id is the smallest doc_id among the rows of an equal text, class_id the smallest
    among all texts that chains of links connect, n_copies the rows of the text, n_links the
    number of other texts at THRESHOLD or above. Null texts are empty texts; texts without a
    word are linked to none. Rows of a null doc_id take part; an id is null only where all are.
    """
    rows, named = classes(docs)
    return rows.join(named, "key").select("doc_id", "class_id", "text_id", "n_copies", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, null or shared ids or not: of its text with the smallest (doc_id, key), one row."""
    ids, named = classes(docs.select("doc_id", "text"))
    heads = named.where("is_head")
    # the id is part of the join's key, so copies of a text do not meet in one task
    rows = pack(docs, key=key_of(F.col("text")), id=F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    # rows stream past a hash table of the heads' keys and are not sorted
    heads = heads.select("key", F.coalesce("class_id", F.lit(-1)).alias("id")).hint("shuffle_hash")
    kept = rows.join(heads, ["key", "id"], "left_semi")
    repeated = ids.groupBy("key", F.coalesce("doc_id", F.lit(-1))).count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.groupBy("key", "id").agg(F.first("row").alias("row"))
    return unpack(kept)


def _units(df: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of a unit side by side in one partition."""
    return df.repartition(*unit).sortWithinPartitions(*unit)


def report(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text"))
