"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A sequence of tokens is what the merge procedure yields exactly when each adjacent
pair of it is (each pair alone re-encodes to itself). So the encoder takes the longest
vocabulary match at the current byte, accepts it if it is compatible with its left
neighbour and its end is not known to be a dead end, falls back to the longest token
that is a proper prefix, and backs up one token when none is left. Each dead end is
marked once, hence linear time in the piece. Compatibility is memoised per pair.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyspark.sql.types import BinaryType

from plansieve.llm.common import ship

CACHE_PIECES = 150_000
MEMO_PAIRS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge_ranks(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """Plain merge loop using only merges of rank under `below`; lowest rank first, leftmost on ties."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Pieces(dict):
    """Packed ids of the pieces seen so far; forgets all when full, never holds long ones."""

    def __init__(self, codec: "ByteBPE"):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.codec.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        machine = ahocorasick.Automaton()
        reachable = set()
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.left[rank] = self.right[rank] = rank
            else:
                halves = merge_ranks(token, self.ranks, rank)
                if len(halves) != 2:
                    continue
                a, b = self.ranks[halves[0]], self.ranks[halves[1]]
                self.left[rank], self.right[rank] = a, b
                self.joined[a, b] = rank
            reachable.add(token)
            machine.add_word(token.decode("latin-1"), (len(token), rank))
        machine.make_automaton()
        self.machine = machine
        self.shorter: dict[int, tuple[int, int]] = {}
        for token in reachable:
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in reachable:
                    self.shorter[self.ranks[token]] = (n, self.ranks[token[:n]])
                    break
        self.memo: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def compatible(self, pair: tuple[int, int]) -> bool:
        if len(self.memo) >= MEMO_PAIRS:
            self.memo.clear()
        ok = self.memo[pair] = self._compatible(*pair)
        return ok

    def _compatible(self, a: int, b: int) -> bool:
        """Undo merges beside the border, latest first; a merge over the border that would
        have come before the one just undone breaks the pair."""
        limit = 1 << 62
        while True:
            over = self.joined.get((a, b))
            if over is not None and over < limit:
                return False
            can_a, can_b = self.left[a] != a, self.left[b] != b
            if not can_a and not can_b:
                return True
            # ranks order merges in time; on the same rank the leftmost merge comes first
            if can_a and (not can_b or a > b):
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [None] * n
        for end, match in self.machine.iter(raw.decode("latin-1")):
            longest[end - match[0] + 1] = match  # ends ascend, so the last one is the longest
        shorter, memo = self.shorter, self.memo
        out: list[tuple[int, int]] = []
        dead: set[int] = set()
        at, match = 0, longest[0]
        while True:
            while match is not None:
                if at + match[0] not in dead:
                    if not out:
                        break
                    pair = (out[-1][1], match[1])
                    ok = memo.get(pair)
                    if ok is None:
                        ok = self.compatible(pair)
                    if ok:
                        break
                match = shorter.get(match[1])
            if match is None:
                # nothing fits here: this border is dead, try a shorter token before it
                dead.add(at)
                size, rank = out.pop()
                at -= size
                match = shorter.get(rank)
                continue
            out.append(match)
            at += match[0]
            if at == n:
                return [m[1] for m in out]
            match = longest[at]

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", packed)))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Token ids of each text, packed as little-endian unsigned 32-bit integers (binary).

    Each match of `pattern` is encoded by itself, special tokens are plain text, as
    tiktoken's encode_ordinary. Null and empty texts give an empty binary. Other columns,
    row order and repeated rows are untouched. Memory: one Arrow batch plus two bounded memos, the larger of which a task empties as it ends.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for texts in batches:
            yield pd.Series([c.encode(t) if t else b"" for t in texts], dtype=object)
        c.pieces.clear()  # an idle worker keeps the vocabulary only

    ship()
    return F.pandas_udf(run, BinaryType())(text)


def decode(packed: Column, path: str | None = None) -> Column:
    """Bytes that packed ids stand for; null gives an empty binary; an unknown id raises."""
    path, pattern = path or default_path(), default_pattern()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for ids in batches:
            yield pd.Series([c.decode(bytes(i)) if i else b"" for i in ids], dtype=object)

    ship()
    return F.pandas_udf(run, BinaryType())(packed)


def round_trip(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """struct(ids, raw): encode(text), and decode of these ids, in one pass, so that a task needs one Python worker."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for texts in batches:
            ids = [c.encode(t) if t else b"" for t in texts]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "raw": pd.Series([c.decode(i) for i in ids], dtype=object)})
        c.pieces.clear()

    ship()
    return F.pandas_udf(run, "ids binary, raw binary")(text)


def count_tokens(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def report(df):
    """The digest query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = df.select("doc_id", round_trip(F.col("text")).alias("c"))
    return coded.select(
        "doc_id",
        count_tokens(F.col("c.ids")).alias("n_tokens"),
        F.sha2(F.col("c.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("c.raw"), 256).alias("decoded_sha256"),
    )
