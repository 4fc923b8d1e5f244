"""Token counts of a unigram tokenizer without building its tokens.

An Aho-Corasick machine enumerates every vocabulary piece in a text; Viterbi keeps for
each position the best score and the number of pieces on the best path, nothing else.
Tie rule of the public unigram tokenizers: candidates for an end position come in order of
their start, and only a strictly greater score replaces an earlier one, so the longest
piece wins among equals; a character that no single-character piece covers becomes an
unknown of score (lowest score - 10), which byte fallback turns into its UTF-8 bytes.

The vocabulary and its scores are an existing model file, used as they are. Texts are
normalised as that file asks: one space in front, spaces written as the mark U+2581.
No piece of the vocabulary holds the mark behind another character, so best paths never
cross from a non-mark to a mark and the text falls into independent chunks, counted once
for each distinct chunk of a worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from plansieve.llm.common import ship

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (sp.id_to_piece(i), sp.get_score(i))
        for i in range(sp.get_piece_size())
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    ]


class Lattice:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        machine = ahocorasick.Automaton()
        for p, s in pieces:
            machine.add_word(p, (len(p), s))
        machine.make_automaton()
        self.machine = machine
        inner = {c for p, _ in pieces if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece holds the word mark behind another character")
        #: characters that stand in no longer piece part the text as well; newline is the common one
        self.split = regex.compile(
            ("\n|" if "\n" not in inner else "") + f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"
        ).findall
        self.known: dict[str, int] = {}

    def best(self, chunk: str) -> tuple[float, int]:
        """Score and piece count of the best path; unknown characters count as their bytes."""
        n = len(chunk)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.machine.iter(chunk):
            ends[end].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(n):
            found = ends[e]
            found.sort(key=lambda m: -m[0])
            top, pieces, single = 0.0, -1, False
            for size, s in found:
                at = e + 1 - size
                single |= size == 1
                v = score[at] + s
                if pieces < 0 or v > top:
                    top, pieces = v, count[at] + 1
            if not single:
                v = score[e] + self.unknown
                if pieces < 0 or v > top:
                    top, pieces = v, count[e] + len(chunk[e].encode())
            score[e + 1], count[e + 1] = top, pieces
        return score[n], count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for chunk, times in Counter(self.split(MARK + text.replace(" ", MARK))).items():
            n = known.get(chunk)
            if n is None:
                n = self.best(chunk)[1]
                if len(chunk) <= 64:
                    if len(known) >= CACHE_CHUNKS:
                        known.clear()
                    known[chunk] = n
            total += n * times
        return total


@lru_cache(maxsize=4)
def lattice(path: str) -> Lattice:
    return Lattice(read_pieces(path))


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of each text (long). Null and empty texts have none.

    Other columns, row order and repeated rows are untouched. Long texts are counted whole;
    memory is one Arrow batch, the longest chunk's arrays and a bounded memo of chunks.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = lattice(path)
        for texts in batches:
            yield pd.Series([model.count(t) if t else 0 for t in texts], dtype="int64")
        model.known.clear()

    ship()
    return F.pandas_udf(run, "long")(text)


def report(df: DataFrame) -> DataFrame:
    return df.select("doc_id", token_count(F.col("text")).alias("n_tokens"))
