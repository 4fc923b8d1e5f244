"""Language-model scores from a subword lattice.

A text is a sequence of pieces of an existing vocabulary and one end. Its score is the log10
of its marginal probability: the sum, over all ways to cut it into pieces, of the product of
the pieces' probabilities and the end's, by forward recursion in log space. A word starts with
the mark U+2581 and no piece crosses words, so the recursion runs once for each distinct word.
A character without a piece of its own is spelled in the vocabulary's bytes.

Piece probabilities come from the vocabulary's scores and the training texts. The scores are
ranks, so a Zipf law over them is the first guess; ROUNDS expectation steps weigh all
segmentations of every training word, as often as it occurs, and add the expected piece counts
to the guess (which counts as PRIOR_MASS pieces). The end counts once a training text.

Beside it stand the smoothed word unigram score of the contract, and `word_score`, where a
training word is one more way to make a word: P(w) = (c(w) + k * lattice(w)) / (N + k), k the
number of words seen once, so the lattice holds the mass of words not seen yet.

Word counts of the corpus are combined before they are shuffled. The COMMON most frequent words
go to every task (a bounded table); all other words of a text meet their counts in an equi-join
on the word, where no key is hot because the hot ones are common.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import cut, ship
from plansieve.llm.token_count import MARK

COMMON = 100_000
FLUSH_WORDS = 400_000
PRIOR_MASS, ROUNDS = 1000.0, 2
ZIPF_SHIFT = 2.7
KNOWN_SHARE, ADD = 10, 0.1


def read_vocabulary(path: str) -> tuple[list[str], list[int], list[float]]:
    """pieces, byte ids by byte, prior weights by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = ["" if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(n)]
    bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    order = sorted((i for i in range(n) if pieces[i]), key=lambda i: -sp.get_score(i))
    raw = [0.0] * n
    for place, i in enumerate(order):
        raw[i] = 1.0 / (place + 1 + ZIPF_SHIFT)
    least = min(w for w in raw if w)
    for i in bytes_:
        raw[i] = least
    total = sum(raw)
    return pieces, bytes_, [w / total for w in raw]


class Edges:
    """All edges of many words' lattices: from node start to node end (both along one line of all words' characters), by a piece."""

    def __init__(self, first: np.ndarray, last: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, logw: np.ndarray, spelled: list[bytes]):
        self.first, self.last, self.owner, self.start, self.end, self.piece, self.logw, self.spelled = first, last, owner, start, end, piece, logw, spelled

    def sweep(self, back: bool = False) -> np.ndarray:
        """Log of the sum over all ways from a word's first node to each node, or from each node to its last.

        Nodes at equal distance from their word's border have all their edges' other ends done, so
        they are done together.
        """
        into, from_ = (self.start, self.end) if back else (self.end, self.start)
        far = (self.last[self.owner] - into) if back else (into - self.first[self.owner])
        order = np.lexsort((into, far))
        into, from_, w, far = into[order], from_[order], self.logw[order], far[order]
        f = np.full(int(self.last[-1]) + 1, -np.inf)
        f[self.last if back else self.first] = 0.0
        steps = np.flatnonzero(np.diff(far, prepend=-1)).tolist() + [len(far)]
        for a, b in zip(steps, steps[1:], strict=False):
            v, at = f[from_[a:b]] + w[a:b], into[a:b]
            runs = np.flatnonzero(np.diff(at, prepend=-1))
            top = np.maximum.reduceat(v, runs)
            top = np.where(np.isfinite(top), top, 0.0)  # where no way comes through
            sizes = np.diff(runs, append=len(v))
            with np.errstate(divide="ignore"):
                f[at[runs]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, sizes)), runs))
        return f


class Lattice:
    def __init__(self, path: str):
        self.pieces, self.bytes, self.prior = read_vocabulary(path)
        machine, packed = ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if p:
                machine.add_word(p, (len(p), i))
                packed.add_word(p, len(p) << 32 | i)
        machine.make_automaton()
        packed.make_automaton()
        self.machine, self.packed = machine, packed

    def edges_of(self, words: list[str], logw: np.ndarray) -> Edges:
        """Edges of many words, found in one pass; a character without a piece is an edge with the id -1 - its place in `spelled`."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        # words stand apart by a character that is in no piece
        line = "\0".join([MARK + w for w in words])
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        found = np.fromiter(chain.from_iterable(self.packed.iter(line)), np.int64).reshape(-1, 2)
        end, long, piece = found[:, 0] + 1, found[:, 1] >> 32, found[:, 1] & 0xFFFFFFFF
        bare = np.ones(len(line), bool)
        bare[end[long == 1] - 1] = False
        bare[(first + sizes)[:-1]] = False  # what stands between words
        alone = np.flatnonzero(bare)
        spelled = [line[p].encode() for p in alone.tolist()]
        costs = np.array([sum(logw[self.bytes[b]] for b in x) for x in spelled], float)
        start = np.concatenate([end - long, alone])
        end = np.concatenate([end, alone + 1])
        owner = np.searchsorted(first, start, "right") - 1
        return Edges(first, first + sizes, owner, start, end, np.concatenate([piece, -1 - np.arange(len(alone))]), np.concatenate([logw[piece], costs]), spelled)

    def log_probs(self, words: list[str], logw: np.ndarray) -> np.ndarray:
        """log_prob of many words."""
        out = np.zeros(len(words))
        for part in _parts(words):
            if len(part) == 1:
                out[part[0]] = self.log_prob(words[part[0]], logw)
            else:
                e = self.edges_of([words[i] for i in part], logw)
                out[part] = e.sweep()[e.last]
        return out

    def expect_all(self, words: list[str], counts: list[int], logw: np.ndarray, into: np.ndarray) -> None:
        """expect() for many words; sums by piece go to `into`."""
        for part in _parts(words):
            if len(part) == 1:
                one: dict[int, float] = {}
                self.expect(words[part[0]], counts[part[0]], logw, one)
                for i, n in one.items():
                    into[i] += n
                continue
            e = self.edges_of([words[i] for i in part], logw)
            ahead, after = e.sweep(), e.sweep(back=True)
            times = np.array([counts[i] for i in part], float)[e.owner]
            share = times * np.exp(ahead[e.start] + e.logw + after[e.end] - ahead[e.last][e.owner])
            whole = e.piece >= 0
            into += np.bincount(e.piece[whole], share[whole], len(into))
            for x, n in zip(e.spelled, share[~whole].tolist(), strict=True):
                for b in x:
                    into[self.bytes[b]] += n

    def edges(self, word: str, logw: list[float]) -> list[list[tuple[int, float, int]]]:
        """By end position: (start, log weight, piece); piece -1 is a character spelled in bytes."""
        s = MARK + word
        out: list[list] = [[] for _ in s]
        alone = [True] * len(s)
        for e, (n, i) in self.machine.iter(s):
            out[e].append((e + 1 - n, logw[i], i))
            if n == 1:
                alone[e] = False
        if True in alone:
            for e, bare in enumerate(alone):
                if bare:
                    out[e].append((e, sum(logw[self.bytes[b]] for b in s[e].encode()), -1))
        return out

    @staticmethod
    def forward(edges: list) -> list[float]:
        f = [0.0]
        put, exp, log = f.append, math.exp, math.log
        for into in edges:
            if len(into) == 1:
                s, w, _ = into[0]
                put(f[s] + w)
            else:
                terms = [f[s] + w for s, w, _ in into]
                top = max(terms)
                put(top + log(sum([exp(v - top) for v in terms])))
        return f

    def log_prob(self, word: str, logw: list[float]) -> float:
        """Natural log of the probability of all segmentations of a word together."""
        return self.forward(self.edges(word, logw))[-1]

    def expect(self, word: str, times: float, logw: list[float], into: dict[int, float]) -> None:
        """Adds the expected number of uses of each piece in `times` occurrences of a word."""
        edges = self.edges(word, logw)
        f = self.forward(edges)
        total, exp = f[-1], math.exp
        # after[p]: terms of the log probability of what follows position p, given the word
        after: list[list[float]] = [[] for _ in f]
        after[-1].append(0.0)
        for e in range(len(edges) - 1, -1, -1):
            terms = after[e + 1]
            if not terms:
                continue
            top = max(terms)
            b = top if len(terms) == 1 else top + math.log(sum([exp(v - top) for v in terms]))
            for s, w, i in edges[e]:
                w += b
                after[s].append(w)
                share = times * exp(f[s] + w - total)
                if i >= 0:
                    into[i] = into.get(i, 0.0) + share
                else:
                    for byte in (MARK + word)[e].encode():
                        into[self.bytes[byte]] = into.get(self.bytes[byte], 0.0) + share


#: words of one sweep, and characters from which on a word is done by itself
SWEEP_WORDS, LONG_WORD = 8000, 48


def _parts(words: list[str]) -> list[list[int]]:
    """Places of words that are done together: long ones alone, others by SWEEP_WORDS."""
    short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
    return [short[i : i + SWEEP_WORDS] for i in range(0, len(short), SWEEP_WORDS)] + [[i] for i, w in enumerate(words) if len(w) >= LONG_WORD]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Small batches put together until they fill a sweep."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SWEEP_WORDS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _words(raw: bytes | None) -> list[bytes]:
    """ASCII lower case; bytes.split() parts at space, tab, LF, VT, FF, CR only."""
    return raw.lower().split() if raw else []


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, c long: occurrences in training rows; words of other rows alone have 0.

    docs(raw binary, held boolean). Rows leave a task combined, at most FLUSH_WORDS distinct
    words being held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        other: set[bytes] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.record_batch({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
            yield pa.record_batch({"word": pa.array(list(other), pa.binary()), "n": pa.array([0] * len(other), pa.int64())})
            seen.clear()
            other.clear()

        for batch in batches:
            for raw, held in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                (other if held else seen).update(_words(raw))
                if len(other) + len(seen) >= FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def fit_pieces(counts: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces, and of the end, from all training words and the number of training texts."""
    prior = lattice(path).prior
    least = min(p for p in prior if p)  # of the end, before any text is seen

    def steps(logw: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = lattice(path)
            into = np.zeros(len(prior))
            for batch in _gathered(batches):
                m.expect_all([w.decode() for w in batch.column(0).to_pylist()], batch.column(1).to_pylist(), logw, into)
            at = np.flatnonzero(into)
            yield pa.record_batch({"piece": pa.array(at, pa.int32()), "n": pa.array(into[at])})

        return counts.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))

    guess = np.array(prior)
    with np.errstate(divide="ignore"):
        logw = np.log(guess)
        for _ in range(rounds):
            weight = PRIOR_MASS * guess
            for piece, n in steps(logw).collect():  # one row for each piece of the vocabulary at most
                weight[piece] += n
            total = float(weight.sum()) + ends + PRIOR_MASS * least
            logw = np.log(weight / total)
    return logw, math.log((ends + PRIOR_MASS * least) / total)


def common_from(counts: DataFrame) -> int:
    """Smallest count from which on at most COMMON words occur, to a sixteenth of a power of two."""
    step = F.floor(F.log2("c") * 16)
    levels = counts.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
    least, have = 1 << 62, 0
    for level in levels:  # about a thousand rows whatever the corpus
        have += level["n"]
        if have > COMMON:
            break
        least = level["c"]
    return least


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score for each row of docs.

    Null and empty texts have the end token only. A null doc_id counts as the empty text
    for the fold. Repeated rows are scored, and learned from, as often as they occur. With
    no training row N, V and every c are 0. Nothing is learned from held-out rows.
    """
    from plansieve.llm.token_count import default_path

    ship()
    path = path or default_path()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % KNOWN_SHARE
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"), (fold == 0).alias("held"))
    counts = cut(word_counts(rows.select("raw", "held")))
    ends = rows.where(~F.col("held")).count()
    total, kinds, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    n, v, k = total + ends, kinds + (ends > 0), max(1, once)
    log_all = math.log10(n + ADD * (v + 1))
    logw, log_end = fit_pieces(counts, ends, path)
    ten = math.log(10)

    def lattice_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lp: log10 of the lattice's probability of a word; wp: that of the word score."""
        m = lattice(path)
        for batch in _gathered(batches):
            ln, c = m.log_probs([w.decode() for w in batch.column(0).to_pylist()], logw), batch.column(1).to_numpy()
            x = math.log(k) + ln
            # where exp(x) vanishes, the sum is the count
            wp = np.where(c > 0, np.log(np.maximum(c, 1) + np.exp(x)), x) / ten - math.log10(n + k)
            yield from pa.table([*batch.columns, pa.array(ln / ten), pa.array(wp)], names=["word", "c", "lp", "wp"]).to_batches()

    known = cut(counts.select("word", "c").mapInArrow(lattice_scores, "word binary, c long, lp double, wp double"))
    common = known.where(F.col("c") >= common_from(known)).toArrow()  # COMMON rows at most
    shared = docs.sparkSession.sparkContext.broadcast((common["word"].to_pylist(), np.stack([common[x].to_numpy() for x in ("c", "lp", "wp")], axis=1).astype(float)))
    # what the end token adds: base score, known tokens, score, word score
    first = np.array([math.log10(ends + ADD) - log_all, 1.0 if ends else 0.0, log_end / ten, math.log10(max(ends, ADD)) - math.log10(n + k)])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums over its common words, and one for each other word of it."""
        words_, table = shared.value
        place = {w: i for i, w in enumerate(words_)}
        c = table[:, 0] if len(words_) else np.zeros(0)
        values = np.stack([np.log10(c + ADD) - log_all, c > 0, table[:, 1], table[:, 2]], axis=1) if len(words_) else np.zeros((0, 4))
        for batch in batches:
            own, rest = [], []
            for rid, doc, held, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words = _words(raw)
                at, times = [], []
                for w, t in Counter(words).items():
                    i = place.get(w)
                    if i is None:
                        rest.append((rid, w, t))
                    else:
                        at.append(i)
                        times.append(t)
                sums = first + np.array(times, float) @ values[at] if at else first
                # the key of a text's own row holds a space, so it is no word and no hot key
                own.append((rid, b" %d" % rid, 0, doc, held, len(words) + 1, *sums.tolist()))
                if len(rest) > 100_000:
                    yield batch_of(own, rest)
                    own, rest = [], []
            yield batch_of(own, rest)

    sums = ["base", "hits", "lat", "word_lat"]
    types = pa.schema([("rid", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), *[(x, pa.float64()) for x in sums]])

    def batch_of(own: list, rest: list) -> pa.RecordBatch:
        blank = (None,) * (3 + len(sums))
        columns = [list(x) for x in zip(*own, *(r + blank for r in rest), strict=True)] or [[] for _ in types]
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, types, strict=True)], schema=types)

    # rid tells rows apart within this one pass over docs
    spread = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held", "raw").mapInArrow(
        parts, f"rid long, word binary, times long, doc_id long, held boolean, n_tokens long, {', '.join(f'{x} double' for x in sums)}"
    )
    c, times = F.coalesce(F.col("c"), F.lit(0)), F.col("times")
    out = spread.join(known, "word", "left").groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("hits", F.when(c > 0, times).otherwise(0))).cast("long").alias("n_known"),
        F.sum(F.coalesce("base", times * (F.log10(c + ADD) - log_all))).alias("base_score"),
        F.sum(F.coalesce("lat", times * F.col("lp"))).alias("score"),
        F.sum(F.coalesce("word_lat", times * F.col("wp"))).alias("word_score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "word_score")


def report(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))
