"""Quality rules whose cutoffs carry a finite-sample guarantee.

Base rules are fixed. The further rules compare simple ratios of a text with reference
values and reject a text if any ratio exceeds `level` times its reference. One level for
each stratum (language) is chosen on labelled rows: levels are tested from loose to
strict, and a level is certified if the exact binomial bound says that, at confidence
1 - delta / number of strata, at most `alpha` of the stratum's good texts are rejected
(P(Bin(n, alpha) <= rejected) <= delta / strata). Trials are the different labelled texts of
the stratum, however often each is repeated. Testing in this fixed order and stopping
at the first level that fails needs no further correction within a stratum; Bonferroni
covers the strata. Of the certified levels the loosest is taken that rejects ENOUGH percent of
the labelled bad texts that any of them does. A stratum without enough labels rejects nothing.

Everything here is built-in column functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansieve.llm.common import SPACE_BYTES, SPACE_PATTERN, binom_cdf, cut, pack, unpack

WINDOW = 8
#: rule -> reference value; a text is rejected beyond level * reference
REFERENCES = {
    "symbols": 0.10,  # symbol characters a word
    "dup_lines": 0.30,  # share of lines equal to an earlier line
    "repeats": 0.20,  # share of words in repeated windows
    "same_next": 0.10,  # share of words equal to the word before
    "capitals": 0.30,  # share of capitals in word characters
    "exclaims": 0.20,  # exclamation marks a word
}
#: levels from loose to strict
LEVELS = [round(8.0 * 0.9**i, 6) for i in range(36)]
ALPHA, DELTA, ENOUGH = 0.03, 0.05, 98


def _zip_hash(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of a width at ascending starts."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts,
        zero,
        lambda s, p: F.struct((p + width).alias("end"), (s["n"] + p + width - F.greatest(p, s["end"])).cast("long").alias("n")),
        lambda s: s["n"],
    )


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the struct column `_q`: the base counts and the ratios of the rules.

    Words are runs of anything but space, tab, LF, VT, FF, CR; null text has none. Windows
    are compared by 64-bit hashes of their words' 64-bit hashes within one text.
    Work is n log n in the words of a text that repeats, linear otherwise.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_BYTES))
    df = docs.withColumn("_t", trimmed)
    t = F.col("_t")  # for words only: trimming would change the first and the last line
    df = df.withColumn("_w", F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_PATTERN, -1)))
    df = df.withColumn("_h", _zip_hash(F.col("_w"))).withColumn("_n", F.size("_w"))
    h, n = F.col("_h"), F.col("_n")
    win = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    )
    df = df.withColumn("_win", win)
    df = df.withColumn(
        "_srt",
        F.when(
            F.size(F.array_distinct("_win")) < F.size("_win"),
            F.sort_array(F.transform("_win", lambda v, i: F.struct(v.alias("v"), i.alias("i")))),
        ),
    )
    srt = F.col("_srt")
    starts = F.sort_array(
        F.transform(
            F.filter(srt, lambda x, j: (x["v"] == F.get(srt, j - 1)["v"]) | (x["v"] == F.get(srt, j + 1)["v"])),
            lambda x: x["i"],
        )
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_BYTES)) != "")
    df = df.withColumn("_l", lines)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(srt.isNull(), F.lit(0).cast("long")).otherwise(_covered(starts, WINDOW)).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter(h, lambda v, i: v == F.get(h, i - 1))).cast("long").alias("n_same"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_exclaims"),
    )
    # a filter that also asks for `_stop` stays above this step; pushed down, it would repeat the counts term by term
    return df.withColumns({"_q": counts, "_stop": F.monotonically_increasing_id()}).drop("_t", "_w", "_h", "_n", "_win", "_srt", "_l")


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (q["n_repeat_words"] * 100 > q["n_words"] * 30)


def strictness(q: Column) -> Column:
    """Largest ratio over its reference; 0 for a text without words."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(q[a], q[b]), F.lit(0.0))

    ratios = {
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "same_next": share("n_same", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "exclaims": share("n_exclaims", "n_words"),
    }
    return F.greatest(*[ratios[k] / F.lit(REFERENCES[k]) for k in REFERENCES])


def choose_levels(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, level: the chosen level of each stratum that has a certified one.

    scored(doc_id, stratum, digest, s). labels(doc_id, quality): rows without a quality or an id
    are left out. Rows of one digest are one trial; it, or an id with several labels, counts as
    good if any label says so (the cautious side).
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    # place: how many levels are below the text's strictness, hence reject it
    place = F.size(F.filter(F.array(*map(F.lit, LEVELS)), lambda v: v < F.col("s")))
    trials = scored.join(marks, "doc_id").groupBy("stratum", "digest").agg(F.max("good").alias("good"), F.first("s").alias("s"))
    seen = (
        trials.groupBy("stratum", place.alias("place"))
        .agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") != 1).alias("bad"))
    )
    # a text with `place` levels below is rejected by the strictest `place` of them
    steps = seen.groupBy("stratum").agg(
        F.sum("good").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", F.struct("good", "bad")))).alias("at")
    )
    strata = max(1, steps.count())
    order = len(LEVELS)
    grid = steps.select(
        "stratum", "n", F.posexplode(F.array(*map(F.lit, LEVELS))).alias("step", "level"), "at"
    )

    def above(kind: str) -> Column:
        entries = F.map_entries("at")
        return F.aggregate(
            entries,
            F.lit(0).cast("long"),
            lambda s, e: s + F.when(e["key"] >= F.lit(order) - F.col("step"), e["value"][kind]).otherwise(0),
        )

    tested = grid.withColumn("k", above("good")).withColumn("caught", above("bad"))
    tested = tested.withColumn("ok", binom_cdf(F.col("k"), F.col("n"), F.lit(alpha)) <= delta / strata)
    run = Window.partitionBy("stratum").orderBy("step")
    certified = tested.withColumn("ok", F.min("ok").over(run)).where("ok")
    most = F.max("caught").over(Window.partitionBy("stratum"))
    return certified.withColumn("most", most).where(F.col("caught") * 100 >= F.col("most") * ENOUGH).groupBy("stratum").agg(F.max("level").alias("level"))


def stratum_of(df: DataFrame) -> Column:
    return F.coalesce(F.col("lang"), F.lit("")) if "lang" in df.columns else F.lit("")


def digest_of(df: DataFrame) -> Column:
    """64 bits stand for a text; where two texts share them, they are one trial."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def levels_for(docs: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """Levels chosen over all labelled rows of docs."""
    scored = with_features(docs.select("doc_id", stratum_of(docs).alias("stratum"), "text", digest_of(docs).alias("digest")))
    return choose_levels(scored.select("doc_id", "stratum", "digest", strictness(F.col("_q")).alias("s")), labels, **risk)


def judge(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows with `_q` and `_stratum`; levels has a row a stratum."""
    df = df.join(levels.withColumnsRenamed({"stratum": "_stratum", "level": "_level"}), "_stratum", "left")
    q = F.col("_q")
    bad = base_failed(q)
    return df.withColumn("base_failed", bad).withColumn(
        "kept", ~bad & F.coalesce(strictness(q) <= F.col("_level"), F.lit(True))
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the method's: strictness, and level, null where no level of the stratum is certified."""
    # counts of all texts are a small table, so they are written once and used twice
    known = cut(with_features(docs.select("doc_id", stratum_of(docs).alias("_stratum"), "text", digest_of(docs).alias("_digest"))).drop("text"))
    scored = known.select("doc_id", F.col("_stratum").alias("stratum"), F.col("_digest").alias("digest"), strictness(F.col("_q")).alias("s"))
    return judge(known, cut(choose_levels(scored, labels))).select(
        "doc_id",
        *[F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
        F.round(strictness(F.col("_q")), 9).alias("strictness"),
        F.col("_level").alias("level"),
    )


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their own columns whatever their names."""
    # rows are written once with their counts: cheaper than counting twice, for the levels and for the verdicts
    rows = pack(docs, text=F.col("text"), _stratum=stratum_of(docs), _digest=digest_of(docs))
    known = cut(with_features(rows).drop("text", "_stop"))
    scored = known.select(F.col("row.doc_id").alias("doc_id"), F.col("_stratum").alias("stratum"), F.col("_digest").alias("digest"), strictness(F.col("_q")).alias("s"))
    return unpack(judge(known, cut(choose_levels(scored, labels))).where("kept"))
