"""Each operator against a brute-force version, and its defined results for odd inputs."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansieve.llm import bpe, decontam, jaccard_join, lm_score, pii, quality_classifier, quality_rules, sharding, token_count, url_filter
from plansieve.llm.common import beta_cdf, binom_cdf

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "é漢🙂 \x0b x", "word " * 3000, "z" * 20000]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one of them twice, a null id, and columns named as helpers inside are."""
    df = docs_of(spark, ODD + ["a"]).unionByName(spark.createDataFrame([(None, "a b c", None, None, None), (3, "a", "en", "s", 1)], SCHEMA))
    return df.withColumns({c: F.lit(1) for c in ("row", "_q", "spans", "t", "key", "_w", "_stop", "kept", "ids", "h")}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 -------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [
        (1, "https://A.Example.org/es/x?q#f"), (2, "http://example.org/en/12"), (3, "ftp://foo.com/de/"), (4, "x://foo.com"), (5, None), (6, "no scheme"),
        (7, "http://example.org?x://y/z"), (8, "http://notexample.org/es/"), (9, "http://h.net:80/a"), (9, "http://h.net:80/a"), (10, "://"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.filter_urls(pages, none).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("com/de/", "block") and got[4] == ("foo.com", "", None, "allow")
    assert got[5] == got[6] == got[10] == ("", "", None, "allow") and got[7] == ("example.org", "", None, "allow")
    assert got[8][2:] == ("org/", "allow") and got[9][:2] == ("h.net:80", "/a")
    assert url_filter.filter_urls(pages, none).count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), none).isEmpty()


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows, i = [], 0
    for h in range(30):
        for k in range(40):
            rows.append((i, f"http://s{h}.good.net/{k}", int(k < 3)))
            i += 1
    for k in range(60):
        rows.append((i, f"http://x.spam.net/{k}", int(k < 50)))
        i += 1
    rows.append((i, "http://tiny.good.net/1", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["host"]: r for r in url_filter.filter_urls(df.drop("bad"), df.select("page_id", "bad")).collect()}
    assert got["x.spam.net"]["verdict"] == "block" and got["s1.good.net"]["verdict"] == "allow" and got["tiny.good.net"]["verdict"] == "allow"
    suffixes = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x",), ("a.b.com:8",), ("",), ("a.b.com.mx",), ("me.github.io",), ("co",)], "h string")
    s = url_filter.suffix_of(F.col("h"))
    assert [tuple(r) for r in suffixes.select(s, url_filter.domain_of(F.col("h"), s)).collect()] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("x", "x"), ("com", "b.com"), ("", ""), ("com.mx", "b.com.mx"), ("github.io", "me.github.io"), ("co", "co")]


def test_beta_tail_of_large_parameters(spark):
    """Beside the median, and on both sides of where the way of computing changes."""
    rows = [(2e7, 8e7, 0.2, 0.5), (3e6, 3e6, 0.5, 0.5), (2999.0, 12000.0, 0.2, None), (3001.0, 12004.0, 0.2, None), (4000.0, 16000.0, 0.21, None), (4000.0, 16000.0, 0.195, None), (5e8, 5e8, 0.1, 0.0), (5e8, 5e8, 0.9, 1.0)]
    for r in spark.createDataFrame(rows, "a double, b double, x double, want double").withColumn("got", beta_cdf(F.col("x"), F.col("a"), F.col("b"))).collect():
        if r.want is not None:
            assert r.got == pytest.approx(r.want, abs=2e-5)
            continue
        t = np.linspace(max(0, r.x - 0.06), r.x, 400_001)
        y = np.exp((r.a - 1) * np.log(t) + (r.b - 1) * np.log1p(-t) + math.lgamma(r.a + r.b) - math.lgamma(r.a) - math.lgamma(r.b))
        assert r.got == pytest.approx(float(((y[1:] + y[:-1]) / 2).sum() * (t[1] - t[0])), abs=1e-7)


def test_binomial_tail(spark):
    rows = [(k, n, p) for n in (5, 50, 1800) for k in (0, 1, 3, 50) for p in (0.01, 0.3) if k <= n]
    for r in spark.createDataFrame(rows, "k int, n int, p double").withColumn("c", binom_cdf(F.col("k"), F.col("n"), F.col("p"))).collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(r.p) + (r.n - i) * math.log1p(-r.p)) for i in range(r.k + 1))
        assert r.c == pytest.approx(want, rel=1e-8, abs=1e-10)


# --- 2 -------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(reversed(d))) % 10 == 0


PASSES = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": luhn, "phone": lambda m: 9 <= sum(c.isdigit() for c in m) <= 15}


def test_pii_base_spans(spark, odd, none):
    rng = random.Random(4)
    texts = [
        "a@b.com@d.com x_@.a a@b.c_x@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 00255.0.0.1 1.2.3.4.", "+1 (234) 555-12345 +1 1 +12345678901234567 ++49 30 1234567",
        "4111 1111 1111 1111 4111-1111-1111-1111 12", "é漢🙂 a@b.co 🙂+44 20 7946 0958", "1" * 20000, "a.b@" * 3000, ".".join(["12"] * 5000), "+1" + "(" * 20000,
    ] + ["".join(rng.choice("ab1234567890..--  @+()é🙂") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    df = docs_of(spark, texts)
    for r, t in zip(pii.report(df).orderBy("doc_id").collect(), texts, strict=True):
        spans = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if PASSES[k](m[0])]
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest() == r["base_sha256"], t[:300]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
    assert pii.report(odd).count() == odd.count() and pii.report(none).isEmpty()
    assert {r["spans"] for r in pii.report(odd).collect()} == {""}


def test_pii_evidence_and_masks(spark, odd):
    df = docs_of(spark, ["IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32, not DE88370400440532013000", "ssn 123-45-6789", "number 123-45-6789", "call 555-123-4567 now a@b.co 4111111111111111 +4111111111111111", None])
    got = [r["spans"] for r in pii.report(df).orderBy("doc_id").collect()]
    assert got[0] == "iban:5:27,iban:32:59" and got[1] == "ssn:4:15" and got[2] == "" and got[4] == ""
    more = ["ES91 2100 0418 4502 0005 1332 BANK", "ES91 2100 0418 4502 0005 1332 I paid", "ES9121000418450200051332", "ES91210004184502000513321", "XES9121000418450200051332", "NO93 8601 1117 947."]
    more += ['token = "9742a250774262d69ad6a86100194ed53da5a0ef"', "9742a250774262d69ad6a86100194ed53da5a0ef", "token " + "a" * 40, "api_key: AbC-1234567890123456789012", "z" * 20000 + " token"]
    got = [r["spans"] for r in pii.report(docs_of(spark, more)).orderBy("doc_id").collect()]
    assert got == ["iban:0:29", "iban:0:29", "iban:0:24", "", "", "iban:0:18", "secret:9:49", "", "", "secret:9:35", ""]
    texts = [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()]
    assert texts[1] == "ssn [SSN]" and texts[4] is None and texts[3] == "call [LOCAL_PHONE] now [EMAIL] [CARD] +[CARD]"  # 16 digits are no phone
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).exceptAll(odd).isEmpty()


# --- 3 -------------------------------------------------------------------------------------


def test_lm_base_and_folds(spark, odd, none):
    texts = prose(random.Random(1), 60) + ODD + ["Word wORD É"]
    df = docs_of(spark, texts)
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*low(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    for r in lm_score.score(df).collect():
        tokens = [*low(texts[r["doc_id"]]), "\0end"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["train_tokens"] == n and r["n_tokens"] == len(tokens)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm_score.score(odd).count() == odd.count() and lm_score.score(none).isEmpty()


def segmentations(m, s):
    """Every way to cut s into pieces, as lists of piece ids; a character without a piece is its bytes."""
    ids = {p: i for i, p in enumerate(m.pieces) if p}

    def cut(rest):
        if not rest:
            yield []
            return
        for n in range(1, len(rest) + 1):
            if rest[:n] in ids:
                for tail in cut(rest[n:]):
                    yield [ids[rest[:n]], *tail]
        if rest[0] not in ids:
            for tail in cut(rest[1:]):
                yield [*(m.bytes[b] for b in rest[0].encode()), *tail]

    return list(cut(s))


def test_score_equals_brute_force(spark):
    """Every segmentation is listed, weighed and counted by itself."""
    m = lm_score.lattice(token_count.default_path())
    texts = ["The then zq", "in the ing", "", "tion 🙂a the", None, "ing", "zq zq zq", "other words", "is the", "a", "new unseen", "the zq"]
    df = docs_of(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    words = [(t or "").lower().split() for t in texts]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    ends = held.count(False)
    every = {w: segmentations(m, lm_score.MARK + w) for ws in words for w in ws}
    p, least = list(m.prior), min(x for x in m.prior if x)
    for _ in range(lm_score.ROUNDS):
        mass = [1000.0 * x for x in m.prior]
        for w, c in counts.items():
            odds = [math.prod(p[i] for i in cut) for cut in every[w]]
            for cut, odd in zip(every[w], odds, strict=True):
                for i in cut:
                    mass[i] += c * odd / sum(odds)
        total = sum(mass) + ends + 1000.0 * least
        p, end = [x / total for x in mass], (ends + 1000.0 * least) / total
    chance = {w: sum(math.prod(p[i] for i in cut) for cut in cuts) for w, cuts in every.items()}
    n, k = sum(counts.values()) + ends, max(1, sum(c == 1 for c in counts.values()))
    assert any(held) and sum(p) + end == pytest.approx(1.0)
    for r in lm_score.score(df).collect():
        ws = words[r["doc_id"]]
        assert r["score"] == pytest.approx(math.log10(end) + sum(math.log10(chance[w]) for w in ws))
        known = math.log10(ends / (n + k)) + sum(math.log10((counts[w] + k * chance[w]) / (n + k)) for w in ws)
        assert r["word_score"] == pytest.approx(known)


def test_nothing_is_learned_from_held_out_rows(spark):
    texts = prose(random.Random(5), 60)
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0}
    other = [t if i not in held else "unheard of " * 50 for i, t in enumerate(texts)]
    one, two = ({r["doc_id"]: tuple(r)[3:] for r in lm_score.score(docs_of(spark, x).withColumn("lang", F.lit(v))).collect()} for x, v in ((texts, "en"), (other, "fr")))
    assert held and all(one[i] == pytest.approx(two[i]) for i in one.keys() - held)


def test_common_and_other_words_score_alike(spark, monkeypatch):
    df = docs_of(spark, prose(random.Random(2), 40))
    one = {r["doc_id"]: tuple(r)[2:] for r in lm_score.score(df).collect()}
    monkeypatch.setattr(lm_score, "COMMON", 3)
    for r in lm_score.score(df).collect():
        assert tuple(r)[2:] == pytest.approx(one[r["doc_id"]])


def test_lattice_sums_all_segmentations():
    m = lm_score.lattice(token_count.default_path())
    logw = [math.log(p) if p else -math.inf for p in m.prior]
    assert sum(m.prior) == pytest.approx(1.0)
    ids = {p: i for i, p in enumerate(m.pieces) if p}

    def every(s):
        if not s:
            return 1.0
        total = sum(m.prior[ids[s[:n]]] * every(s[n:]) for n in range(1, len(s) + 1) if s[:n] in ids)
        if s[0] not in ids:
            total += math.prod(m.prior[m.bytes[b]] for b in s[0].encode()) * every(s[1:])
        return total

    for w in ("the", "ing", "zq", "🙂a", "tion"):
        assert m.log_prob(w, logw) == pytest.approx(math.log(every(lm_score.MARK + w)))
        got = {}
        m.expect(w, 2.0, logw, got)
        assert sum(got.get(i, 0) * len(m.pieces[i] or "") for i in got) <= 2 * (len(w) + 1) + 1e-9
    got = {}
    m.expect("the", 3.0, logw, got)
    assert sum(n * len(m.pieces[i]) for i, n in got.items()) == pytest.approx(3 * 4)
    assert math.isfinite(m.log_prob("x" * 3000, logw))


def test_many_words_at_once_equal_one_by_one():
    m = lm_score.lattice(token_count.default_path())
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst\0🙂éż▁1x") for _ in range(rng.randint(1, 30))) for _ in range(500)] + ["x" * 300, "the" * 40, "a"]
    logw = np.array([math.log(p) if p else -math.inf for p in m.prior])
    assert m.log_probs(words, logw) == pytest.approx([m.log_prob(w, logw) for w in words])
    one: dict = {}
    for i, w in enumerate(words):
        m.expect(w, i % 7, logw, one)
    many = np.zeros(len(m.prior))
    m.expect_all(words, [i % 7 for i in range(len(words))], logw, many)
    assert many == pytest.approx(np.array([one.get(i, 0.0) for i in range(len(many))]), abs=1e-9)


# --- 4 -------------------------------------------------------------------------------------


def test_counts_equal_the_tokenizer(spark, odd, none):
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.default_path())
    own = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    own.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rng = random.Random(6)
    texts = ["".join(rng.choice("aeiou the  \n\tTé漢字ё🙂▁ing1234") for _ in range(rng.randint(1, 60))) for _ in range(2000)] + ["the " * 2000, "x" * 5000]
    got = [r["n_tokens"] for r in token_count.report(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_count.report(odd).count() == odd.count() and token_count.report(none).isEmpty()
    assert token_count.report(docs_of(spark, [None, ""])).agg(F.sum("n_tokens")).first()[0] == 0


# --- 5 -------------------------------------------------------------------------------------


def shingle_set(t):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(texts):
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    sets = {i: shingle_set(t) for t, i in first.items()}
    links, root = Counter(), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (top(first[t or ""]), first[t or ""], links[first[t or ""]]) for i, t in enumerate(texts)}


def near_copies(rng):
    texts = prose(rng, 25)
    for t in texts[:8]:
        for _ in range(rng.randint(1, 4)):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    base = prose(rng, 1)[0].split()
    for i in range(60):  # a large group of near copies, not all alike
        w = list(base)
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        texts.append(" ".join(w))
    return texts + ODD + ["a", "a b", "a  b", texts[0], texts[0], ""]


@pytest.mark.parametrize("weight", [50_000, 600])
def test_join_equals_brute_force(spark, monkeypatch, weight):
    """Also with blocks so small that large buckets are split."""
    monkeypatch.setattr(jaccard_join, "BLOCK_WEIGHT", weight)
    texts = near_copies(random.Random(weight))
    got = {r["doc_id"]: (r["class_id"], r["text_id"], r["n_links"]) for r in jaccard_join.join(docs_of(spark, texts)).collect()}
    assert got == brute_links(texts)


def test_join_odd_rows(spark, odd, none):
    out = jaccard_join.join(odd)
    assert out.count() == odd.count() and out.where("doc_id is null").first()["n_copies"] == 1
    assert out.where("doc_id = 3").first()["n_copies"] == 3
    assert jaccard_join.join(none).isEmpty()
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


@pytest.mark.parametrize("ids", [(None, None, None), (7, 7, 7), (None, 7, 7)])
def test_one_row_of_a_class_whatever_its_ids(spark, ids):
    words = prose(random.Random(4), 1)[0].split() * 2
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join([*words, "other"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    assert [r["n_links"] for r in jaccard_join.join(docs).collect()] == [2, 2, 2]
    assert jaccard_join.keep_one(docs).count() == 1


def test_pruning_keeps_what_can_reach_the_threshold():
    for n, least in jaccard_join.least_matches():
        assert jaccard_join.beta_tail(least, n, 0.8) >= 1e-9 and (least == 0 or jaccard_join.beta_tail(least - 1, n, 0.8) < 1e-9)
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[90:], rng.integers(0, 1 << 63, 90, dtype=np.uint64)]))
    same = (jaccard_join.signature(a) == jaccard_join.signature(b)).mean()
    assert same == pytest.approx(810 / 990, abs=0.12)


# --- 6 -------------------------------------------------------------------------------------


def test_decontamination(spark, odd, none):
    rng = random.Random(9)
    items = prose(rng, 6) + ["few words to match", "zyzzyva", "one two three", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    filler = prose(rng, 12, words=3000)
    long_item = items[0].split()
    hurt = [w if i % 5 else "other" for i, w in enumerate(long_item)]
    texts = [
        filler[0] + " " + items[0] + " " + filler[1], filler[2] + "\n" + items[1].upper().replace(" ", ", "), " ".join(hurt), filler[3] + " " + " ".join(long_item[:13]),
        " ".join(long_item[:6]) + " " + filler[4], *filler[5:], items[2], items[2], *ODD, f"{filler[5]} Zyzzyva!", "one, two three", "one two four", "few other words to match", "few words or match",
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.report(docs_of(spark, texts), bench).collect()}

    def tokens(t):
        return re.sub(r"[^\w\s]|_", "", (t or "").lower()).split()

    want = set()
    for i, t in enumerate(texts):
        for j, x in enumerate(items):
            a, b = tokens(t), tokens(x)
            if not b:
                continue
            width = min(13, len(b))
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + k < len(a) and a[shift + k] == b[k] for k in range(len(b))]
                if max(sum(same[k : k + width]) for k in range(len(b) - width + 1)) >= math.ceil(width * 0.75):
                    want.add((i, j))
    assert got == want and {(0, 0), (1, 1), (2, 0), (3, 0)} <= got and not any(i == 4 for i, _ in got)
    assert decontam.clean(docs_of(spark, texts), bench).count() == len(texts) - len({i for i, _ in want})
    kept = decontam.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontam.report(none, bench).isEmpty() and decontam.report(odd, bench.limit(0)).isEmpty()


@pytest.mark.parametrize("n", range(1, decontam.WINDOW + 1))
def test_masks_find_whatever_may_be_substituted(n):
    from itertools import combinations

    for bad in combinations(range(n), n - decontam.needed(n)):
        assert any(not set(bad) & {i + o for o in m} for m in decontam.MASKS[n] for i in range(n - m[-1])), bad


def test_items_without_an_id_or_with_a_shared_one(spark):
    item, other = prose(random.Random(3), 2)
    bench = spark.createDataFrame([(None, item), (5, item), (5, other), (5, other)], "item_id long, text string")
    docs = docs_of(spark, [f"x {item}", other, "y"])
    assert sorted((r["doc_id"], r["item_id"] or -1) for r in decontam.report(docs, bench).collect()) == [(0, -1), (0, 5), (1, 5)]
    assert [r["doc_id"] for r in decontam.clean(docs, bench).collect()] == [2]


def test_many_alignments_and_seeds_beyond_the_broadcast(spark, monkeypatch):
    """Texts of few different words have many alignments; both ways of joining give the same."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (5, 40, 300)]
    bench = spark.createDataFrame([(i, " ".join(rng.choice("ab") for _ in range(n))) for i, n in enumerate((1, 3, 5, 9, 13, 30))], "item_id long, text string")
    monkeypatch.setattr(decontam, "VERIFY_TOKENS", 50)
    one = sorted(tuple(r) for r in decontam.report(docs_of(spark, texts), bench).collect())
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert one == sorted(tuple(r) for r in decontam.report(docs_of(spark, texts), bench).collect()) and len(one) > 10


def test_short_items_with_substitutions(spark):
    rng = random.Random(6)
    cases = [(8, {3, 4}), (8, {3, 6}), (8, {4, 5}), (8, {4, 6}), (9, {4, 5}), (12, {4, 5, 9})]
    items = [prose(rng, 1, words=3000)[0].split()[:n] for n, _ in cases]
    hurt = [" ".join("other" if k in bad else w for k, w in enumerate(x)) for x, (_, bad) in zip(items, cases, strict=True)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    # the last text is shorter than its item
    got = {tuple(r) for r in decontam.report(docs_of(spark, [*hurt, " ".join(items[0][:6])]), bench).collect()}
    assert got == {(i, i, n - len(bad)) for i, (n, bad) in enumerate(cases)} | {(len(cases), 0, 6)}


# --- 7 -------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, odd, none):
    import tiktoken

    path, pattern = bpe.default_path(), bpe.default_pattern()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choice("aeiou theTHE  \n\t\x1c\x85  'stn0123½²ªß漢字ёйⅣ🙂‍!#$|._-\x00\r") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "zq" * 3000, " " * 4000, "<|endoftext|>"]
    for r, t in zip(bpe.report(docs_of(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        ids = own.encode_ordinary(t)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), t[:99]
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    both = docs_of(spark, texts[:300]).select(bpe.encode(F.col("text")).alias("ids"), "text").select(bpe.decode(F.col("ids")).alias("raw"), "text")
    assert all(bytes(r["raw"]) == r["text"].encode() for r in both.collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r)[1:] for r in bpe.report(docs_of(spark, [None])).collect()] == [(0, empty, empty)]
    assert bpe.report(odd).count() == odd.count() and bpe.report(none).isEmpty()


# --- 8 -------------------------------------------------------------------------------------


def base_counts(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark, odd, none):
    rng = random.Random(8)
    texts = [*ODD, *prose(rng, 20, words=12), "a b c d e f g h " * 9, "x\ny\nx\n\n \nx", "one two three four five six seven eight\n" * 2]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.report(docs_of(spark, texts), labels).collect():
        n, chars, symbols, lines, repeated = base_counts(texts[r["doc_id"]])
        assert tuple(r)[1:6] == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n) and r["kept"] != r["base_failed"]
    assert quality_rules.report(odd, labels).count() == odd.count() and quality_rules.report(none, labels).isEmpty()
    kept = quality_rules.filter_documents(odd, labels)
    assert kept.columns == odd.columns and kept.isEmpty()


def test_lines_keep_their_outer_space(spark):
    texts = ["A\r\nB\r\nA\r\n", "x\nfoo\nfoo ", " x\ny\nx", "\t x\n\t x\n", "\n\na \nb\na \n\n"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.report(docs_of(spark, texts), labels).collect()}
    assert got == {i: base_counts(t)[3] for i, t in enumerate(texts)} == {0: 1, 1: 0, 2: 0, 3: 1, 4: 1}


def test_levels_carry_the_guarantee(spark):
    rng = random.Random(3)
    good, bad = prose(rng, 700), [t.upper().replace(" ", "!! ") for t in prose(rng, 80)]
    df = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 700), 0) for i in range(780)], "doc_id long, quality int, toxic int")
    levels = quality_rules.levels_for(df, labels).collect()
    assert len(levels) == 1
    out = quality_rules.report(df, labels).collect()
    rejected = [r["doc_id"] for r in out if not r["kept"] and not r["base_failed"]]
    assert len([i for i in rejected if i < 700]) == 0 and len([i for i in rejected if i >= 700]) == 80
    few = labels.where("doc_id < 50")
    assert quality_rules.levels_for(df, few).isEmpty()
    mixed = labels.unionByName(spark.createDataFrame([(0, 0, 0), (None, 1, 0), (5, None, 0)], labels.schema))
    assert quality_rules.levels_for(df, mixed).count() == 1


def test_copies_are_one_trial(spark):
    """Repeating rows certifies nothing that the different texts don't."""
    good = prose(random.Random(4), 60)
    df = docs_of(spark, good * 20)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60 * 20)], "doc_id long, quality int, toxic int")
    assert quality_rules.levels_for(df, labels).isEmpty() and quality_rules.levels_for(df, labels, alpha=0.1).count() == 1


# --- 9 -------------------------------------------------------------------------------------


def test_classifier_learns(spark, odd, none):
    rng = random.Random(5)
    good, bad = prose(rng, 300), [t.replace(" ", "*** ") for t in prose(rng, 60)]
    df = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(360)], "doc_id long, quality int, toxic int")
    out = quality_classifier.report(df, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out) and len(held) > 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert np.mean([r["predicted"] == int(r["doc_id"] < 300) for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert [tuple(r) for r in quality_classifier.report(df, flipped).orderBy("doc_id").collect()] == sorted(tuple(r) for r in out)
    assert quality_classifier.report(odd, labels).count() == odd.count() and quality_classifier.report(none, labels).isEmpty()
    assert quality_classifier.report(odd, labels.limit(0)).agg(F.max("score")).first()[0] == pytest.approx(0.5)


def test_classifier_equals_brute_force(spark):
    """The whole query again by counting in plain Python; descent and curve are tested by themselves."""
    rng = random.Random(11)
    texts = [t if rng.random() < 0.7 else t.replace(" ", "*** ") for t in prose(rng, 120)]
    marks = {i: int("***" not in texts[i]) if rng.random() < 0.9 else rng.randint(0, 1) for i in range(0, 120, 1) if i % 3}
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in range(120)}
    place = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")).collect()}
    rows = sorted((i for i in marks if fold[i] != 2), key=lambda i: (place[i], i))
    grams = [set(quality_classifier.features(t.encode()).tolist()) for t in texts]
    held = {1: Counter(g for i in rows if marks[i] for g in grams[i]), 0: Counter(g for i in rows if not marks[i] for g in grams[i])}
    size, smooth = 1 << quality_classifier.BITS, quality_classifier.SMOOTH

    def ratio(g, out=None):
        """Log-count ratio of an n-gram, as if the row `out` were not labelled."""
        n = {y: held[y][g] - (out is not None and marks[out] == y and g in grams[out]) for y in (0, 1)}
        if not n[0] + n[1]:
            return 0.0
        all_ = {y: sum(held[y].values()) + size * smooth - (len(grams[out]) if out is not None and marks[out] == y else 0) for y in (0, 1)}
        return math.log((n[1] + smooth) / all_[1]) - math.log((n[0] + smooth) / all_[0])

    def vector(i, out=None):
        at = sorted(grams[i])
        r = np.array([ratio(g, out) for g in at])
        return np.array(at), r / (math.sqrt(float(r @ r)) or 1.0)

    ys = [1 if marks[i] else -1 for i in rows]
    seen, other = [k for k in range(len(rows)) if k % 5], [k for k in range(len(rows)) if k % 5 == 0]
    w = quality_classifier.dual_descent([vector(rows[k]) for k in seen], [ys[k] for k in seen], size)
    margin = lambda at, v: float(w[at] @ v) + w[-1]
    a, b = quality_classifier.logistic(np.array([margin(*vector(rows[k], rows[k])) for k in other]), np.array([ys[k] for k in other]))
    for r in quality_classifier.report(df, labels).collect():
        want = 1 / (1 + math.exp(-(a * margin(*vector(r["doc_id"])) + b)))
        assert r["score"] == pytest.approx(want, abs=1e-5) and r["held_out"] == (fold[r["doc_id"]] == 2)
        assert r["predicted"] == int(want >= 0.7) or abs(want - 0.7) < 1e-5


def test_the_fit_does_not_depend_on_partitions(spark):
    rng = random.Random(12)
    texts = [t if rng.random() < 0.7 else t.replace(" ", "!! ") for t in prose(rng, 200)]
    labels = spark.createDataFrame([(i % 190, int("!!" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, texts).withColumn("doc_id", F.col("doc_id") % 190)  # some ids are shared
    one, two = (quality_classifier.fit(x, labels, 60) for x in (df.repartition(7), df.coalesce(1)))
    assert (one.weights == two.weights).all() and (one.a, one.b, one.bias) == (two.a, two.b, two.bias)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are absent")
def test_held_out_quality(spark):
    """Area under the curve over labelled rows that were not learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.report(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 50 and np.mean([(g > x) + 0.5 * (g == x) for g in good for x in bad]) > 0.95


def test_dual_descent_reaches_the_primal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + 0.3 * rng.normal(size=80) > 0, 1, -1)
    w = quality_classifier.dual_descent([(np.arange(5), v) for v in x], y.tolist(), 5, epochs=400)
    cost = [80 / (2 * (y == v).sum()) for v in y]

    def primal(w):
        return 0.5 * w @ w + sum(c * max(0.0, 1 - t * (v @ w[:5] + w[5])) for c, t, v in zip(cost, y, x, strict=True))

    best = primal(w)
    assert all(primal(w + 0.05 * rng.normal(size=6)) > best - 1e-6 for _ in range(200))


# --- 10 ------------------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    best = [math.inf] * (len(sizes) + 1)
    best[0] = 0
    for _ in range(shards):
        new = list(best)
        for i in range(1, len(sizes) + 1):
            run = 0
            for j in range(i, 0, -1):
                run += sizes[j - 1]
                new[i] = min(new[i], max(run, best[j - 1]))
        best = new
    return best[-1]


def test_cuts_are_minimax(spark):
    rng = random.Random(3)
    for n, shards, budget in ((1, 16, 8), (40, 4, 8), (120, 16, 30), (120, 3, 4)):
        keys = sorted(rng.sample(range(-500, 5000), n))
        sizes = [rng.choice([1, 5, 50, 400]) for _ in keys]
        cuts = sharding.find_cuts(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "k long, s long"), "k", "s", shards, budget)
        runs = Counter()
        for k, s in zip(keys, sizes, strict=True):
            runs[sum(k > c for c in cuts)] += s
        assert max(runs.values()) == brute_capacity(sizes, shards) and max(runs) < shards


def test_shards(spark, odd, none):
    rng = random.Random(2)
    texts = prose(rng, 60)
    texts += [texts[0]] * 30 + ODD
    rows = sharding.report(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"}
    place = {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) and 0 <= r["shard"] < 16
        assert place.setdefault((t is None, t), r["shard"]) == r["shard"]
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t is None, t), [i, 0])[1] += len((t or "").encode()) + 1
    sizes = [s for _, s in sorted(groups.values())]
    by = Counter()
    for r in rows:
        by[r["shard"]] += r["size"]
    assert max(by.values()) == brute_capacity(sizes, 16)
    assert sharding.report(odd).count() == odd.count() and sharding.report(none).isEmpty()


def brute_bytes(sizes, shards=16):
    """Largest shard among giants and the best contiguous partition of the rest."""
    rest, top = list(sizes), 0
    while shards > 1 and rest and max(rest) * shards >= sum(rest):
        top = max(top, max(rest))
        rest.remove(max(rest))
        shards -= 1
    return max(top, brute_capacity(rest, shards)) if rest else top


def test_a_giant_group_leaves_other_shards_even(spark):
    rng = random.Random(6)
    texts = prose(rng, 150)
    texts += ["giant " * 40] * 150
    by = Counter()
    for r in sharding.report(docs_of(spark, texts)).collect():
        by[r["shard"]] += r["size"]
    giant = 150 * 241
    others = sorted(v for v in by.values() if v != giant)
    assert giant in by.values() and len(by) == 16 and others[0] > 0.5 * others[-1]
    groups = [len(t) + 1 for t in texts[:150]] + [giant]
    assert max(others) == brute_bytes(groups[:-1], 15)


@pytest.mark.parametrize("same", [None, 7])
def test_groups_without_ids_of_their_own(spark, same):
    """Null or shared ids don't glue texts together."""
    texts = prose(random.Random(7), 200)
    rows = [(same, t, "en", "s", 1) for t in texts] + [(i, t + " x", "en", "s", 1) for i, t in enumerate(texts)]
    by = Counter()
    for r in sharding.report(spark.createDataFrame(rows, SCHEMA)).collect():
        by[r["shard"]] += r["size"]
    assert len(by) == 16 and min(by.values()) > 0.6 * max(by.values())


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_quality_uses_the_labels(spark, tmp_path):
    """A certified level takes effect in the stage, and the stage keeps all columns of the rest."""
    import corpus_pipeline

    rng = random.Random(13)
    good, bad = prose(rng, 300), [t.replace(" ", "!! ") for t in prose(rng, 60)]
    docs = docs_of(spark, good + bad)
    marks = [(i, int(i < 300), 0) for i in range(360) if i % 3]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(300))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = near_copies(rng)
    passage = prose(rng, 1, words=50)[0]
    texts += [f"{t} {passage} {t[:50]}" for t in prose(rng, 4)] + [f"{t} mail me a.b@c.org or 10.0.0.1" for t in prose(rng, 5)]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t in enumerate(texts) if not (base_counts(t)[0] < 20 or 100 * base_counts(t)[4] > 30 * base_counts(t)[0])]
    links = brute_links([t for _, t in kept])
    kept = [kept[i] for i in range(len(kept)) if links[i][0] == i]
    kept = [(i, t) for i, t in kept if passage not in t]

    def mask(t):
        return re.sub(r"(?<![\d.])\d+\.\d+\.\d+\.\d+", "[IP]", re.sub(PLAIN["email"], "[EMAIL]", t))

    assert got == {i: hashlib.sha256(mask(t).encode()).hexdigest() for i, t in kept}
    assert sum("[EMAIL] or [IP]" in mask(t) for _, t in kept) == 5
