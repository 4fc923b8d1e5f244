"""Personal data: patterns propose spans, checksums confirm, context words adjust scores.

Base kinds (email, ip, card, phone) follow fixed patterns and checks, and always stay.
Further kinds need evidence: an IBAN its country's length and the mod-97 checksum, numbers
written like a social security or a local telephone number a context word nearby, and so a
secret, a long run of letters and digits. Each
span has a score: the kind's prior, plus a checksum's weight, plus the context's; further
kinds count from THRESHOLD on.

Positions come from column functions only: splitting a text at a pattern gives the gaps
between its matches, and running lengths of gaps and matches give code point offsets.
Patterns use possessive groups and anchor at run starts, so that no text of any length
backtracks quadratically or recurses deeply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import pack

THRESHOLD = 0.6
CONTEXT_CHARS = 40
LUHN_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)
# fixed values: characters of an IBAN by country (ISO 13616 registry)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_pattern() -> str:
    """Countries of one length together; single spaces may part any characters."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    return "|".join(rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in sorted(by_length.items()))


BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
#: kind -> pattern; equal in matches to the plain forms, see the tests.
#: \G lets a match start where the one before ended within a run of local-part characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern(),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}",
    "secret": r"[A-Za-z0-9_+/=-]{24,}",
}
#: further kinds must not touch these characters, before and after
BORDERS = {"iban": ("[A-Za-z0-9]", "[A-Za-z0-9]"), "ssn": ("[0-9-]", "[0-9-]"), "local_phone": ("[0-9+(.-]", "[0-9-]"), "secret": ("[A-Za-z0-9_+/=.@-]", "[A-Za-z0-9_+/=@-]")}
#: what a text must hold for a pattern to be worth trying
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    # tried where a run starts only, so a run's letters are looked at once
    "secret": lambda t: t.rlike(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{24}"),
}
BASE = ("email", "ip", "card", "phone")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.4, "local_phone": 0.4, "secret": 0.4}
CHECKSUM_WEIGHT, CONTEXT_WEIGHT = 0.4, 0.3
CONTEXT = {
    "email": "e-?mail|contact|write|reply",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|tel|telephone|call|mobile|cell|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "local_phone": "phone|tel|telephone|call|mobile|cell|fax",
    "secret": "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|key|credential|auth|bearer",
}
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def near_words(kind: str) -> str:
    """Pattern of a kind's context words, standing by themselves."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{CONTEXT[kind]})(?:$|[^\p{{L}}\p{{N}}_])"


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(m: Column) -> Column:
    """Digits pass Luhn and are as many as card numbers have."""
    d = F.reverse(digits_of(m))
    n = F.length(d)

    def add(s: Column, k: Column) -> Column:
        v = F.substring(d, k, F.lit(1)).cast("int")
        two = v * 2
        return s + F.when(k % 2 == 1, v).otherwise(F.when(two > 9, two - 9).otherwise(two))

    ok = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0
    return F.when(n.between(*LUHN_DIGITS), ok).otherwise(False)


def mod97(m: Column) -> Column:
    """ISO 13616: first four characters go last, letters stand for 10 to 35, remainder 1."""
    s = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def add(r: Column, k: Column) -> Column:
        code = F.ascii(F.substring(moved, k, F.lit(1)))
        return F.when(code < 65, (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


CHECKS = {
    "ip": lambda m: m.rlike(rf"\A(?:{BYTE}\.){{3}}{BYTE}\z"),
    "card": luhn,
    "phone": lambda m: F.length(digits_of(m)).between(*PHONE_DIGITS),
    "iban": mod97,
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}


def _located(text: Column, gaps: Column, matches: Column) -> Column:
    """array<struct<m, start>>: matches with the code points before them."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,start:int>>").alias("out"))

    def add(s: Column, i: Column) -> Column:
        start = s["at"] + F.length(F.get(gaps, i))
        m = F.get(matches, i)
        return F.struct((start + F.length(m)).alias("at"), F.array_append(s["out"], F.struct(m.alias("m"), start.alias("start"))).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, add, lambda s: s["out"])


def with_spans(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Adds the array of spans (kind, start, end, score), by kind as listed, then start.

    Offsets are code points, end exclusive. Null text has no spans; spans of different kinds
    may overlap. Rows, repeated ones too, are judged by themselves.
    """
    rows = pack(df, t=F.coalesce(F.col(text_col), F.lit("")))
    t = F.col("t")
    for kind, pattern in PATTERNS.items():
        none = F.array().cast("array<string>")
        rows = rows.withColumn(f"m_{kind}", F.when(HINTS[kind](t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in PATTERNS.items():
        m = F.col(f"m_{kind}")
        # split only where there is something to locate
        rows = rows.withColumn(f"g_{kind}", F.when(F.size(m) > 0, F.split(t, pattern, -1)))

    def spans(kind: str) -> Column:
        located = _located(t, F.col(f"g_{kind}"), F.col(f"m_{kind}"))
        check = CHECKS.get(kind)
        if check:
            located = F.filter(located, lambda x: check(x["m"]))

        def scored(x: Column) -> Column:
            end = x["start"] + F.length(x["m"])
            before = F.substring(t, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT_CHARS)))
            after = F.substring(t, end + 1, F.lit(CONTEXT_CHARS))
            near = F.concat(before, F.lit("\n"), after).rlike(near_words(kind))
            score = PRIOR[kind] + (CHECKSUM_WEIGHT if check in (luhn, mod97) else 0.0) + F.when(near, CONTEXT_WEIGHT).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        if kind in BORDERS:
            before, after = BORDERS[kind]
            located = F.filter(
                located,
                lambda x: ~F.substring(t, F.greatest(x["start"], F.lit(1)), F.when(x["start"] > 0, 1).otherwise(0)).rlike(before)
                & ~F.substring(t, x["start"] + F.length(x["m"]) + 1, F.lit(1)).rlike(after),
            )
        found = F.transform(located, scored)
        if kind not in BASE:
            found = F.filter(found, lambda x: x["score"] >= THRESHOLD)
        return F.when(F.size(F.col(f"m_{kind}")) > 0, found).otherwise(F.array().cast(SPAN))

    return rows.select("row", "t", F.concat(*[spans(k) for k in PATTERNS]).alias(out))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(ordered, zero, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its spans of personal data masked in the text; null stays null."""
    rows = with_spans(df, text_col, "spans")
    new = F.when(F.size("spans") > 0, redacted(F.col("t"), F.col("spans"))).otherwise(F.col(f"row.{text_col}"))
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def report(docs: DataFrame) -> DataFrame:
    rows = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
