"""Host reputation by empirical Bayes, and url rules on top of it.

Labelled pages give each host a count of outcomes and of bad ones. The bad rate of a host
has a beta prior whose mean is the shrunken rate of its registered domain, which is itself
shrunk towards its public suffix, and that towards all pages. How strong a level pulls is
estimated from the data (beta-binomial overdispersion, method of moments):
rho = sum((y - n m)^2 - n m (1 - m)) / sum(n (n - 1) m (1 - m)), strength = 1 / rho - 1.
A host is blocked if its bad rate exceeds `limit` with posterior probability `sure` at
least, which is the same as a lower posterior bound beyond the limit.

Explicit rules come first; the longest that fits wins. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import beta_cdf, cut

#: (verdict, rule); a rule is a host, which stands for its subdomains too, and a path prefix
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: a public suffix has two labels if it is one of these before a country's two letters, or a platform that hosts
#: sites of many owners; else one. Fixed values, both parameters of `reputations`.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
PLATFORMS = (
    "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com",
)
#: suffixes of at most so many rows are sent to every task
BROADCAST_SUFFIXES = 100_000
LIMIT, SURE = 0.2, 0.95
RHO_RANGE = (1e-4, 0.5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two, one = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    country = one.rlike("^[a-z]{2}$") & F.substring_index(two, ".", 1).isin(*SECOND_LEVEL)
    return F.when((two != one) & (country | two.isin(*PLATFORMS)), two).otherwise(one)


def domain_of(host: Column, suffix: Column) -> Column:
    name = F.regexp_replace(host, r":[0-9]*$", "")
    rest = F.when(F.length(name) > F.length(suffix) + 1, F.left(name, F.length(name) - F.length(suffix) - 1)).otherwise(F.lit(""))
    return F.when(rest == "", suffix).otherwise(F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a string; null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, a, b: posterior beta parameters of each host's bad rate.

    outcomes(host, bad): a row a page; bad is 1, 0 or null (not labelled). A hot host costs
    one row a task in the shuffle. The tables of hosts and domains stay distributed; four
    scalars reach the driver. A suffix with most domains is no hot key, as suffixes are sent to
    every task while they are few; the join of hosts with their domains is a plain equi-join that
    may split a platform's hosts.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host")))
    hosts = cut(hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    n, y = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    top = (y + 0.5) / (n + 1.0)

    def shrunk(level: DataFrame) -> DataFrame:
        """Adds a, b from columns n, y and the prior mean m."""
        n, y, m = F.col("n"), F.col("y"), F.col("m")
        got = level.agg(
            F.sum((y - n * m) ** 2 - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("scale")
        ).first()
        rho = got["over"] / got["scale"] if got["scale"] else RHO_RANGE[1]
        strength = 1 / min(max(rho, RHO_RANGE[0]), RHO_RANGE[1]) - 1
        return level.withColumn("a", strength * m + y).withColumn("b", strength * (1 - m) + n - y)

    def mean(level: DataFrame, key: str) -> DataFrame:
        return level.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))

    by_suffix = cut(mean(shrunk(suffixes.withColumn("m", F.lit(top))), "suffix"))
    if by_suffix.count() <= BROADCAST_SUFFIXES:
        by_suffix = F.broadcast(by_suffix)
    by_domain = mean(shrunk(cut(domains.join(by_suffix, "suffix"))), "domain")
    return shrunk(cut(hosts.join(by_domain, "domain"))).select("host", "n", F.col("y").alias("bad"), "a", "b")


def blocked(a: Column, b: Column, limit: float = LIMIT, sure: float = SURE) -> Column:
    return beta_cdf(F.lit(limit), a, b) <= 1.0 - sure


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, sure: float = SURE) -> DataFrame:
    """page_id, host, path, rule, verdict and n, bad, p_bad for each row of pages.

    outcomes(page_id, bad) may have any number of rows a page; a page is bad if one says so.
    A null url or one without :// has an empty host, judged as a host of its own. Repeated
    rows count as often as they occur.
    """
    marks = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputations(rows.select("page_id", "host").join(marks, "page_id", "left"))
    p_bad = 1.0 - beta_cdf(F.lit(limit), F.col("a"), F.col("b"))
    verdicts = cut(
        known.select("host", "n", "bad", p_bad.alias("p_bad"), F.when(blocked(F.col("a"), F.col("b"), limit, sure), "block").otherwise("allow").alias("_own"))
    )
    rule = rule_for(F.col("host"), F.col("path"), rules)
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for v, r in rules]) if rules else F.lit(None).cast("string")
    return (
        rows.join(verdicts, "host")
        .withColumn("rule", rule)
        .select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.col("_own")).alias("verdict"), "n", "bad", "p_bad")
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: the number in a page's path is the id of its document, whose quality is the outcome."""
    ref = F.expr("try_cast(regexp_extract(url, '/([0-9]+)([/?#.]|$)', 1) as bigint)")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    return pages.select("page_id", ref.alias("doc_id")).join(marks, "doc_id").select("page_id", "bad")


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the method's: the host's labelled pages, bad ones, and posterior probability that its bad rate exceeds LIMIT."""
    return filter_urls(pages, page_outcomes(pages, labels)).select(
        "page_id", "host", "path", "rule", "verdict", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), (F.round("p_bad", 6) + 0.0).alias("p_bad")
    )


_BETA_SQL = """
  , side AS (
    SELECT host, a >= 0 AS any_row, {x} >= (a + 1) / (a + b + 2) AS swap,
      CASE WHEN {x} >= (a + 1) / (a + b + 2) THEN b ELSE a END AS qa,
      CASE WHEN {x} >= (a + 1) / (a + b + 2) THEN a ELSE b END AS qb,
      CASE WHEN {x} >= (a + 1) / (a + b + 2) THEN 1 - {x} ELSE {x} END AS qx
    FROM posterior)
  , fraction AS (
    SELECT host, 0 AS m, qa, qb, qx, swap, 1.0::DOUBLE AS c, 1 / (1 - (qa + qb) * qx / (qa + 1)) AS d,
      1 / (1 - (qa + qb) * qx / (qa + 1)) AS h FROM side
    UNION ALL
    SELECT host, m, qa, qb, qx, swap, 1 + o / c1 AS c, 1 / (1 + o * d1) AS d, h1 * (1 + o / c1) / (1 + o * d1) AS h
    FROM (
      SELECT host, m + 1 AS m, qa, qb, qx, swap,
        -(qa + m + 1) * (qa + qb + m + 1) * qx / ((qa + 2 * (m + 1)) * (qa + 2 * (m + 1) + 1)) AS o,
        1 + e / c AS c1, 1 / (1 + e * d) AS d1, h * (1 + e / c) / (1 + e * d) AS h1
      FROM (SELECT *, (m + 1) * (qb - (m + 1)) * qx / ((qa + 2 * (m + 1) - 1) * (qa + 2 * (m + 1))) AS e FROM fraction)
    ) WHERE m <= 150)
  , tail AS (
    SELECT host, CASE WHEN swap THEN 1 - v ELSE v END AS below FROM (
      SELECT host, swap, h * exp(lgamma(qa + qb) - lgamma(qa) - lgamma(qb) + qa * ln(qx) + qb * ln(1 - qx)) / qa AS v
      FROM fraction WHERE m = 150))
"""


def _sql() -> str:
    quoted = lambda values: ", ".join(f"'{s}'" for s in values)
    two = "array_to_string(string_split(name, '.')[-2:], '.')"
    one = "string_split(name, '.')[-1]"
    both = f"{two} <> {one} AND (regexp_matches({one}, '^[a-z]{{2}}$') AND string_split({two}, '.')[1] IN ({quoted(SECOND_LEVEL)}) OR {two} IN ({quoted(PLATFORMS)}))"
    ordered = sorted(RULES, key=lambda r: -len(r[1]))

    def fits(rule: str) -> str:
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        return f"((host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}'))"

    lo, hi = RHO_RANGE

    def strength(table: str) -> str:
        return (
            "(SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) = 0 OR sum(n) IS NULL THEN "
            f"{hi} ELSE sum((y - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) END, {lo}), {hi}) - 1 FROM {table})"
        )

    return f"""
WITH RECURSIVE rows_ AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
      try_cast(regexp_extract(url, '/([0-9]+)([/?#.]|$)', 1) AS BIGINT) AS ref FROM pages)
  , marks AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)
  , outcomes AS (SELECT page_id, max(bad) AS bad FROM rows_ JOIN marks ON ref = doc_id GROUP BY page_id)
  , h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS y, regexp_replace(host, ':[0-9]*$', '') AS name
    FROM rows_ LEFT JOIN outcomes USING (page_id) GROUP BY host)
  , h1 AS (SELECT *, CASE WHEN {both} THEN {two} ELSE {one} END AS sfx FROM h0)
  , h2 AS (SELECT *, CASE WHEN length(name) > length(sfx) + 1
      THEN string_split(left(name, length(name) - length(sfx) - 1), '.')[-1] || '.' || sfx ELSE sfx END AS domain FROM h1)
  , s1 AS (SELECT sfx, sum(n) AS n, sum(y) AS y, (SELECT (sum(y) + 0.5) / (sum(n) + 1.0) FROM h2) AS m FROM h2 GROUP BY sfx)
  , s2 AS (SELECT sfx, (k * m + y) / (k + n) AS m FROM (SELECT *, {strength("s1")} AS k FROM s1))
  , d1 AS (SELECT domain, sum(n) AS n, sum(y) AS y, any_value(s2.m) AS m FROM h2 JOIN s2 USING (sfx) GROUP BY sfx, domain)
  , d2 AS (SELECT domain, (k * m + y) / (k + n) AS m FROM (SELECT *, {strength("d1")} AS k FROM d1))
  , hh AS (SELECT host, n, y, d2.m FROM h2 JOIN d2 USING (domain))
  , posterior AS (SELECT host, k * m + y AS a, k * (1 - m) + n - y AS b FROM (SELECT *, {strength("hh")} AS k FROM hh))
{_BETA_SQL.format(x=LIMIT)}
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)}
    WHEN below <= {1.0 - SURE} THEN 'block' ELSE 'allow' END AS verdict, n::BIGINT AS n, y::BIGINT AS bad, round(1 - below, 6) AS p_bad
FROM (SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered)} END AS rule, below, n, y
  FROM rows_ JOIN tail USING (host) JOIN hh USING (host))
"""


SQL = _sql()
