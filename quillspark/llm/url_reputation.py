"""URL filters: rules first, then an Empirical-Bayes reputation of hosts.

Labelled pages are good or bad. The bad share of a suffix is shrunk towards that of all pages, of a registered domain
towards its suffix, of a host towards its domain: each is a beta-binomial posterior whose prior has the mean of the level
above and a strength estimated from the spread of the shares of its level (method of moments). A url is blocked if the
lower bound of its host's posterior, a quantile of the beta distribution, is above a threshold: a multiple of the bad share
of all pages, as what is a bad host depends on how common bad pages are. The quantile is above the threshold where the
distribution has less than its part below it, which is an incomplete beta function, written as a continued fraction.

Tables of hosts are made by aggregation and met by joins, so their number may grow with the input; Spark may split a host
that has a great part of all pages, as its side of the last join is not aggregated again.

Nulls: a null url, or one without ``://``, has an empty host and path; all such urls are judged as one host. Null labels
are left out; repeated labels of a page count once (bad if any says so); a null page_id has no label. Repeated rows are
judged each. Without labels everything the rules don't decide is allowed. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path); the longest that fits decides.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Block hosts whose bad share is above so many times that of all pages, but for a probability of RISK.
TIMES, RISK = 1.25, 0.05
#: Terms of the continued fraction: beyond the root of the greatest strength and of what labels a host may have (250,000).
TERMS = 500
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
#: Labels that registries put below a country's, so that the suffix has two labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict, null if none fits. Rules are few; each is a test in the projection."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def with_levels(df: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``suffix`` of ``host``; user names and ports don't count."""
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    part = F.split(name, r"\.")
    n = F.size(part)
    ip = name.rlike(r"^[0-9.]+$|^\[")
    two = (n > 2) & (F.length(F.element_at(part, -1)) == 2) & F.try_element_at(part, F.lit(-2)).isin(*SECOND_LEVEL)
    last = lambda k: F.array_join(F.slice(part, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    suffix = F.when(ip, name).when(two, last(2)).otherwise(last(1))
    domain = F.when(ip, name).when(two, last(3)).otherwise(last(2))
    return df.withColumns({"domain": domain, "suffix": suffix})


def _strength(groups: DataFrame) -> float:
    """The beta prior's strength from (n, bad) of groups and the mean ``mu`` of the level above, by moments."""
    x = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("g"),
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mu"), 2) / F.col("n")).alias("s"), F.sum(F.col("mu") * (1 - F.col("mu"))).alias("v"), F.sum(F.col("n") * F.col("mu") * (1 - F.col("mu"))).alias("nv"),
    ).first()
    # E[s] = v + (spread / mean variance) * (n - g): what is beyond chance is the spread of the groups' own shares
    if not x.g or not x.nv or x.n <= x.g:
        return MOST_STRENGTH
    share = (x.s - x.v) / ((x.n - x.g) * x.nv / x.n)  # the spread as a part of mu * (1 - mu): 1 / (strength + 1)
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / share - 1)) if share > 0 else MOST_STRENGTH


#: Lanczos' coefficients of the gamma function (g = 7).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _log_gamma(x: Column) -> Column:
    """For positive numbers, from that of the next one (which keeps small ones exact)."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (x + i)
    t = x + 7.5
    return 0.9189385332046727 + (x + 0.5) * F.log(t) - t + F.log(total) - F.log(x)  # log of the root of 2 pi first


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term to its first."""
    def term(m: Column) -> Column:
        k = F.floor(m / 2).cast("double")
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return F.when(m % 2 == 1, odd).otherwise(k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)))

    return F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda v, m: 1 + term(m) / v)


def beta_below(a: Column, b: Column, x: Column) -> Column:
    """How much of the beta distribution of a and b is below x."""
    front = F.exp(a * F.log(x) + b * F.log(1 - x) + _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b))
    left = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(left, a).otherwise(b), F.when(left, b).otherwise(a), F.when(left, x).otherwise(1 - x)
    part = front / p / _fraction(p, q, y)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(left, part).otherwise(1 - part)


def reputations(labelled: DataFrame, times: float = TIMES) -> DataFrame:
    """(host, mean, below) of all hosts, from one row per page: host and bad (0, 1 or null). below: the probability that the
    host's bad share is no more than ``times`` that of all pages; 1 where there are no bad pages or no labels.
    """
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialise(with_levels(hosts))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    above = hosts.withColumn("mu", F.lit((total.bad or 0) / total.n if total.n else 0.0))
    for level in ("suffix", "domain"):
        groups = above.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("mu").alias("mu"))
        m = _strength(groups.filter("n > 0"))
        groups = groups.select(level, ((F.col("mu") * m + F.col("bad")) / (m + F.col("n"))).alias("mu"))
        above = materialise(above.drop("mu").join(groups, level))
    m = _strength(above.filter("n > 0"))
    a, b = F.col("mu") * m + F.col("bad"), (1 - F.col("mu")) * m + F.col("n") - F.col("bad")
    limit = times * (total.bad or 0) / total.n if total.n else 0.0
    rows = above.select("host", a.alias("a"), b.alias("b"))
    below = beta_below(F.col("a"), F.col("b"), F.lit(float(limit))) if 0 < limit < 1 else F.lit(1.0)
    return rows.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), below.alias("below"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, times: float = TIMES, risk: float = RISK) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_mean, bad_certainty (that the share is above the threshold)."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad")
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    found = materialise(reputations(cut.join(known, "page_id", "left"), times))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("below") < risk, "block").otherwise("allow")  # the quantile is above the threshold
    return cut.join(found, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("mean", 6).alias("bad_mean"), F.round(1 - F.col("below"), 6).alias("bad_certainty"))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def _sql_level(name: str, above: str, key: str) -> str:
    """DuckDB: shares of the groups of ``key`` shrunk towards the mean ``mu`` of ``above`` (host, n, bad, mu and keys)."""
    return f"""{name}_g AS (
  SELECT {key}, sum(n) AS n, sum(bad) AS bad, max(mu) AS mu FROM {above} GROUP BY {key}
), {_sql_strength(name, f"{name}_g")}, {name} AS (
  SELECT a.* EXCLUDE (mu), (g.mu * m + g.bad) / (m + g.n) AS mu FROM {above} a JOIN {name}_g g USING ({key}), {name}_m
)"""


def _sql_strength(name: str, groups: str) -> str:
    return f"""{name}_x AS (
  SELECT count(*) AS g, sum(n) AS n, sum(pow(bad - n * mu, 2) / n) AS s, sum(mu * (1 - mu)) AS v, sum(n * mu * (1 - mu)) AS nv FROM {groups} WHERE n > 0
), {name}_m AS (
  SELECT CASE WHEN g = 0 OR coalesce(nv, 0) = 0 OR n <= g OR s <= v THEN {MOST_STRENGTH} ELSE least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, 1 / ((s - v) / ((n - g) * nv / n)) - 1)) END AS m FROM {name}_x
)"""


def _sql_rules(what: int) -> str:
    out = "CASE"
    for rule in sorted(RULES, key=lambda r: -len(r[1])):
        of, _, rest = rule[1].partition("/")
        out += f" WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{rest}') THEN '{rule[what]}'"
    return out + " END"


OP1_SQL = rf"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), known AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM cut LEFT JOIN known USING (page_id) GROUP BY host
), p AS (
  SELECT *, string_split(name, '.') AS part, regexp_matches(name, '^[0-9.]+$|^\[') AS ip FROM h
), q AS (
  SELECT *, len(part) > 2 AND length(part[-1]) = 2 AND part[-2] IN ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) AS two FROM p
), l AS (
  SELECT host, n, bad, CASE WHEN ip THEN name WHEN two THEN array_to_string(part[-2:], '.') ELSE part[-1] END AS suffix,
    CASE WHEN ip THEN name WHEN two THEN array_to_string(part[-3:], '.') ELSE array_to_string(part[-2:], '.') END AS domain,
    (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END FROM h) AS mu FROM q
), {_sql_level("s", "l", "suffix")}, {_sql_level("d", "s", "domain")}, {_sql_strength("e", "d")}, f AS (
  SELECT host, mu * m + bad AS a, (1 - mu) * m + n - bad AS b FROM d, e_m
), t AS (
  SELECT host, a, b, x, x < (a + 1) / (a + b + 2) AS near FROM f, (SELECT {TIMES} * coalesce(sum(bad), 0) / nullif(sum(n), 0)::DOUBLE AS x FROM h)
), u AS (
  SELECT *, CASE WHEN near THEN a ELSE b END AS p, CASE WHEN near THEN b ELSE a END AS q, CASE WHEN near THEN x ELSE 1 - x END AS y FROM t
), v AS (
  SELECT host, a, b, x, near, exp(a * ln(x) + b * ln(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / p / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({TERMS}, 0, -1), lambda m: m::DOUBLE)),
    lambda w, m: 1 + CASE WHEN m % 2 = 1 THEN -(p + (m - 1) / 2) * (p + q + (m - 1) / 2) * y / ((p + m - 1) * (p + m)) ELSE (m / 2) * (q - m / 2) * y / ((p + m - 1) * (p + m)) END / w) AS part FROM u WHERE x > 0 AND x < 1
), r AS (
  SELECT f.host, f.a / (f.a + f.b) AS mean, coalesce(CASE WHEN near THEN part ELSE 1 - part END, 1) AS below FROM f LEFT JOIN v ON f.host = v.host
)
SELECT page_id, host, path, {_sql_rules(1)} AS rule, coalesce({_sql_rules(0)}, CASE WHEN below < {RISK} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_mean, round(1 - below, 6) AS bad_certainty
FROM cut JOIN r USING (host)
"""
