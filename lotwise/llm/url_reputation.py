"""URL filters by rules and by the reputation of hosts.

Labelled pages give each host a count of pages and of bad ones. The share of bad pages of a suffix, a
registered domain and a host is a beta-binomial hierarchy: a child's prior is a beta distribution around
its parent's posterior mean, as narrow as the children's spread about their parents says (method of
moments over all children of the level). A host is blocked where its posterior surely (``CONFIDENCE``)
puts the share of bad pages above ``LIMIT``, that is, where the posterior's lower bound lies above it; hosts
with few or no labelled pages lean on their domain and suffix and are rarely blocked for a single page.
Only counts by host are shuffled, pre-aggregated, and three numbers reach the driver.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import shared


class Rule(NamedTuple):
    """``verdict`` for the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
#: Second-level names under which registries of two-letter domains sell names.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: A host is blocked if its share of bad pages is above LIMIT with a probability of CONFIDENCE at least.
LIMIT, CONFIDENCE = 0.5, 0.95
#: Least and most that a level's children may be correlated; a prior weighs 1 / correlation - 1 pages.
CORRELATION = (1e-4, 0.9)
#: Number of the document that a page shows, at the end of the url's path.
PAGE_NUMBER = "/([0-9]{1,18})(?:\\.[a-z]+)?/?\\z"
LEVELS = ["suffix", "domain", "host"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or where ``://`` is missing."""
    begin = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[Rule] = RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, null if none does; of equal length the first listed wins."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for rule in sorted(rules, key=lambda r: -len(r.host + r.path))[::-1]:
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.verdict).alias("verdict"), F.lit(rule.host + rule.path).alias("rule"))).otherwise(found)
    return found


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user and port.

    The suffix is the last label, or the last two where a two-letter domain follows a name of
    SECOND_LEVEL; the domain is one label more. A host of digits and dots, one in brackets, and one that is
    no longer than its suffix are their own domain and suffix.
    """
    name = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":[0-9]*$", "")
    suffix = f"(?:(?:{'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}}|[^.]+)$"
    domain = F.regexp_extract(name, f"(?:^|\\.)([^.]+\\.{suffix})", 1)
    whole = (domain == "") | name.rlike("^[0-9.]*$") | F.startswith(name, F.lit("["))
    return F.when(whole, name).otherwise(domain), F.when(whole, name).otherwise(F.regexp_replace(domain, "^[^.]+\\.", ""))


def beta_tail(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """P(X > x) for X beta-distributed: the incomplete beta function's continued fraction (modified Lentz), all rows at once."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    # The fraction converges fast below the mean; above it the mirrored one does.
    mirrored = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(mirrored, b, a), np.where(mirrored, a, b), np.where(mirrored, 1 - x, x)
    front = np.exp((lgamma(p + q) - lgamma(p) - lgamma(q)).astype(np.float64) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny, d = 1e-300, 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, total, m = np.ones_like(d), d.copy(), 0
    moving = np.ones(len(d), bool)
    while moving.any():
        m += 1
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            factor = np.where(moving, d * c, 1.0)
            total = total * factor
        moving &= np.abs(factor - 1) > 1e-14
    below = front * total
    return np.where(mirrored, below, 1 - below)


def correlation_of(children: DataFrame) -> float:
    """Correlation of pages with the same child, by moments: ``children`` has n, bad and parent_mean."""
    n, mean = F.col("n"), F.col("parent_mean")
    spread = mean * (1 - mean)
    row = children.filter("n > 0").agg(
        F.sum(n * (F.col("bad") / n - mean) ** 2).alias("seen"), F.sum(spread).alias("even"), F.sum(spread * (n - 1)).alias("slope")
    ).first()
    found = (row.seen - row.even) / row.slope if row.slope else 0.0
    return min(max(found, CORRELATION[0]), CORRELATION[1])


def host_counts(pages: DataFrame, outcomes: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """host, domain, suffix, pages, n, bad of every host of ``pages``.

    ``outcomes`` has id and bad (0 or 1, null is no label); of labels that repeat an id the worst counts. n
    and bad count labelled pages, rows that repeat an id each. Pages without an id have no label.
    """
    worst = outcomes.filter("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = pages.select(F.col(id_column).alias("id"), url_parts(F.col(url_column))[0].alias("host"))
    counts = (
        rows.filter("id is not null").join(worst, "id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        .withColumn("pages", F.lit(0).cast("long"))
        .unionByName(rows.groupBy("host").agg(F.count("*").alias("pages")).withColumns({"n": F.lit(0).cast("long"), "bad": F.lit(0).cast("long")}))
        .groupBy("host").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "bad")))
    )
    domain, suffix = domain_and_suffix(F.col("host"))
    return counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "bad")


def reputations(hosts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """host, pages, n, bad, bad_rate (posterior mean), confidence (that the share of bad pages is above ``limit``).

    ``hosts`` as :func:`host_counts` gives it. Each level is shrunk towards the level above, the suffixes
    towards the share of all pages; without any label every host has a share of one half and no weight.
    """
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (whole.bad + 0.5) / (whole.n + 1)
    above, written = None, []
    for k, level in enumerate(LEVELS):
        parent = LEVELS[k - 1] if k else None
        keys = [level] if parent is None else [level, parent]
        rows = hosts if level == "host" else hosts.groupBy(*keys).agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts"))
        if parent is None:
            rows = rows.withColumn("parent_mean", F.lit(mean))
        else:  # a suffix or domain may hold a third of what lies below it
            parents = above.select(parent, F.col("mean").alias("parent_mean"), "hosts")
            heavy = parents.filter(F.col("hosts") * shared.HEAVY_SHARE >= hosts.count()).select(parent)
            rows = shared.join_by_group(rows, parents.drop("hosts"), heavy, [parent])
        rows = shared.written(rows, f"{level}-reputation")
        written.append(rows)
        weight = 1 / correlation_of(rows) - 1
        a = F.col("bad") + weight * F.col("parent_mean")
        b = F.col("n") - F.col("bad") + weight * (1 - F.col("parent_mean"))
        above = rows.withColumns({"mean": a / (a + b), "a": a, "b": b})

    @pandas_udf("double")
    def confidence(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_tail(a.to_numpy(), b.to_numpy(), limit))

    found = shared.written(above.select("host", "pages", "n", "bad", F.col("mean").alias("bad_rate"), confidence("a", "b").alias("confidence")), "reputation")
    shared.discard(*written)
    return found


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule] = RULES, limit: float = LIMIT, confidence: float = CONFIDENCE, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict, bad_rate, confidence.

    The longest rule that fits decides; without one the host's reputation does: block where ``confidence`` is
    reached, else allow. A url that is null or has no ``://`` has the empty host, which is a host like any
    other; pages with null or repeated ids are judged one by one; an empty table gives no rows; columns other
    than the two named are never looked at.
    """
    hosts = shared.written(host_counts(pages, outcomes, id_column, url_column), "hosts")
    known = reputations(hosts, limit)
    host, path = url_parts(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    heavy = known.filter(F.col("pages") * shared.HEAVY_SHARE >= (hosts.agg(F.sum("pages")).first()[0] or 0)).select("host")
    judged = shared.join_by_group(rows, known.select("host", "bad_rate", F.col("confidence").alias("sure")), heavy, ["host"])
    ruled = judged.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("sure") >= confidence, "block").otherwise("allow")
    out = ruled.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), "bad_rate", F.col("sure").alias("confidence"))
    shared.discard(hosts)
    return out


def keep_allowed(pages: DataFrame, outcomes: DataFrame, rules: list[Rule] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """The pages whose verdict is allow, columns unchanged; only the hosts to be blocked are joined with them."""
    hosts = shared.written(host_counts(pages, outcomes, id_column, url_column), "hosts")
    known = reputations(hosts)
    shared.discard(hosts)
    blocked = known.filter(F.col("confidence") >= CONFIDENCE).select("host")
    host, path = url_parts(F.col(f"`{url_column}`"))
    rows = shared.row_and_columns(pages, host.alias("host"), rule_of(host, path, rules)["verdict"].alias("verdict"))
    by_rule, others = rows.filter("verdict = 'allow'"), rows.filter("verdict is null")
    return by_rule.drop("host").unionByName(others.join(blocked, "host", "left_anti").drop("host")).select(*shared.row_fields(pages))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """id, bad of labelled pages: a page shows the document whose number ends its path, and is bad if that one is toxic or of low quality.

    Of labels that repeat a document the worst counts; a null label says nothing.
    """
    number = F.regexp_extract(url_parts(F.col("url"))[1], PAGE_NUMBER, 1)
    shown = pages.select(F.col("page_id").alias("id"), number.try_cast("long").alias("doc_id")).filter("doc_id is not null")
    bad = F.max(F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int")))
    return shown.join(labels.groupBy("doc_id").agg(bad.alias("bad")).filter("bad is not null"), "doc_id").select("id", "bad")


def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge(pages, page_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.withColumns({c: F.round(c, 9) for c in ("bad_rate", "confidence")})


def oracle() -> str:
    """The same in SQL: levels by CTEs, the continued fraction of the beta tail by recursion."""
    ids = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    low, high = CORRELATION
    sql = f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {ids}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
bad AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels GROUP BY doc_id),
outcome AS (SELECT page_id, max(bad) AS bad FROM p JOIN bad ON doc_id = try_cast(regexp_extract(path, '{PAGE_NUMBER}', 1) AS BIGINT)
            WHERE bad IS NOT NULL GROUP BY page_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN outcome USING (page_id) GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', '') AS name FROM counted),
placed AS (SELECT *, regexp_extract(name, '(?:^|\\.)([^.]+\\.(?:(?:{'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}}|[^.]+)$)', 1) AS d FROM named),
hosts AS (SELECT host, n, bad, CASE WHEN whole THEN name ELSE d END AS domain, CASE WHEN whole THEN name ELSE regexp_replace(d, '^[^.]+\\.', '') END AS suffix
          FROM (SELECT *, d = '' OR regexp_matches(name, '^[0-9.]*$') OR starts_with(name, '[') AS whole FROM placed)),
top AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS mean FROM hosts)"""
    for level, parent in zip(LEVELS, [None, *LEVELS], strict=False):
        keys = level if parent is None else f"{level}, {parent}" if level != "host" else "host, domain"
        source = f"(SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY {keys})"
        joined = f"{source} CROSS JOIN (SELECT mean AS parent_mean FROM top)" if parent is None else f"{source} JOIN (SELECT {parent}, mean AS parent_mean FROM {parent}_mean) USING ({parent})"
        sql += f""",
{level}_rows AS (SELECT * FROM {joined}),
{level}_weight AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - parent_mean) ** 2) - sum(parent_mean * (1 - parent_mean)))
    / nullif(sum(parent_mean * (1 - parent_mean) * (n - 1)), 0), 0), {low}), {high}) - 1 AS weight FROM {level}_rows WHERE n > 0),
{level}_mean AS (SELECT *, a / (a + b) AS mean FROM (
    SELECT r.*, bad + weight * parent_mean AS a, n - bad + weight * (1 - parent_mean) AS b FROM {level}_rows r CROSS JOIN {level}_weight))"""
    return sql + f""",
side AS (SELECT host, a, b, {LIMIT} > (a + 1) / (a + b + 2) AS mirrored FROM host_mean),
beta AS (SELECT host, mirrored, CASE WHEN mirrored THEN b ELSE a END AS p, CASE WHEN mirrored THEN a ELSE b END AS q,
                CASE WHEN mirrored THEN 1 - {LIMIT} ELSE {LIMIT} END AS z FROM side),
fraction(host, p, q, z, m, c, d, total, factor) AS (
  SELECT host, p, q, z, 0, 1.0::DOUBLE, 1 / (1 - (p + q) * z / (p + 1)), 1 / (1 - (p + q) * z / (p + 1)), 2.0::DOUBLE FROM beta
  UNION ALL
  SELECT host, p, q, z, m, c2, d2, total * d1 * c1 * d2 * c2, d2 * c2 FROM (
    SELECT *, 1 / (1 + odd * d1) AS d2, 1 + odd / c1 AS c2 FROM (
      SELECT *, 1 / (1 + even * d) AS d1, 1 + even / c AS c1 FROM (
        SELECT host, p, q, z, m + 1 AS m, c, d, total, (m + 1) * (q - (m + 1)) * z / ((p + 2 * m + 1) * (p + 2 * m + 2)) AS even,
               -(p + m + 1) * (p + q + m + 1) * z / ((p + 2 * m + 2) * (p + 2 * m + 3)) AS odd
        FROM fraction WHERE abs(factor - 1) > 1e-14)))),
sure AS (
  SELECT host, CASE WHEN mirrored THEN below ELSE 1 - below END AS confidence
  FROM (SELECT f.host, mirrored, exp(lgamma(f.p + f.q) - lgamma(f.p) - lgamma(f.q) + f.p * ln(f.z) + f.q * ln(1 - f.z)) / f.p * total AS below
        FROM fraction f JOIN beta USING (host) WHERE abs(factor - 1) <= 1e-14)),
ruled AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.verdict, length(r.host || r.path)) AS verdict, arg_max(r.host || r.path, length(r.host || r.path)) AS rule
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN confidence >= {CONFIDENCE} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 9) AS bad_rate, round(confidence, 9) AS confidence
FROM ruled JOIN sure USING (host) JOIN host_mean USING (host)
"""


QUERIES = {"op12_url_reputation": op12_url_reputation}
ORACLE_SQL = {"op12_url_reputation": oracle()}
