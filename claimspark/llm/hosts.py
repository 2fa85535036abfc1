"""URL filters: stated rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host, and shrunk through beta-binomial priors: a host's prior is its
registered domain's posterior, a domain's prior its suffix's, a suffix's prior that of all pages. How strong each
level's prior is, its pseudo-count, is estimated by the method of moments from how much rates differ within the level.
A page whose host's posterior share of bad pages is, at the lower bound, over a limit is blocked. The bound is the mean less
1.645 deviations of the beta posterior, a normal approximation of its quantile.

Everything is DataFrame expressions. Pages are counted by host on the map side, and the counts of each level are written
once; of a level only its prior's strength, one number, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels; any other suffix is a host's last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in")
#: Bounds of a prior's pseudo-count, how many deviations below the mean the bound lies, and the share of bad pages that is too much.
WEAKEST, STRONGEST, DEVIATIONS, LIMIT = 2.0, 200.0, 1.645, 0.25


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does. Of equally long ones the first wins."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def registered_of(host: Column) -> Column:
    """The suffix and one label more; a host that is only a suffix is its own."""
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(mean: Column, n: Column, rate: Column, weight: Column) -> Column:
    """Pseudo-count of a beta prior by the method of moments, over aggregates of a level's members.

    Expected variance of members' rates: m (1 - m) (1 + (n - 1) rho) / n, with rho = 1 / (pseudo-count + 1).
    """
    spread = F.sum(weight * (rate - mean) * (rate - mean))
    base = F.sum(weight * mean * (1 - mean) / n)
    slope = F.sum(weight * mean * (1 - mean) * (n - 1) / n)
    rho = (spread - base) / F.nullif(slope, F.lit(0.0))
    s = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(STRONGEST))
    return F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(s, F.lit(STRONGEST))))


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, a, b, mean and bound from rows (host, bad 0 or 1): each host's beta posterior of its share of bad pages.

    A row without ``bad`` is a page without outcome: its host is judged, by its domain, suffix or all pages if it has no
    other. Rows without host are left out. Hosts and domains without outcomes don't count in the estimates of strength.
    Without any outcome, or rows, the result is empty.
    """
    n, bad = F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = outcomes.where("host IS NOT NULL").groupBy("host").agg(n, bad)
    hosts = written(hosts.withColumn("domain", registered_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*sums), "suffixes")
    pages, bads = suffixes.agg(*sums).first()
    prior = (bads + 0.5) / (pages + 1) if pages else None

    def shrunk(level: DataFrame, key: str) -> DataFrame:
        """The level's rows, which have prior, with a, b and mean."""
        known = level.where("n > 0").agg(_strength(F.col("prior"), F.col("n"), F.col("bad") / F.col("n"), F.col("n")).alias("s"))
        s = F.lit(known.first()["s"])
        a, b = F.col("prior") * s + F.col("bad"), (1 - F.col("prior")) * s + F.col("n") - F.col("bad")
        return level.select(key, "n", "bad", a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))

    means = lambda level, key: shrunk(level, key).select(key, F.col("mean").alias("prior"))
    by_suffix = means(suffixes.withColumn("prior", F.lit(prior).cast("double")), "suffix")
    by_domain = means(domains.join(by_suffix, "suffix"), "domain")
    by_host = shrunk(hosts.select("host", "domain", "n", "bad").join(by_domain, "domain"), "host")
    deviation = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    return by_host.where("mean IS NOT NULL").select("host", "n", "bad", "a", "b", "mean", F.greatest(F.lit(0.0), F.col("mean") - DEVIATIONS * deviation).alias("bound"))


def judged(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, limit: float = LIMIT, key: str = "page_id") -> DataFrame:
    """pages with host, path, rule, verdict and bad_share (the posterior bound; null only if there is no labelled page at all).

    ``labels`` has bad (0 or 1) and, as pages have, the column ``key``; a key with several labels is bad if one says so, and rows with nulls are
    left out. A null url, or one without ``://``, has empty host and path, and counts as host '' like any other. Repeated
    pages each have their row and count once each. Hosts without labels are judged by their domain, suffix or all pages.
    Empty tables give an empty result; columns of ``pages`` with clashing names are replaced.
    """
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    known = labels.where(F.col(key).isNotNull() & F.col("bad").isNotNull()).groupBy(key).agg(F.max("bad").cast("int").alias("bad"))
    found = reputations(pages.select(key, "host").join(known, key, "left").select("host", "bad")).select(F.col("host").alias("__host"), F.col("bound").alias("bad_share"))
    out = pages.join(found, F.col("host") == F.col("__host"), "left").withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bad_share") > limit, "block").otherwise("allow")
    keep = [c for c in pages.columns if c not in ("rule", "verdict", "bad_share", "host", "path")]
    return out.select(*keep, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), method).alias("verdict"), "bad_share")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if its document, whose id is the first number in its path, is labelled of no quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("document"), bad.alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]+)", 1).try_cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", number.alias("document"))
    return judged(pages, labels, key="document").select("page_id", "host", "path", "rule", "verdict")


_STRENGTH_SQL = f"""
  SELECT greatest({WEAKEST}, least({STRONGEST}, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 END, {STRONGEST}))) AS s FROM (
    SELECT (sum(n * (bad / n - prior) ** 2) - sum(n * prior * (1 - prior) / n)) / nullif(sum(n * prior * (1 - prior) * (n - 1) / n), 0) AS rho
    FROM {{}} WHERE n > 0)"""

OP8_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), known AS (
  SELECT doc_id AS document, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), cut AS (
  SELECT host, bad, string_split(host, '.') AS labels
  FROM p LEFT JOIN known ON try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) = known.document
), named AS (
  SELECT host, bad, array_to_string(labels[-2:], '.') IN {TWO_LABEL_SUFFIXES} AS two, labels FROM cut
), hosts AS (
  SELECT host, array_to_string(labels[CASE WHEN two THEN -3 ELSE -2 END:], '.') AS domain,
    array_to_string(labels[CASE WHEN two THEN -2 ELSE -1 END:], '.') AS suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM named GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), s0 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM suffixes HAVING sum(n) > 0) AS prior FROM suffixes
), s1 AS ({_STRENGTH_SQL.format("s0")}
), d0 AS (SELECT d.*, (q.prior * s + q.bad) / (s + q.n) AS prior FROM domains d JOIN s0 q USING (suffix), s1
), d1 AS ({_STRENGTH_SQL.format("d0")}
), h0 AS (SELECT h.*, (q.prior * s + q.bad) / (s + q.n) AS prior FROM hosts h JOIN d0 q USING (domain), d1
), h1 AS ({_STRENGTH_SQL.format("h0")}
), known_hosts AS (
  SELECT host, greatest(0, a / (a + b) - {DEVIATIONS} * sqrt(a * b / (a + b + 1)) / (a + b)) AS bound
  FROM (SELECT host, prior * s + bad AS a, (1 - prior) * s + n - bad AS b FROM h0, h1)
), ruled AS (
  SELECT p.*, bound, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN known_hosts USING (host)
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
