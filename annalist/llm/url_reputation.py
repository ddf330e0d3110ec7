"""URL filters: explicit rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host, registered domain and suffix. The
rate of bad pages of each suffix is shrunk towards the corpus, of each domain
towards its suffix and of each host towards its domain, through beta-binomial
priors whose strengths the data give. A host is blocked when the lower bound of
its posterior lies above a threshold. All built-in functions.

Reputation is of the name in a host: without user, port and final dot. A
suffix is the longest of ``SUFFIXES`` that a name ends with, or its last label,
and the registered domain has one label more, so that unrelated owners under
``co.uk`` or ``github.io`` share a suffix and not a domain. An address in
numbers is its own domain, under the suffix ``ADDRESS``.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged like any other host; pages without labels
leave the posterior at the prior; without any labels the prior is even, which
blocks nothing; repeated pages count each, as do pages with a null id, which
have no label; several labels of a page are one outcome, bad if any is; an
empty table gives an empty table; other columns of pages and labels are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.graph import spread
from annalist.session import materialize

# Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Suffixes of two labels under which anyone may register, from registries and from hosting services.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "appspot.com", "azurewebsites.net", "blogspot.com", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk",
    "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.pe", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw",
    "com.ua", "com.ve", "edu.au", "edu.cn", "github.io", "gitlab.io", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.uk", "govt.nz", "herokuapp.com", "ltd.uk", "me.uk",
    "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "net.uk", "netlify.app", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.il", "org.in", "org.nz",
    "org.tw", "org.uk", "org.za", "pages.dev", "plc.uk", "vercel.app", "web.app", "wordpress.com",
)
ADDRESS = "(address)"
#: User, port and final dot of a host; addresses; names that end with a listed suffix.
USER, PORT, NUMERIC = r"^.*@", r":[0-9]*$", r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\]?)$"
LISTED = "(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.5
Z = 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def site(host: Column) -> Column:
    """The name or address in a host."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, ""), r"\.$", "")


def domain_and_suffix(name: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a name."""
    address, listed = name.rlike(NUMERIC), name.rlike(r"(^|\.)" + LISTED)
    domain = F.when(address, name).when(listed, F.regexp_extract(name, r"([^.]+\.)?" + LISTED, 0)).otherwise(F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0))
    suffix = F.when(address, F.lit(ADDRESS)).when(listed, F.regexp_extract(name, LISTED, 0)).otherwise(F.regexp_extract(name, r"[^.]*$", 0))
    return domain, suffix


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host or a parent of it, and the beginning of a path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _strength(x: str, n: str, mean: str) -> Column:
    """Prior strength over units with counts (x of n) and prior means: of beta-binomial dispersion, by moments."""
    m = F.col(mean)
    off = F.pow(F.col(x) - F.col(n) * m, 2) / (F.col(n) * m * (1 - m))
    rho = (F.sum(F.when(F.col(n) > 0, off)) - F.sum(F.when(F.col(n) > 0, 1.0))) / F.nullif(F.sum(n) - F.sum(F.when(F.col(n) > 0, 1.0)), F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.001)), F.lit(0.001)), F.lit(0.5))
    return ((1 - rho) / rho).alias("k")


def site_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``site, n, x`` (labelled pages, bad ones) to ``site, bad_rate, lower``: posterior mean and lower bound.

    The counts arrive combined per site. Each level is written once, as the
    one below reads its means and the level itself its strength, which is one
    row. Sites join their domains, and domains their suffixes, by shuffle, or
    by broadcast where the written side is small.
    """
    domain, suffix = domain_and_suffix(F.col("site"))
    sites = outcomes.select("site", "n", "x", domain.alias("domain"), suffix.alias("suffix"))
    domains = materialize(sites.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("x").alias("dx")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dx").alias("sx")), "suffixes")
    root = suffixes.agg(((F.coalesce(F.sum("sx"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2.0)).alias("m0"))

    def shrunk(units: DataFrame, x: str, n: str, mean: str, out: str) -> DataFrame:
        units = materialize(units, out)
        k = units.agg(_strength(x, n, mean))
        return units.crossJoin(F.broadcast(k)).withColumn(out, (F.col(x) + F.col("k") * F.col(mean)) / (F.col(n) + F.col("k")))

    suffixes = shrunk(suffixes.crossJoin(F.broadcast(root)), "sx", "sn", "m0", "ms").select("suffix", "ms")
    domains = shrunk(spread(domains, suffixes, "suffix"), "dx", "dn", "ms", "md").select(F.struct("domain", "suffix").alias("of"), "md")
    sites = shrunk(spread(sites.withColumn("of", F.struct("domain", "suffix")), domains, "of").drop("of"), "x", "n", "md", "bad_rate")
    a, b = F.col("x") + F.col("k") * F.col("md"), F.col("n") - F.col("x") + F.col("k") * (1 - F.col("md"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return sites.select("site", "bad_rate", (F.col("bad_rate") - z * deviation).alias("lower"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, z: float = Z
) -> DataFrame:
    """Each page with host, path, rule, verdict and its host's reputation.

    ``pages``: page_id, url. ``labels``: doc_id, quality, toxic; a page is bad
    when any label under its id is toxic or of quality 0.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcome = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = pages.join(outcome, "page_id", "left").groupBy(site(F.col("host")).alias("site")).agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("x")
    )
    # every level of the shrinkage starts from these counts: written once, pages and labels are read once for them
    counts = materialize(counts, "sites")
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    judged = materialize(site_reputation(counts, z), "reputation")
    return pages.withColumn("site", site(F.col("host"))).join(judged, "site").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(said, F.when(F.col("lower") > threshold, "block").otherwise("allow")).alias("verdict"),
        F.round("bad_rate", 6).alias("bad_rate"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _sql_strength(x: str, n: str, m: str, source: str) -> str:
    rho = f"(sum(({x} - {n} * {m}) * ({x} - {n} * {m}) / ({n} * {m} * (1 - {m}))) FILTER (WHERE {n} > 0) - count(*) FILTER (WHERE {n} > 0)) / nullif(sum({n}) - count(*) FILTER (WHERE {n} > 0), 0)"
    return f"(SELECT (1 - r) / r AS k FROM (SELECT least(greatest(coalesce({rho}, 0.001), 0.001), 0.5) AS r FROM {source}))"


SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM u),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
ps AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '{USER}', ''), '{PORT}', ''), '\\.$', '') AS site FROM p),
h0 AS (SELECT site, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS x FROM ps LEFT JOIN o USING (page_id) GROUP BY site),
h AS (SELECT *, CASE WHEN regexp_matches(site, '{NUMERIC}') THEN site WHEN regexp_matches(site, '(^|\\.){LISTED}') THEN regexp_extract(site, '([^.]+\\.)?{LISTED}', 0)
    ELSE regexp_extract(site, '([^.]*\\.)?[^.]*$', 0) END AS domain,
  CASE WHEN regexp_matches(site, '{NUMERIC}') THEN '{ADDRESS}' WHEN regexp_matches(site, '(^|\\.){LISTED}') THEN regexp_extract(site, '{LISTED}', 0)
    ELSE regexp_extract(site, '[^.]*$', 0) END AS suffix FROM h0),
d0 AS (SELECT domain, suffix, sum(n) AS dn, sum(x) AS dx FROM h GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(dn) AS sn, sum(dx) AS sx FROM d0 GROUP BY suffix),
r AS (SELECT (coalesce(sum(sx), 0) + 1.0) / (coalesce(sum(sn), 0) + 2.0) AS m0 FROM s0),
s1 AS (SELECT s0.*, CAST(m0 AS DOUBLE) AS m0 FROM s0 CROSS JOIN r),
s AS (SELECT suffix, (sx + k * m0) / (sn + k) AS ms FROM s1 CROSS JOIN {_sql_strength("sx", "sn", "m0", "s1")}),
d1 AS (SELECT d0.*, ms FROM d0 JOIN s USING (suffix)),
d AS (SELECT domain, suffix, (dx + k * ms) / (dn + k) AS md FROM d1 CROSS JOIN {_sql_strength("dx", "dn", "ms", "d1")}),
h1 AS (SELECT h.*, md FROM h JOIN d USING (domain, suffix)),
h2 AS (SELECT site, x + k * md AS a, n - x + k * (1 - md) AS b FROM h1 CROSS JOIN {_sql_strength("x", "n", "md", "h1")}),
rep AS (SELECT site, a / (a + b) AS bad_rate, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM h2),
j AS (SELECT page_id, host, path, bad_rate, lower, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM ps JOIN rep USING (site))
SELECT page_id, host, path, rule, CASE rule WHEN 'com/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'www.example.com/en/' THEN 'allow'
  WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' ELSE CASE WHEN lower > {THRESHOLD} THEN 'block' ELSE 'allow' END END AS verdict,
  round(bad_rate, 6) AS bad_rate FROM j
"""
