"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes are counted per host, summed to registered domains and suffixes, and shrunk
down that chain: a suffix towards the overall rate, a domain towards its suffix, a host towards its
domain.  The strength of each prior is estimated from how far the groups of that level scatter
around their parents (method of moments for beta-binomial counts).  A host passes while the lower
bound of its posterior good rate reaches ``floor``; explicit rules come before reputation.

Defined cases: a null url or one without ``://`` has empty host and path and gets the overall
reputation; hosts without labels inherit their domain's; null outcomes are not counted; repeated
pages count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import ascii_lower, query, table
from skyframe.session import cut

#: One-sided normal quantile of the posterior bound (95 %).
Z = 1.645
#: Hosts whose posterior bound lies below this good rate are blocked.
FLOOR = 0.5
#: Bounds of the intra-group correlation, i.e. prior strengths of 1 to 999 pages.
RHO = (0.001, 0.5)

#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: str = "url") -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: str = "host") -> Column:
    """The last label, or the last two where they look like ``co.xx``."""
    return F.regexp_extract(host, r"(?:^|\.)((?:(?:co|com|net|org|edu|gov|ac)\.[a-z]{2})|[^.:]+)(?::\d*)?$", 1)


def domain_of(host: str = "host") -> Column:
    """The suffix with the label before it."""
    return F.regexp_extract(host, r"(?:^|\.)([^.]*\.?(?:(?:(?:co|com|net|org|edu|gov|ac)\.[a-z]{2})|[^.:]+))(?::\d*)?$", 1)


def matching_rule(rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``; nulls where none does.

    For rule lists short enough to be written into the plan.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength of one level; ``groups`` has n, s and the parent's rate m."""
    n, m = F.col("n"), F.col("m")
    scatter = F.sum(n * F.pow(F.col("s") / n - m, 2) - m * (1 - m))
    x, y = groups.where("n > 0").agg(scatter, F.sum(m * (1 - m) * (n - 1))).first()
    rho = min(max((x / y) if y else RHO[0], RHO[0]), RHO[1])
    return 1 / rho - 1


def _shrunk(groups: DataFrame, k: float) -> Column:
    return (F.lit(k) * F.col("m") + F.col("s")) / (F.lit(k) + F.col("n"))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, rate, bound) from ``hosts`` (host, n, s): pages labelled and pages labelled good."""
    hosts = cut(hosts.withColumns({"domain": domain_of(), "suffix": suffix_of()}))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    overall = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("m", F.lit(overall)))
    suffixes = cut(suffixes.select("suffix", _shrunk(suffixes, _strength(suffixes)).alias("m")))
    domains = cut(domains.join(suffixes, "suffix"))
    domains = cut(domains.select("suffix", "domain", _shrunk(domains, _strength(domains)).alias("m")))
    hosts = cut(hosts.join(domains, ["suffix", "domain"]))
    k = _strength(hosts)
    rate = _shrunk(hosts, k)
    sd = F.sqrt(rate * (1 - rate) / (F.lit(k) + F.col("n") + 1))
    return cut(hosts.select("host", "n", "s", rate.alias("rate"), (rate - Z * sd).alias("bound")))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict; ``outcomes`` is (host, good 0/1)."""
    seen = pages.select(host_of().alias("host")).groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    told = outcomes.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("s"))
    hosts = seen.unionByName(told).groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    bounds = reputation(hosts).select(F.col("host").alias("_host"), "bound")
    rule, verdict = matching_rule(rules)
    parts = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    # a hot host: both sides are shuffled tables, so adaptive execution splits its partition
    both = parts.join(bounds, F.col("host") == F.col("_host"), "left")
    by_bound = F.when(F.col("bound") >= floor, "allow").otherwise("block")
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_bound).alias("verdict"))


def _level(name: str, rows: str) -> str:
    return f"""{name} as (select 1 / greatest({RHO[0]}, least({RHO[1]}, coalesce(
      sum(n * pow(s::double / n - m, 2) - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), {RHO[0]}))) - 1 as k from {rows} where n > 0)"""


def _rule_sql(column: int) -> str:
    cases = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(h + p, v)[column]}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    )
    return f"case {cases} end"


_SUFFIX = r"(?:(?:co|com|net|org|edu|gov|ac)\.[a-z]{2})|[^.:]+"
SQL = rf"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
told as (select host, quality as good from parts join labels on try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1), '') as bigint) = doc_id where quality is not null),
hosts as (
  select host, sum(n) as n, sum(s) as s, regexp_extract(host, '(?:^|\.)([^.]*\.?(?:{_SUFFIX}))(?::\d*)?$', 1) as domain, regexp_extract(host, '(?:^|\.)({_SUFFIX})(?::\d*)?$', 1) as suffix
  from (select host, 0 as n, 0 as s from parts union all select host, 1, good from told) group by host),
overall as (select (coalesce(sum(s), 0) + 1)::double / (coalesce(sum(n), 0) + 2) as m from hosts),
suffixes as (select suffix, sum(n) as n, sum(s) as s, (select m from overall) as m from hosts group by suffix),
{_level('k1', 'suffixes')},
domains as (
  select d.suffix, domain, sum(d.n) as n, sum(d.s) as s, any_value(((select k from k1) * x.m + x.s) / ((select k from k1) + x.n)) as m
  from hosts d join suffixes x on d.suffix = x.suffix group by d.suffix, domain),
{_level('k2', 'domains')},
shrunk as (
  select h.host, h.n, h.s, ((select k from k2) * x.m + x.s) / ((select k from k2) + x.n) as m
  from hosts h join domains x on h.suffix = x.suffix and h.domain = x.domain),
{_level('k3', 'shrunk')},
rates as (select host, n, ((select k from k3) * m + s) / ((select k from k3) + n) as rate from shrunk),
bounds as (select host, rate - {Z} * sqrt(rate * (1 - rate) / ((select k from k3) + n + 1)) as bound from rates)
select page_id, p.host, path, {_rule_sql(0).replace('host', 'p.host')} as rule,
       coalesce({_rule_sql(1).replace('host', 'p.host')}, case when bound >= {FLOOR} then 'allow' else 'block' end) as verdict
from parts p left join bounds b on p.host = b.host
"""


@query("op4_url_filter", SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document whose number its path ends in."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(path_of(), r"^/[^/]*/([0-9]{1,18})", 1).try_cast("bigint")
    numbered = pages.select(host_of().alias("host"), number.alias("doc"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    outcomes = numbered.join(labels, numbered.doc == labels.doc_id).select("host", F.col("quality").alias("good"))
    return judge(pages, outcomes)
