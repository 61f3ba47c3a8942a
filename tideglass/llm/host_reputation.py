"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled page outcomes are shrunk through beta-binomial priors: the prior of
a host is its registered domain's posterior mean, the domain's that of its
suffix, the suffix's that of all pages; how strongly each level shrinks is
estimated from the spread between its members (method of moments).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_groups, materialize


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains where the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: A host is blocked when its good rate's posterior mean plus Z deviations is under MIN_GOOD.
MIN_GOOD, Z = 0.87, 1.0
#: Bounds of a level's estimated strength, in pseudo-outcomes.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.lit(2**31 - 1))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain (last two labels) and suffix (last label)."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def strength(members: DataFrame) -> float:
    """Prior strength of a level from its members' (good, n); beta-binomial method of moments."""
    seen = members.filter("n > 0")
    k, n, good, n2 = seen.agg(F.count(F.lit(1)), F.sum("n"), F.sum("good"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    if not k or k < 2 or good in (0, n):
        return MOST_STRENGTH
    mean = good / n
    spread = seen.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, F.lit(2.0)))).first()[0]
    free = n - n2 / n - (k - 1)
    if free <= 0:
        return MOST_STRENGTH
    rho = (spread - mean * (1 - mean) * (k - 1)) / (mean * (1 - mean) * free)
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1)) if rho > 0 else MOST_STRENGTH


def host_reputation(hosts: DataFrame) -> DataFrame:
    """Adds posterior mean and deviation to rows (host, pages, n, good), one per host.

    n and good count labelled pages, and the good ones; a host without any
    has its domain's mean as its own, with the prior's full deviation.
    """
    domain, suffix = domain_parts(F.col("host"))
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("members").alias("members")]
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("members"))
    domains = materialize(domains, "domains")
    n_hosts, n_domains = hosts.count(), domains.count()
    suffixes = domains.withColumn("members", F.lit(1)).groupBy("suffix").agg(*sums)
    labelled, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (good + 1) / (labelled + 2) if labelled else 0.5

    def posterior(of: DataFrame, prior: Column | float, by: float) -> DataFrame:
        return of.withColumn("mean", (F.col("good") + by * prior) / (F.col("n") + by)).withColumn("precision", F.col("n") + by)

    top = posterior(suffixes, F.lit(overall), strength(suffixes)).select("suffix", "members", F.col("mean").alias("prior"))
    middle = join_groups(domains.select("domain", "suffix", F.col("n"), F.col("good"), F.col("members").alias("hosts_in")), top, ["suffix"], "members", n_domains)
    middle = posterior(middle, F.col("prior"), strength(domains)).select("domain", F.col("hosts_in").alias("members"), F.col("mean").alias("prior"))
    found = posterior(join_groups(hosts, middle, ["domain"], "members", n_hosts), F.col("prior"), strength(hosts))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("precision") + 1))
    return found.select("host", "pages", "n", "good", "mean", sd.alias("sd"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, min_good: float = MIN_GOOD, z: float = Z) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_labelled, good_rate, bound.

    outcomes: page_id, good (1 or 0; null counts as not labelled). good_rate
    is the host's posterior mean, bound that plus z deviations; the method
    blocks a host whose bound is under min_good. The longest fitting rule
    goes first. A url that is null or has no '://' has empty host and path,
    and those pages form one host. Pages that repeat an id are judged each,
    and each counts with that id's outcome; of several outcomes of one id
    the worst counts. Without outcomes every rate is 0.5, and the bound
    decides as for any other rate. Empty in, empty out.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").cast("long").alias("good"))
    joined = parts.join(known.withColumnRenamed("page_id", "__id"), parts["page_id"] == F.col("__id"), "left")
    hosts = joined.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    reputation = materialize(host_reputation(hosts), "reputation")
    total = reputation.agg(F.sum("pages")).first()[0] or 0
    judged = join_groups(parts, reputation, ["host"], "pages", total)
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    bound = F.col("mean") + z * F.col("sd")
    own = F.when(bound < min_good, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"),
        F.col("n").alias("n_labelled"), F.col("mean").alias("good_rate"), bound.alias("bound"),
    )


OP7_SQL = rf"""
with parts as (
  select page_id, case when instr(u, '://') > 0 then substr(u, instr(u, '://') + 3) else '' end as rest
  from (select page_id, coalesce(url, '') as u from pages)
), cut as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), known as (
  select doc_id, min(quality)::bigint as good from labels where doc_id is not null and quality is not null group by doc_id
), hosts as (
  select host, count(good) as n, coalesce(sum(good), 0)::bigint as good,
    array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix
  from cut left join known on page_id = doc_id group by host
), domains as (
  select domain, suffix, sum(n)::bigint as n, sum(good)::bigint as good from hosts group by domain, suffix
), suffixes as (
  select suffix, sum(n)::bigint as n, sum(good)::bigint as good from domains group by suffix
), members as (
  select 1 as level, n, good from suffixes union all select 2, n, good from domains union all select 3, n, good from hosts
), means as (
  select level, count(*) as k, sum(n)::double as n, sum(good)::double as good, sum(n::double * n) as n2 from members where n > 0 group by level
), spreads as (
  select level, sum(m.n * pow(m.good / m.n - means.good / means.n, 2.0)) as spread
  from members m join means using (level) where m.n > 0 group by level
), rhos as (
  select level, k, n, good, n - n2 / n - (k - 1) as free, good / n as mean, spread from means join spreads using (level)
), strengths as (
  select level, case when k < 2 or good = 0 or good = n or free <= 0 then {MOST_STRENGTH}
    when spread - mean * (1 - mean) * (k - 1) <= 0 then {MOST_STRENGTH}
    else least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, 1 / ((spread - mean * (1 - mean) * (k - 1)) / (mean * (1 - mean) * free)) - 1)) end as s
  from rhos
), overall as (
  select case when coalesce(sum(n), 0) = 0 then 0.5 else (sum(good) + 1) / (sum(n) + 2)::double end as p from hosts
), top as (
  select suffix, (good + s * p) / (n + s) as prior from suffixes, overall, (select coalesce(max(s), {MOST_STRENGTH}) as s from strengths where level = 1)
), middle as (
  select domain, suffix, (good + s * prior) / (n + s) as prior
  from domains join top using (suffix), (select coalesce(max(s), {MOST_STRENGTH}) as s from strengths where level = 2)
), reputation as (
  select host, n, (good + s * prior) / (n + s) as mean, n + s as precision
  from hosts join middle using (domain, suffix), (select coalesce(max(s), {MOST_STRENGTH}) as s from strengths where level = 3)
), judged as (
  select page_id, host, path, n as n_labelled, mean as good_rate, mean + {Z} * sqrt(mean * (1 - mean) / (precision + 1)) as bound,
    case when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from cut join reputation using (host)
)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when bound < {MIN_GOOD} then 'block' else 'allow' end as verdict,
  n_labelled, good_rate, bound
from judged
"""
