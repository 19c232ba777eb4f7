"""URL filters: explicit rules first, then empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import LOWER, UPPER, broadcast_upto, cut

#: (verdict, rule): a rule is a host, then the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_RULES = 1000
#: Rows of host reputation that may be broadcast (about 100 bytes each).
HOSTS_BROADCAST = 200_000

#: Fixed values, as the public suffix list states them: suffixes of several labels under which names are registered, names
#: whose every child is a suffix (``*``), and exceptions to those (``!``). Any other host's suffix is its last label.
SUFFIX_RULES = (
    "ac.at", "co.at", "gv.at", "or.at", "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "*.bd", "com.br", "edu.br", "gov.br", "net.br", "org.br",
    "*.ck", "!www.ck", "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.co", "net.co", "org.co", "com.es", "org.es", "asso.fr", "com.fr", "gouv.fr",
    "com.hk", "edu.hk", "gov.hk", "org.hk", "ac.id", "co.id", "go.id", "or.id", "ac.il", "co.il", "gov.il", "org.il", "ac.in", "co.in", "gov.in", "net.in", "org.in",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp", "*.nagoya.jp", "!city.nagoya.jp",
    "*.sapporo.jp", "!city.sapporo.jp", "*.sendai.jp", "!city.sendai.jp", "*.yokohama.jp", "!city.yokohama.jp", "*.kh", "ac.kr", "co.kr", "go.kr", "ne.kr", "or.kr", "pe.kr", "re.kr",
    "com.mx", "edu.mx", "gob.mx", "org.mx", "*.mm", "com.my", "edu.my", "gov.my", "*.np", "ac.nz", "co.nz", "geek.nz", "govt.nz", "net.nz", "org.nz", "school.nz", "com.ph", "com.pl", "edu.pl", "gov.pl", "org.pl",
    "com.sg", "edu.sg", "gov.sg", "ac.th", "co.th", "go.th", "com.tr", "edu.tr", "gov.tr", "org.tr", "com.tw", "edu.tw", "gov.tw", "org.tw", "com.ua", "gov.ua", "org.ua",
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "police.uk", "*.sch.uk", "com.vn", "edu.vn", "gov.vn", "ac.za", "co.za", "gov.za", "org.za",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def registered(host: Column, rules: tuple[str, ...] = SUFFIX_RULES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user, port and final dots; an address in numbers is its own domain and suffix.

    Of the rules that fit, an exception counts first, then the longest; a host that is a suffix itself is its own domain.
    Rules hold up to three labels.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.+$", "")
    tail = {k: F.substring_index(name, ".", -k) for k in (1, 2, 3, 4)}
    labels = F.size(F.split(name, r"\."))
    plain = lambda k: [r for r in rules if r[0] not in "*!" and r.count(".") == k - 1]
    stars = lambda k: [r[2:] for r in rules if r[0] == "*" and r.count(".") == k - 1]
    out = lambda k: [r[1:] for r in rules if r[0] == "!" and r.count(".") == k]
    inside = lambda c, listed: c.isin(*listed) if listed else F.lit(False)
    size = F.when(inside(tail[3], out(2)), 2).when(inside(tail[2], out(1)), 1)
    for k in (3, 2):
        size = size.when((labels >= k) & (inside(tail[k], plain(k)) | inside(tail[k - 1], stars(k))), k)
    size = size.otherwise(1)
    numbers = name.rlike(r"^[0-9.]+$|^\[")
    pick = lambda more: F.when(numbers, name).when(size == 3, tail[3 + more]).when(size == 2, tail[2 + more]).otherwise(tail[1 + more])
    return pick(1), pick(0)


def _strength(stats: DataFrame) -> float:
    """Prior strength of a level by moments, from ``stats(n, x, parent_mean)`` of its members."""
    sums = stats.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("parent_mean")).alias("np"),
        F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("parent_mean"), F.lit(2))).alias("s"),
    )
    p = F.col("np") / F.nullif(F.col("n"), F.lit(0))
    v = p * (1 - p)
    gamma = F.try_divide(F.col("s") - v * (F.col("k") - 1), v * (F.col("n") - F.try_divide(F.col("nn"), F.col("n")) - (F.col("k") - 1)))
    bounded = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce(gamma, F.lit(0.1))))
    return sums.select(((1 - bounded) / bounded).alias("m")).first().m


def _level(counts: DataFrame, keys: list[str], parents: DataFrame, parent_keys: list[str], total_mean: float) -> DataFrame:
    """Posterior means of one level: its outcomes shrunk to the posterior mean of its parent."""
    own = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    own = own.join(parents, parent_keys, "left") if parent_keys else own.withColumn("parent_mean", F.lit(total_mean))
    return own.withColumn("m", F.lit(_strength(own))).withColumn("mean", (F.col("x") + F.col("m") * F.col("parent_mean")) / (F.col("n") + F.col("m")))


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, n, bad_mean, bad_low`` of all ``hosts(host)`` from labelled pages ``outcomes(host, bad)``; ``bad`` is 0 or 1.

    Registered domain and suffix follow the rules of ``registered``. Rates shrink from host to domain to suffix to the
    overall rate by beta-binomial priors, whose strengths come from the spread at each level. A host without labelled pages has its prior: the posterior of its domain, else of its suffix, else the overall rate.
    ``bad_low`` is the posterior mean less 1.645 posterior standard deviations.
    """

    def named(df: DataFrame) -> DataFrame:
        domain, suffix = registered(F.col("host"))
        return df.filter("host <> ''").withColumn("domain", domain).withColumn("suffix", suffix)

    counts = cut(named(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").cast("double").alias("x")).filter("n > 0")))
    total = counts.agg(F.sum("x").alias("x"), F.sum("n").alias("n")).first()
    overall = (total.x / total.n) if total.n else 0.0
    suffixes = cut(_level(counts, ["suffix"], counts, [], overall).select("suffix", F.col("mean").alias("suffix_mean")))
    domains = cut(_level(counts, ["suffix", "domain"], suffixes.withColumnRenamed("suffix_mean", "parent_mean"), ["suffix"], overall).select("domain", F.col("mean").alias("domain_mean")))
    small_suffixes, small_domains = broadcast_upto(suffixes, HOSTS_BROADCAST), broadcast_upto(domains, HOSTS_BROADCAST)
    own = named(hosts.distinct()).join(small_domains, "domain", "left").join(small_suffixes, "suffix", "left").join(counts.select("host", "n", "x"), "host", "left")
    own = own.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("domain_mean", "suffix_mean", F.lit(overall)).alias("parent_mean"))
    strength = F.lit(_strength(own.filter("n > 0")))
    posterior = own.withColumn("size", F.col("n") + strength).withColumn("bad_mean", (F.col("x") + strength * F.col("parent_mean")) / F.col("size"))
    low = F.col("bad_mean") - 1.645 * F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("size") + 1))
    return posterior.select("host", "n", "bad_mean", low.alias("bad_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, block_from: float = 0.5) -> DataFrame:
    """One row for each page: ``page_id, host, path, rule, verdict, bad_mean``.

    ``outcomes(page_id, bad)`` are labelled pages; null labels don't count. A rule that fits decides; else a host is
    blocked when the lower posterior bound of its bad rate is ``block_from`` or more, also one that has no labelled page of
    its own. Null and odd urls (host and path empty) are allowed unless a rule fits; their labels count for no host.
    Repeated pages give repeated rows; an empty table gives none; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = seen.select("page_id", "host").join(outcomes.filter("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id")
    reputation = broadcast_upto(cut(host_reputation(labelled, seen.select("host"))), HOSTS_BROADCAST)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") >= block_from, "block").otherwise("allow")
    return seen.join(reputation, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_mean")
