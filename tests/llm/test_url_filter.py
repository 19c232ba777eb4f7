import re

from pyspark.sql import functions as F

from sanmaru.llm.url_filter import RULES, SUFFIX_RULES, host_reputation, judge_urls, registered

SCHEMA = "page_id long, url string, host string, verdict int"


def brute(url):
    m = re.match(r"(?s).*?://(.*)", url or "")
    rest = m[1] if m else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = (None, None)
    for verdict, rule in sorted(RULES, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = (rule, verdict)
    return host, path, *best


URLS = ["http://a.Example.NET/en/1?x#y", "https://example.net/en", "http://net/", "http://net", "http://xnet/", "ftp://b.example.com/de/", "http://example.com.de/de/", "x", None, "", "a://b://c.net/d", "http://ÄX.org/fr/é?q", "http://org/fr/#", "http://h.org?x/fr/", "HTTP://H.NET:80/", "http://\n.net/\n", "://x.net/y"]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS + URLS[:2])], SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert len(got) == len(URLS) + 2
    for i, u in enumerate(URLS + URLS[:2]):
        host, path, rule, verdict = brute(u)
        assert got[i] == (host, path, rule, verdict or "allow"), u


def test_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.x.org/{i}", "", 0) for i in range(200)] + [(1000, "http://new.x.org/", "", 0), (1001, "http://one.y.org/", "", 0)]
    outcomes = [(i, i % 2) for i in range(200)] + [(1001, 1), (1000, None)]
    pages, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(outcomes, "page_id long, bad int")
    got = {r.page_id: r.verdict for r in judge_urls(pages, known).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(200))
    assert got[1000] == "allow"  # no labelled page, and its domain is half bad
    outcomes = spark.createDataFrame([("bad.x.org", 1)] * 9 + [("good.x.org", 0)] * 9 + [("one.y.org", 1)], "host string, bad int")
    means = {r.host: r.bad_mean for r in host_reputation(outcomes, outcomes.select("host")).collect()}
    assert 0 < means["good.x.org"] < means["one.y.org"] < 1 and means["good.x.org"] < 0.5 < means["bad.x.org"]


def test_hosts_without_labelled_pages_have_the_prior_of_their_domain(spark):
    rows = [(i, f"http://h{i % 40}.{'bad' if i % 80 < 40 else 'good'}.com/{i}", "", 0) for i in range(4000)]
    rows += [(9000, "http://new.bad.com/", "", 0), (9001, "http://new.good.com/", "", 0), (9002, "http://a.other.com/", "", 0), (9003, "http://a.b.xyz/", "", 0), (9004, "x", "", 0), (9005, "http://bad.com/", "", 0)]
    outcomes = spark.createDataFrame([(r[0], int("bad" in r[1])) for r in rows[:4000]] + [(9004, 1)], "page_id long, bad int")
    got = {r.page_id: (r.verdict, r.bad_mean) for r in judge_urls(spark.createDataFrame(rows, SCHEMA), outcomes).collect()}
    assert got[9000][0] == got[9005][0] == "block" and got[9001][0] == got[9002][0] == got[9003][0] == got[9004][0] == "allow"
    assert got[9001][1] < got[9002][1] < got[9000][1] and abs(got[9003][1] - 0.5) < 1e-9  # suffix, then the overall rate


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def brute_registered(host):
    name = re.sub(r"^.*@|:[0-9]*$", "", host).rstrip(".")
    if re.match(r"^[0-9.]+$|^\[", name):
        return name, name
    labels = name.split(".")
    size = 1
    for rule in SUFFIX_RULES:
        own = rule.lstrip("!").split(".")
        if len(labels) >= len(own) and all(a in ("*", b) for a, b in zip(own, labels[-len(own) :], strict=True)):
            if rule[0] == "!":
                size = len(own) - 1
                break
            size = max(size, len(own))
    return ".".join(labels[-size - 1 :]), ".".join(labels[-size:])


def test_registered_domains(spark):
    hosts = ["a.co.uk", "x.a.co.uk", "co.uk", "uk", "a.b.org", "b.co.kr:8080", "me@x.example.com", "example.com.", "1.2.3.4", "1.2.3.4:80", "[::1]:80", "www.ck", "a.www.ck", "shop.ck", "a.shop.ck", "city.kawasaki.jp", "x.city.kawasaki.jp", "x.y.kawasaki.jp", "kawasaki.jp", "a.sch.uk", "b.a.sch.uk", "localhost", "a..b", "é.example", "com.np", "x.com.np"]
    hosts += [f"x.y.{r.lstrip('!*.')}" for r in SUFFIX_RULES]
    domain, suffix = registered(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == {h: brute_registered(h) for h in hosts}
    assert brute_registered("x.a.co.uk") == ("a.co.uk", "co.uk") and brute_registered("x.city.kawasaki.jp") == ("city.kawasaki.jp", "kawasaki.jp")


def test_names_under_a_shared_suffix_are_no_family(spark):
    """Good and bad names under co.uk: a new host has the prior of its own registered domain, ports aside."""
    rows = [(i, f"http://h{i % 20}.{'bad' if i % 2 else 'good'}.co.uk:80{i % 3}/{i}", "", 0) for i in range(2000)] + [(9000, "http://new.bad.co.uk/", "", 0), (9001, "http://new.good.co.uk/", "", 0)]
    outcomes = spark.createDataFrame([(r[0], int(".bad." in r[1])) for r in rows[:2000]], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, SCHEMA), outcomes).collect()}
    assert got[9000] == "block" and got[9001] == "allow"
