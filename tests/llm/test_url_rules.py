import re

import pytest

from attestry.llm import url_rules as U

SITES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def by_hand(rows, sites, patterns=(), default="allow"):
    for page_id, url in rows:
        host, path = parts(url)
        fits = []
        for rule, verdict in sites:
            h, _, p = rule.partition("/")
            if (host == h.lower() or host.endswith("." + h.lower())) and (not _ or path.startswith("/" + p)):
                fits.append((-len(rule), rule, verdict))
        other = sorted((-len(r), r, v) for r, v in patterns if matches(r, host, path))
        best = min(fits, default=None)
        yield page_id, host, path, best and best[1], best[2] if best else other[0][2] if other else default, other[0][1] if other else None


def matches(rule, host, path):
    """A pattern tried at every place, sign by sign."""
    subject = host + path
    body = re.sub(r"^\|{1,2}|\|$", "", rule)
    starts = [0] if rule.startswith("|") else range(len(subject) + 1)
    if rule.startswith("||"):
        starts = [0, *[k + 1 for k, c in enumerate(subject) if c == "." and "/" not in subject[:k]]]

    def go(k, at):
        if k == len(body):
            return at == len(subject) if len(rule) > 1 and rule.endswith("|") and rule != "||" else True
        if body[k] == "*":
            return any(go(k + 1, j) for j in range(at, len(subject) + 1))
        if body[k] == "^":
            return at == len(subject) and go(k + 1, at) or at < len(subject) and not re.match(r"[A-Za-z0-9_.%-]", subject[at]) and go(k + 1, at + 1)
        return at < len(subject) and subject[at] == body[k] and go(k + 1, at + 1)

    return any(go(0, s) for s in starts)


def alike(df, want):
    assert df.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


ODD = [None, "", "no scheme at all", "://", "http://", "HTTP://Example.ORG", "http://org/", "http://org", "http://notexample.org/es/", "http://www.example.org/es/x?y=/en/1#z", "http://example.org/ES/", "http://EXAMPLE.org/en/1",
       "http://example.org/en/12345", "http://a.com/fr/", "http://com/de/?", "http://a.com/fr", "ftp://x://y.org/es/", "http://example.org:80/es/", "http://u@example.org/es/", "http://ads.x.com/de/", "http://ads.x.net#top",
       "http://bads.x.net/", "http://x.net/a/ads.b", "http://m.casino-win.example.net/", "http://casino.net/", "http://x.net/wp-login.php", "http://x.net/wp-login.php5", "http://x.net/banner/a/b/click", "http://x.net/xbanner/click",
       "http://x.net/\n/es\n/", "http://Жук.org/ж", "http://x.net/" + "a/" * 50_000, "http://track.K\u0130\u212a.net/", "http://doubleclick.net", "http://doubleclick.network/"]


def test_contract_on_odd_urls(spark):
    rows = [(k, u) for k, u in enumerate(ODD)] + [(None, ODD[6]), (3, ODD[9]), (3, ODD[9])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as html", "1 as rule", "2 as host", "3 as path", "4 as token", "5 as row", "6 as verdict", "7 as tokens")
    rules = U.site_rules(spark, U.SITES).unionByName(U.pattern_rules(spark, U.PATTERNS))
    alike(U.judge(df, rules), by_hand(rows, U.SITES, U.PATTERNS))
    assert U.SITES == SITES
    assert U.judge(df.limit(0), rules).count() == 0
    alike(U.judge(df, rules.limit(0), "block"), by_hand(rows, [], [], "block"))


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").collect()]
    alike(U.op13_url_rules(spark, "/root/testdata/sf0.1"), by_hand(rows, U.SITES, U.PATTERNS))


@pytest.mark.parametrize("most", [500_000, 0])
def test_other_rules_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    """Rules without tokens, with signs of regular expressions, ties, repeats, nulls: the index finds what trying all rules finds."""
    sites = [("B.com", "block"), ("b.com/x(y", "allow"), ("x.b.com/", "allow"), ("b.com/x", "block"), ("b.com/x", "allow"), ("a-b.c/é", "block"), ("a-b.c/é", "block"), (".", "block")]
    patterns = [("*", "allow"), ("^q^", "block"), ("|b.com/z|", "block"), ("a+b*c", "block"), ("||b.com^*.html|", "block"), ("[x]", "block"), ("%41", "block"), ("zz|", "block"), ("||", "allow"), ("$", "block")]
    urls = ["http://b.com", "http://x.b.com/x(y/z", "http://b.com/xy", "http://b.com/z", "http://b.com/zz", "http://q.r/a+bxxc", "http://a-b.c/é1", "http://b.com/s/t.html", "http://b.com/s/t.html5", "http://c.d/[x]", "http://c.d/x%41y", "http://q/", "http://s/q/", "http://s/$", None]
    monkeypatch.setattr(U, "small", lambda df: df if most == 0 else U.F.broadcast(df))
    rows = list(enumerate(urls))
    rules = U.site_rules(spark, sites).unionByName(U.pattern_rules(spark, patterns))
    df = spark.createDataFrame(rows, "page_id long, url string")
    alike(U.judge(df, rules.unionByName(rules.selectExpr("cast(null as string) as rule", "verdict", "site"))), by_hand(rows, sites, patterns))


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = U.site_rules(spark, [("a.b.com/c/d", "block"), ("com/", "allow")]).unionByName(U.pattern_rules(spark, [("||b.com^", "block"), ("x*y", "block")]))
    subjects = spark.createDataFrame([(["a", "com"],), (["b", "com"],), (["b", "a"],), (["b", "c", "a"],)], "tokens array<string>")
    got = {r.rule: r.token for r in U.indexed(rules, subjects).collect()}
    assert got == {"a.b.com/c/d": "c", "com/": "com", "||b.com^": "com", "x*y": ""}


def test_plan_is_native(spark):
    plan = U.op13_url_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
