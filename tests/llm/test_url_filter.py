import random
import re

from tesspan.llm import url_filter as u


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path, rules):
    fit = [(len(h) + len(p), len(h), -k, h + p, v) for k, (h, p, v) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


URLS = [None, "", "no scheme", "://", "HTTP://WWW.Example.COM/en/71?x#y", "http://example.com", "http://com/en/", "http://xcom/en/1", "http://a.example.net/de/8", "http://a.example.net/de/9#/de/8", "a://b.org/es/://c.com/en/", "http://É.ORG/es/?", "x://h\n.org/es/", "http://u:p@a.net:80/de/", "http://" + "a." * 3000 + "net/de/1", "http://e.com/EN/"]


def check(spark, rules):
    rows = [(i, x, "h") for i, x in enumerate(URLS)] + [(None, URLS[4], "h"), (4, URLS[4], "h")]
    got = u.judged(spark.createDataFrame(rows, "page_id long, url string, host string"), rules).collect()
    want = []
    for i, x, _ in rows:
        host, path = split(x)
        want.append((i, host, path, *rule(host, path, rules)))
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in got], key=str) == sorted([w[:4] for w in want], key=str)
    by = {(r.page_id, r.host, r.path): r.verdict for r in got}
    assert all(by[w[:3]] == w[4] for w in want if w[4])
    assert set(by.values()) <= {"allow", "block"}


def test_rules_in_one_expression(spark):
    check(spark, u.RULES)


def test_rules_by_join(spark):
    check(spark, u.RULES + [(f"h{i}.test", "/", "block") for i in range(120)])


def test_reputation_shrinks(spark):
    counts = [("a.bad.com", 50, 48), ("b.bad.com", 40, 39), ("c.bad.com", 1, 1), ("a.good.com", 60, 1), ("b.good.com", 30, 0), ("c.good.com", 1, 1), ("x.net", 30, 2)]
    outcomes = spark.createDataFrame(counts, "host string, n long, bad long")
    hosts = spark.createDataFrame([(h,) for h, _, _ in counts] + [("new.bad.com",), ("new.good.com",), ("",)], "host string")
    got = {r.host: r for r in u.reputations(outcomes, hosts).collect()}
    assert got["a.bad.com"].bound > 0.8 and got["c.bad.com"].share > 0.8 and got["new.bad.com"].share > 0.7
    assert got["c.good.com"].bound < 0.5 and got["new.good.com"].share < 0.3 and got["x.net"].share < 0.2
    assert all(0 < r.share < 1 and r.bound < r.share for r in got.values())


def test_against_plain_arithmetic(spark):
    rng = random.Random(2)
    counts = {f"h{i}.d{i % 7}.{'com' if i % 7 < 4 else 'org'}": (n := rng.randint(0, 9), rng.randint(0, n)) for i in range(60)}

    def shrink(groups):
        live = [(n, b, m) for n, b, m in groups.values() if n]
        spread, chance, room = sum(n * (b / n - m) ** 2 for n, b, m in live), sum(m * (1 - m) for _, _, m in live), sum(m * (1 - m) * (n - 1) for n, _, m in live)
        k = 1 / min(0.5, max(0.005, (spread - chance) / room)) - 1
        return {g: ((m * k + b) / (k + n), k + n) for g, (n, b, m) in groups.items()}

    def level(key, prior):
        out = {}
        for h, (n, b) in counts.items():
            a = out.setdefault(key(h), [0, 0, prior(h)])
            a[0] += n
            a[1] += b
        return shrink(out)

    n, b = map(sum, zip(*counts.values()))
    s = level(lambda h: h.split(".")[-1], lambda h: (b + 0.5) / (n + 1))
    d = level(lambda h: ".".join(h.split(".")[-2:]), lambda h: s[h.split(".")[-1]][0])
    top = level(lambda h: h, lambda h: d[".".join(h.split(".")[-2:])][0])
    frame = spark.createDataFrame([(h, *c) for h, c in counts.items()], "host string, n long, bad long")
    for r in u.reputations(frame, frame.select("host")).collect():
        share, weight = top[r.host]
        assert abs(r.share - share) < 1e-9 and abs(r.bound - (share - u.SIGMAS * (share * (1 - share) / (weight + 1)) ** 0.5)) < 1e-9


def test_empty(spark):
    assert u.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_levels(spark):
    want = {
        "a.b.example.com": ("com", "example.com"),
        "shop.example.co.uk": ("co.uk", "example.co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "user:pw@www.example.org:8080": ("org", "example.org"),
        "example.org.": ("org", "example.org"),
        "a.b.c.ck": ("c.ck", "b.c.ck"),
        "a.www.ck": ("ck", "www.ck"),
        "10.0.0.1:80": (u.IP, "10.0.0.1"),
        "[::1]:80": (u.IP, "[::1]"),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
    }
    rows = u.with_levels(spark.createDataFrame([(h,) for h in want], "host string")).collect()
    assert {r.host: (r.suffix, r.domain) for r in rows} == want
    own = spark.createDataFrame([("b.example.com",)], "rule string")
    assert [(r.suffix, r.domain) for r in u.with_levels(spark.createDataFrame([("x.a.b.example.com",)], "host string"), own).collect()] == [("b.example.com", "a.b.example.com")]


def test_outcomes_table(spark):
    """Pages that no rule fits are judged by outcomes that aren't the rules'."""
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(["s1.bad.test", "new.bad.test", "s1.good.test", "new.good.test"])], "page_id long, url string")
    outcomes = spark.createDataFrame([("s1.bad.test", 80, 79), ("s2.bad.test", 60, 60), ("s1.good.test", 90, 1), ("s2.good.test", 50, 0)], "host string, n long, bad long")
    outcomes_of_all = u.judged(pages, [], outcomes).collect()
    assert {r.page_id: r.verdict for r in outcomes_of_all} == {0: "block", 1: "block", 2: "allow", 3: "allow"}
